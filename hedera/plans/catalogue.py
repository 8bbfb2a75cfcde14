"""Registered queries, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import HDFEConfig, PPMLConfig, data_requirements, factor, fe
from ..operators import effects, linear, poisson, resampling, sessions, structure
from ..operators.problem import expanded, prepare
from ..operators.report import Result
from ..sources import data as sources

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the month of shipment as a number of months."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("month", month).withColumn("l_endog", F.col("l_quantity") * F.col("l_discount"))


def short(spark: SparkSession, r: Result, digits: int = 4) -> DataFrame:
    rows = [(n, round(float(b), digits), round(float(s), digits)) for n, b, s in zip(r.names, r.coef, r.stderr, strict=True)]
    r.release()
    return spark.createDataFrame(rows, "variable string, estimate double, std_error double")


def named(spark: SparkSession, pairs, digits: int = 5) -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), digits)) for k, v in pairs], "name string, value double")


# ------------------------------------------------------------------------------------------------------------- SQL

#: l_extendedprice on l_quantity within l_suppkey: e has y, x within, w, residual u and score s.
_ITEM = "SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS month FROM lineitem"


def within_sql(weight: str = "1.0", group: str = "l_suppkey") -> str:
    return f"""WITH base AS (SELECT l_extendedprice AS y0, l_quantity AS x0, ({weight})::DOUBLE AS w, {group} AS g, month, l_returnflag, l_suppkey FROM ({_ITEM}) i),
m AS (SELECT *, y0 - sum(w * y0) OVER (PARTITION BY g) / sum(w) OVER (PARTITION BY g) AS y, x0 - sum(w * x0) OVER (PARTITION BY g) / sum(w) OVER (PARTITION BY g) AS x FROM base),
b AS (SELECT sum(w * x * y) / sum(w * x * x) AS b, 1 / sum(w * x * x) AS a, count(*) AS n, sum(w) AS sw, count(DISTINCT g) AS k FROM m),
e AS (SELECT m.*, b.b, b.a, b.n, b.sw, b.k, y - b.b * x AS u, w * x * (y - b.b * x) AS s FROM m, b)
"""


def se_sql(variance: str, extra: str = "", source: str = "e", weight: str = "1.0", group: str = "l_suppkey") -> str:
    return within_sql(weight, group) + extra + f"SELECT 'l_quantity' AS variable, round(any_value(b), 4) AS estimate, round(sqrt({variance}), 4) AS std_error FROM {source}"


# -------------------------------------------------------------------------------------------------------------- OLS


def _ols1(spark, sf_dir, **more) -> Result:
    return linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity"], absorb=["l_suppkey"], **more)


@query(se_sql("any_value(a) * sum(u * u) / (any_value(n) - 1 - any_value(k))"))
def ols_fe1_iid(spark, sf_dir):
    return short(spark, _ols1(spark, sf_dir))


@query(se_sql("any_value(a) ^ 2 * sum(s * s) * any_value(n) / (any_value(n) - 1 - any_value(k))"))
def ols_fe1_robust(spark, sf_dir):
    return short(spark, _ols1(spark, sf_dir, vce="robust"))


@query(se_sql("any_value(a) ^ 2 * sum(s * s) * (any_value(n) - 1.0) / (any_value(n) - 1 - any_value(k)) * count(*) / (count(*) - 1.0)", ", c AS (SELECT sum(s) AS s, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, any_value(k) AS k FROM e GROUP BY month) ", "c"))
def ols_fe1_cluster(spark, sf_dir):
    return short(spark, _ols1(spark, sf_dir, cluster="month"))


@query(se_sql("any_value(a) ^ 2 * sum(s * s) * (any_value(n) - 1.0) / (any_value(n) - 2.0) * count(*) / (count(*) - 1.0)", ", c AS (SELECT sum(s) AS s, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n FROM e GROUP BY l_suppkey) ", "c"))
def ols_fe1_cluster_nested(spark, sf_dir):
    """Clusters in which the effect is nested: it takes no degrees of freedom."""
    return short(spark, _ols1(spark, sf_dir, cluster="l_suppkey"))


@query(within_sql() + """, c AS (
  SELECT sum(s) AS s, 'month' AS way FROM e GROUP BY month UNION ALL SELECT sum(s), 'flag' FROM e GROUP BY l_returnflag UNION ALL SELECT sum(s), 'both' FROM e GROUP BY month, l_returnflag
), v AS (SELECT sum(CASE WHEN way = 'both' THEN -s * s ELSE s * s END) AS m, least(count(*) FILTER (WHERE way = 'month'), count(*) FILTER (WHERE way = 'flag')) AS g FROM c),
p AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, any_value(k) AS k FROM e)
SELECT 'l_quantity' AS variable, round(b, 4) AS estimate, round(sqrt(greatest(a ^ 2 * m * (n - 1.0) / (n - 1 - k) * g / (g - 1.0), 0)), 4) AS std_error FROM v, p""")
def ols_cluster_2way(spark, sf_dir):
    return short(spark, _ols1(spark, sf_dir, cluster=["month", "l_returnflag"]))


@query(within_sql() + """, t AS (SELECT month, sum(s) AS s FROM e GROUP BY month),
v AS (SELECT sum(CASE WHEN x.month = z.month THEN 1.0 ELSE 2.0 * (1 - (x.month - z.month) / 3.0) END * x.s * z.s) AS m FROM t x JOIN t z ON x.month - z.month BETWEEN 0 AND 2),
p AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, any_value(k) AS k, count(DISTINCT month) AS g FROM e)
SELECT 'l_quantity' AS variable, round(b, 4) AS estimate, round(sqrt(a ^ 2 * m * (n - 1.0) / (n - 1 - k) * g / (g - 1.0)), 4) AS std_error FROM v, p""")
def ols_driscoll_kraay(spark, sf_dir):
    return short(spark, _ols1(spark, sf_dir, vce="dkraay", time="month", bandwidth=3))


@query("""WITH d AS (SELECT user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS day, sum(value) AS y0, count(*)::DOUBLE AS x0 FROM events GROUP BY 1, 2),
s1 AS (SELECT * FROM d WHERE user_id IN (SELECT user_id FROM d GROUP BY user_id HAVING count(*) > 1)),
m AS (SELECT *, y0 - avg(y0) OVER (PARTITION BY user_id) AS y, x0 - avg(x0) OVER (PARTITION BY user_id) AS x FROM s1),
b AS (SELECT sum(x * y) / sum(x * x) AS b, 1 / sum(x * x) AS a, count(*) AS n, count(DISTINCT user_id) AS k FROM m),
e AS (SELECT user_id, day, x * (y - b.b * x) AS s FROM m, b),
v AS (SELECT sum(CASE WHEN p.day = q.day THEN 1.0 ELSE 2.0 * (1 - (p.day - q.day) / 2.0) END * p.s * q.s) AS m FROM e p JOIN e q ON p.user_id = q.user_id AND p.day - q.day BETWEEN 0 AND 1)
SELECT 'n' AS variable, round(b, 4) AS estimate, round(sqrt(a ^ 2 * m * n / (n - 1 - k)), 4) AS std_error FROM v, b""")
def ols_hac_panel(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    return short(spark, linear.olshdfe(d, y="v", x=["n"], absorb=["user_id"], vce="hac", time="day", panel="user_id", bandwidth=2))


@query("""WITH base AS (SELECT l_suppkey AS g, l_extendedprice AS y0, l_quantity AS x0, l_discount AS z0 FROM lineitem),
m AS (SELECT g, y0 - avg(y0) OVER (PARTITION BY g) AS y, x0 - avg(x0) OVER (PARTITION BY g) AS x, z0 - avg(z0) OVER (PARTITION BY g) AS z FROM base),
q AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, count(*) AS n, count(DISTINCT g) AS k FROM m),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM q),
r AS (SELECT any_value(b1) AS b1, any_value(b2) AS b2, any_value(xx) AS xx, any_value(zz) AS zz, any_value(xz) AS xz, sum((y - b1 * x - b2 * z) ^ 2) / (any_value(n) - 2 - any_value(k)) AS s2 FROM m, b)
SELECT 'l_quantity' AS variable, round(b1, 4) AS estimate, round(sqrt(s2 * zz / (xx * zz - xz * xz)), 4) AS std_error FROM r
UNION ALL SELECT 'l_discount', round(b2, 4), round(sqrt(s2 * xx / (xx * zz - xz * xz)), 4) FROM r""")
def ols_fe1_k2(spark, sf_dir):
    return short(spark, linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity", "l_discount"], absorb=["l_suppkey"]))


def _sweeps(n: int) -> str:
    """Alternating projections on two effects, unrolled."""
    out = ["v0 AS (SELECT l_suppkey AS g, l_partkey AS h, l_extendedprice AS y, l_quantity AS x FROM lineitem)", "s0 AS (SELECT * FROM v0 WHERE g IN (SELECT g FROM v0 GROUP BY g HAVING count(*) > 1) AND h IN (SELECT h FROM v0 GROUP BY h HAVING count(*) > 1))"]
    for i in range(n):
        part = "g" if i % 2 == 0 else "h"
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT g, h, y - avg(y) OVER (PARTITION BY {part}) AS y, x - avg(x) OVER (PARTITION BY {part}) AS x FROM s{i})")
    return "WITH " + ",\n".join(out)


@query(_sweeps(40) + """, b AS (SELECT sum(x * y) / sum(x * x) AS b, 1 / sum(x * x) AS a, count(*) AS n, count(DISTINCT h) AS k FROM s40),
c AS (SELECT sum(x * (y - b.b * x)) AS s FROM s40, b GROUP BY g)
SELECT 'l_quantity' AS variable, round(any_value(b), 4) AS estimate, round(sqrt(any_value(a) ^ 2 * sum(s * s) * (any_value(n) - 1.0) / (any_value(n) - any_value(k) - 1.0) * count(*) / (count(*) - 1.0)), 4) AS std_error FROM c, b""")
def ols_fe2_cluster(spark, sf_dir):
    """Two effects, clustered by one of them (which takes no degrees of freedom)."""
    return short(spark, linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity"], absorb=["l_suppkey", "l_partkey"], cluster="l_suppkey"))


def _sweeps3(n: int) -> str:
    """Alternating projections on three effects, unrolled."""
    out = [f"v0 AS (SELECT l_suppkey AS g, l_partkey AS h, month AS t, l_extendedprice AS y, l_quantity AS x, l_discount AS z FROM ({_ITEM}) i)"]
    for i in range(3):
        out.append(f"v{i + 1} AS (SELECT * FROM v{i} WHERE " + " AND ".join(f"{c} IN (SELECT {c} FROM v{i} GROUP BY {c} HAVING count(*) > 1)" for c in "ght") + ")")
    out.append("s0 AS MATERIALIZED (SELECT * FROM v3)")
    for i in range(n):
        part = "ght"[i % 3]
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT g, h, t, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {part}) AS {c}" for c in "yxz") + f" FROM s{i})")
    return "WITH " + ",\n".join(out)


@query(_sweeps3(45) + """, q AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, count(*) AS n, count(DISTINCT g) + count(DISTINCT h) + count(DISTINCT t) - 2 AS k FROM s45),
b AS (SELECT *, xx * zz - xz * xz AS d, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM q),
r AS (SELECT any_value(b1) AS b1, any_value(b2) AS b2, sum(((zz * x - xz * z) / d * (y - b1 * x - b2 * z)) ^ 2) * any_value(n) / (any_value(n) - 2 - any_value(k)) AS v1, sum(((xx * z - xz * x) / d * (y - b1 * x - b2 * z)) ^ 2) * any_value(n) / (any_value(n) - 2 - any_value(k)) AS v2 FROM s45, b)
SELECT 'l_quantity' AS variable, round(b1, 4) AS estimate, round(sqrt(v1), 4) AS std_error FROM r UNION ALL SELECT 'l_discount', round(b2, 4), round(sqrt(v2), 4) FROM r""")
def ols_fe3_pairwise(spark, sf_dir):
    return short(spark, linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity", "l_discount"], absorb=["l_suppkey", "l_partkey", "month"], vce="robust"))


@query(se_sql("any_value(a) * sum(u * u) / (any_value(n) - 1 - any_value(k))", group="l_returnflag || ':' || l_linestatus").replace("AS month FROM lineitem", "AS month FROM lineitem"))
def ols_interaction_fe(spark, sf_dir):
    """A combination of two columns as an effect; the effect of one of them alone is spanned by it and dropped."""
    r = linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity"], absorb=[("l_returnflag", "l_linestatus")])
    return short(spark, r)


@query("""WITH c AS (SELECT count(DISTINCT l_returnflag || l_linestatus) AS a, count(DISTINCT l_linestatus) AS b FROM lineitem)
SELECT 'levels' AS name, (a + b)::DOUBLE AS value FROM c UNION ALL SELECT 'df_absorbed', a::DOUBLE FROM c UNION ALL SELECT 'dropped_terms', 1.0 FROM c""")
def canonicalize(spark, sf_dir):
    p = prepare(items(spark, sf_dir), y="l_extendedprice", roles={"x": ["l_quantity"]}, absorb=[("l_returnflag", "l_linestatus"), "l_linestatus"])
    d = p.dof()
    return named(spark, [("levels", d.initial), ("df_absorbed", d.df_absorbed), ("dropped_terms", len(p.canonical_dropped))])


_W = "l_quantity"


@query(se_sql("any_value(a) ^ 2 * sum((s / (n / sw)) ^ 2 * (n / sw) ^ 2) * any_value(n) / (any_value(n) - 2.0 - any_value(k) + 1)", weight="l_discount + 0.01").replace("(s / (n / sw)) ^ 2 * (n / sw) ^ 2", "s ^ 2"))
def wls_pweight(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("pw", F.col("l_discount") + 0.01)
    return short(spark, linear.olshdfe(d, y="l_extendedprice", x=["l_quantity"], absorb=["l_suppkey"], weights="pw", weight_type="pweight"))


@query(se_sql("any_value(a) * sum(w * u * u) / (any_value(n) - 1 - any_value(k))", weight="l_discount + 0.01"))
def wls_aweight(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("aw", F.col("l_discount") + 0.01)
    return short(spark, linear.olshdfe(d, y="l_extendedprice", x=["l_quantity"], absorb=["l_suppkey"], weights="aw", weight_type="aweight"))


@query(se_sql("any_value(a) * sum(w * u * u) / (any_value(sw) - 1 - any_value(k))", weight="l_linenumber"))
def wls_fweight(spark, sf_dir):
    return short(spark, linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity"], absorb=["l_suppkey"], weights="l_linenumber", weight_type="fweight"))


@query("""WITH m AS (SELECT l_suppkey AS g, l_extendedprice AS y0, l_quantity AS x0, l_discount AS z0 FROM lineitem),
c AS (SELECT g, y0 - avg(y0) OVER (PARTITION BY g) AS y, x0 - avg(x0) OVER (PARTITION BY g) AS x, z0 - avg(z0) OVER (PARTITION BY g) AS z FROM m),
s AS (SELECT g, sum(z * z) AS zz, sum(z * y) AS zy, sum(z * x) AS zx FROM c GROUP BY g),
r AS (SELECT c.g, y - zy / zz * z AS y, x - zx / zz * z AS x FROM c JOIN s USING (g)),
b AS (SELECT sum(x * y) / sum(x * x) AS b, 1 / sum(x * x) AS a, count(*) AS n, count(DISTINCT g) AS k FROM r)
SELECT 'l_quantity' AS variable, round(any_value(b), 4) AS estimate, round(sqrt(any_value(a) * sum((y - b * x) ^ 2) / (any_value(n) - 1 - 2 * any_value(k))), 4) AS std_error FROM r, b""")
def ols_slopes(spark, sf_dir):
    """An intercept and a slope for each supplier."""
    return short(spark, linear.olshdfe(items(spark, sf_dir), y="l_extendedprice", x=["l_quantity"], absorb=[fe("l_suppkey", "l_discount")]))


@query(within_sql() + """, t AS (SELECT sum(u * u) AS rss, sum((y0 - (SELECT avg(y0) FROM base)) ^ 2) AS tss, sum(y * y) AS tw, any_value(n)::DOUBLE AS n, any_value(k)::DOUBLE AS k FROM e)
SELECT 'r2' AS name, round(1 - rss / tss, 5) AS value FROM t UNION ALL SELECT 'r2_within', round(1 - rss / tw, 5) FROM t
UNION ALL SELECT 'r2_adjusted', round(1 - (rss / (n - k - 1)) / (tss / (n - 1)), 5) FROM t UNION ALL SELECT 'r2_adjusted_within', round(1 - (rss / (n - k - 1)) / (tw / (n - k)), 5) FROM t
UNION ALL SELECT 'rmse', round(sqrt(rss / (n - k - 1)), 5) FROM t UNION ALL SELECT 'loglike', round(-n / 2 * (1 + ln(2 * pi()) + ln(rss / n)), 3) FROM t
UNION ALL SELECT 'f_statistic', round((tw - rss) / (rss / (n - k - 1)), 3) FROM t UNION ALL SELECT 'df_absorbed', k FROM t""")
def fit_statistics(spark, sf_dir):
    r = _ols1(spark, sf_dir)
    r.release()
    digits = {"loglike": 3, "f_statistic": 3}
    return spark.createDataFrame([(k, round(r.stats[k], digits.get(k, 5))) for k in ("r2", "r2_within", "r2_adjusted", "r2_adjusted_within", "rmse", "loglike", "f_statistic", "df_absorbed")], "name string, value double")


def _rounds(n: int) -> str:
    out = ["o0 AS (SELECT o_custkey AS g, year(o_orderdate) * 12 + month(o_orderdate) AS h, o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"]
    for i in range(n):
        out.append(f"o{i + 1} AS (SELECT * FROM o{i} WHERE g IN (SELECT g FROM o{i} GROUP BY g HAVING count(*) > 1) AND h IN (SELECT h FROM o{i} GROUP BY h HAVING count(*) > 1))")
    return "WITH " + ", ".join(out)


@query((_rounds(8) + " SELECT 'kept' AS name, count(*)::DOUBLE AS value FROM o8 UNION ALL SELECT 'removed', ((SELECT count(*) FROM o0) - count(*))::DOUBLE FROM o8").replace(" WHERE o_orderkey % 3 = 0", ""))
def singletons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("h"))
    kept, gone, _ = structure.drop_singletons(o, ["g", "h"])
    return named(spark, [("kept", kept.count()), ("removed", gone)])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, c_mktsegment AS b FROM customer), r AS (
  SELECT a AS root, a FROM e UNION SELECT r.root, e2.a FROM r JOIN e e1 ON e1.a = r.a JOIN e e2 ON e2.b = e1.b
), c AS (SELECT a, min(root) AS comp FROM r GROUP BY a)
SELECT 'components' AS name, count(DISTINCT comp)::DOUBLE AS value FROM c
UNION ALL SELECT 'df_absorbed', ((SELECT count(DISTINCT a) + count(DISTINCT b) FROM e) - count(DISTINCT comp))::DOUBLE FROM c""")
def dof_pairwise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = prepare(c, y="c_acctbal", roles={"x": []}, absorb=["c_nationkey", "c_mktsegment"])
    return named(spark, [("components", structure.n_components(p.frame, "g0", "g1")), ("df_absorbed", p.dof().df_absorbed)])


def _linked(name: str, edges: str) -> str:
    """Whether one component holds all levels a of edges (a, b): what is reached from the smallest of them."""
    return f"""{name}_e AS (SELECT DISTINCT {edges} FROM v),
{name}_r AS (SELECT min(a) AS a FROM {name}_e UNION SELECT f.a FROM {name}_r r JOIN {name}_e e ON e.a = r.a JOIN {name}_e f ON f.b = e.b),
{name} AS (SELECT (SELECT count(*) FROM {name}_r) = (SELECT count(DISTINCT a) FROM {name}_e) AS ok)"""


#: Where all pairs of effects are connected, each but the first loses one. If flags that share a supplier's month connect all
#: flags, whatever sums to zero in all cells has one value for all flags, so that the rank, too, is short by two.
@query(f"WITH RECURSIVE v AS (SELECT l_suppkey AS g, l_returnflag AS h, month AS t FROM ({_ITEM}) i), " + ", ".join(_linked(n, e) for n, e in (("gh", "h AS a, g AS b"), ("gt", "t AS a, g AS b"), ("ht", "h AS a, t AS b"), ("hc", "h AS a, (g, t) AS b"))) + """,
k AS (SELECT (count(DISTINCT g) + count(DISTINCT h) + count(DISTINCT t) - 2)::DOUBLE AS k FROM v)
SELECT 'exact' AS name, CASE WHEN gt.ok AND hc.ok THEN k END AS value FROM k, gt, hc UNION ALL SELECT 'pairwise', CASE WHEN gh.ok AND gt.ok AND ht.ok THEN k END FROM k, gh, gt, ht
UNION ALL SELECT 'firstpair', CASE WHEN gh.ok THEN k END FROM k, gh UNION ALL SELECT 'none', k FROM k""")
def dof_exact(spark, sf_dir):
    p = prepare(items(spark, sf_dir), y="l_extendedprice", roles={"x": []}, absorb=["l_suppkey", "l_returnflag", "month"])
    return named(spark, [(m, p.dof(m).df_absorbed) for m in ("exact", "pairwise", "firstpair", "none")])


# --------------------------------------------------------------------------------------------------------------- IV

_IV_SQL = """WITH v AS (SELECT l_suppkey AS g, l_extendedprice AS y0, l_quantity * l_discount AS e0, l_quantity AS a0, l_discount AS b0 FROM lineitem),
m AS (SELECT g, y0 - avg(y0) OVER (PARTITION BY g) AS y, e0 - avg(e0) OVER (PARTITION BY g) AS e, a0 - avg(a0) OVER (PARTITION BY g) AS a, b0 - avg(b0) OVER (PARTITION BY g) AS b FROM v),
q AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*e) AS ae, sum(b*e) AS be, sum(a*y) AS ay, sum(b*y) AS by_, sum(e*e) AS ee, sum(e*y) AS ey, sum(y*y) AS yy, count(*)::DOUBLE AS n, count(DISTINCT g)::DOUBLE AS k FROM m),
p AS (SELECT *, (bb*ae - ab*be)/(aa*bb - ab*ab) AS p1, (aa*be - ab*ae)/(aa*bb - ab*ab) AS p2, (bb*ay - ab*by_)/(aa*bb - ab*ab) AS r1, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS r2 FROM q),
f AS (SELECT *, p1*ae + p2*be AS xpx, p1*ay + p2*by_ AS xpy FROM p),
s AS (SELECT *, xpy / xpx AS beta, yy - 2*(xpy/xpx)*ey + (xpy/xpx)^2*ee AS rss, ee - xpx AS first_rss FROM f)
"""


@query(_IV_SQL + "SELECT 'l_endog' AS variable, round(beta, 3) AS estimate, round(sqrt(rss / (n - 1 - k) / xpx), 3) AS std_error FROM s")
def iv_2sls(spark, sf_dir):
    return short(spark, _iv(spark, sf_dir, diagnostics=False), 3)


def _iv(spark, sf_dir, **more) -> Result:
    return linear.ivhdfe(items(spark, sf_dir), y="l_extendedprice", endog=["l_endog"], instruments=["l_quantity", "l_discount"], absorb=["l_suppkey"], **more)


@query(_IV_SQL + """SELECT 'partial_r2' AS name, round(xpx / ee, 5) AS value FROM s
UNION ALL SELECT 'first_stage_f', round((xpx / 2) / (first_rss / (n - 2 - k)), 2) FROM s
UNION ALL SELECT 'cragg_donald_f', round((n - 2 - k) / 2 * xpx / first_rss, 2) FROM s
UNION ALL SELECT 'sargan', round((((ay - beta*ae)*(bb*(ay - beta*ae) - ab*(by_ - beta*be)) + (by_ - beta*be)*(aa*(by_ - beta*be) - ab*(ay - beta*ae))) / (aa*bb - ab*ab)) / (rss / (n - 1)), 4) FROM s""")
def iv_diagnostics(spark, sf_dir):
    r = _iv(spark, sf_dir)
    r.release()
    f = r.diagnostics["first_stage"]["endog0"]
    rows = [("partial_r2", f["partial_r2"], 5), ("first_stage_f", f["f_classic"], 2), ("cragg_donald_f", r.diagnostics["cragg_donald_f"], 2), ("sargan", r.diagnostics["overidentification"]["stat"], 4)]
    return spark.createDataFrame([(k, round(float(v), d)) for k, v, d in rows], "name string, value double")


#: The k-class with LIML's kappa (the smaller root for the two products' pencil), less `fuller` over the residual degrees; m has the residuals' parts.
def _kclass_sql(fuller: float, meat: str) -> str:
    return _IV_SQL + f""", w AS (SELECT *, yy - r1*ay - r2*by_ AS m11, ey - xpy AS m12, ee - xpx AS m22 FROM f),
r AS (SELECT *, m11*m22 - m12*m12 AS d2, yy*m22 + ee*m11 - 2*ey*m12 AS d1, yy*ee - ey*ey AS d0 FROM w),
h AS (SELECT *, (d1 - sqrt(d1*d1 - 4*d2*d0)) / (2*d2) - {fuller} / (n - 2) AS kappa FROM r),
t AS (SELECT *, ((1 - kappa)*ey + kappa*xpy) / ((1 - kappa)*ee + kappa*xpx) AS beta, (1 - kappa)*ee + kappa*xpx AS lhs FROM h)
SELECT 'l_endog' AS variable, round(any_value(t.beta), 4) AS estimate, round(sqrt({meat}), 4) AS std_error FROM m, t"""


@query(_kclass_sql(0.0, "sum(((p1 * a + p2 * b) * (y - t.beta * e)) ^ 2) * any_value(n) / (any_value(n) - 1 - any_value(k)) / any_value(lhs) ^ 2"))
def iv_liml(spark, sf_dir):
    return short(spark, _iv(spark, sf_dir, estimator="liml", vce="robust", diagnostics=False))


@query(_kclass_sql(1.0, "sum((y - t.beta * e) ^ 2) / (any_value(n) - 1 - any_value(k)) / any_value(lhs)"))
def iv_fuller(spark, sf_dir):
    return short(spark, _iv(spark, sf_dir, estimator="liml", fuller=1.0, diagnostics=False))


#: Scores by month of the first step (2SLS) give the weights, those of the second the covariance.
_GMM_SQL = _IV_SQL.replace("SELECT l_suppkey AS g,", "SELECT year(l_shipdate) * 12 + month(l_shipdate) AS month, l_suppkey AS g,").replace("m AS (SELECT g,", "m AS (SELECT month, g,") + """, c1 AS (SELECT sum(a * (y - beta * e)) AS sa, sum(b * (y - beta * e)) AS sb FROM m, s GROUP BY month),
w AS (SELECT sum(sa * sa) AS saa, sum(sa * sb) AS sab, sum(sb * sb) AS sbb FROM c1),
h AS (SELECT s.*, (sbb*ae - sab*be) AS ha, (saa*be - sab*ae) AS hb FROM s, w),
t AS (SELECT *, (ha*ay + hb*by_) / (ha*ae + hb*be) AS beta2, ha*ae + hb*be AS lhs FROM h),
c2 AS (SELECT sum((ha * a + hb * b) * (y - beta2 * e)) AS sc, any_value(lhs) AS lhs, any_value(beta2) AS beta2, any_value(n) AS n, any_value(k) AS k FROM m, t GROUP BY month)
SELECT 'l_endog' AS variable, round(any_value(beta2), 4) AS estimate, round(sqrt(sum(sc * sc) * (any_value(n) - 1) / (any_value(n) - 1 - any_value(k)) * count(*) / (count(*) - 1.0)) / abs(any_value(lhs)), 4) AS std_error FROM c2"""


@query(_GMM_SQL)
def iv_gmm2s(spark, sf_dir):
    return short(spark, _iv(spark, sf_dir, estimator="gmm2s", cluster="month", diagnostics=False))


@query(_IV_SQL + """, u AS (SELECT a, b, e, e - p1 * a - p2 * b AS v FROM m, s),
c AS (SELECT sum(a*a*e*e) AS l11, sum(a*b*e*e) AS l12, sum(b*b*e*e) AS l22, sum(a*a*v*v) AS w11, sum(a*b*v*v) AS w12, sum(b*b*v*v) AS w22 FROM u),
t AS (SELECT (l22*ae*ae - 2*l12*ae*be + l11*be*be) / (l11*l22 - l12*l12) AS lm, (w22*ae*ae - 2*w12*ae*be + w11*be*be) / (w11*w22 - w12*w12) AS wald, n, k FROM s, c)
SELECT 'lm' AS name, round(lm, 3) AS value FROM t UNION ALL SELECT 'wald', round(wald, 3) FROM t UNION ALL SELECT 'wald_f', round(wald / 2 * (n - 2 - k) / n, 3) FROM t
UNION ALL SELECT 'sw_f', round(wald / 2 * (n - 2 - k) / n, 3) FROM t UNION ALL SELECT 'size_10', 19.93""")
def iv_rank_tests(spark, sf_dir):
    r = _iv(spark, sf_dir, vce="robust")
    r.release()
    k = r.diagnostics["underidentification"]
    return named(spark, [("lm", k["lm"]["statistic"]), ("wald", k["wald"]["statistic"]), ("wald_f", k["wald"]["f"])] + [("sw_f", r.diagnostics["conditional"][0]["sw"]["f_robust"]), ("size_10", r.diagnostics["stock_yogo"]["maximal_iv_size"]["10%"])], 3)


# ---------------------------------------------------------------------------------------------------------- Poisson


def _counts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("v"), F.avg(F.dayofmonth("ts")).alias("d"), F.max("value").alias("m"))


def _irls_sql(instrument: str, meat: str, steps: int = 30) -> str:
    """Iteratively reweighted steps with one effect, unrolled: y on x with an instrument z (x itself without one)."""
    out = [f"""c AS (SELECT event_type AS g, count(*)::DOUBLE AS y, avg(value) AS x, {instrument} AS z FROM events GROUP BY user_id, event_type),
s0 AS (SELECT *, ln(greatest(0.5 * (y + avg(y) OVER ()), 0.05 * y, 1e-3)) AS eta FROM c)"""]
    for i in range(steps):
        out.append(f"""w{i} AS (SELECT *, exp(eta) AS mu, eta - 1 + y / exp(eta) AS r FROM s{i}),
m{i} AS (SELECT g, y, x, z, mu, r, sum(mu * r) OVER p / sum(mu) OVER p AS rb, sum(mu * x) OVER p / sum(mu) OVER p AS xb, sum(mu * z) OVER p / sum(mu) OVER p AS zb FROM w{i} WINDOW p AS (PARTITION BY g)),
b{i} AS (SELECT sum(mu * (z - zb) * (r - rb)) / sum(mu * (z - zb) * (x - xb)) AS b FROM m{i}),
s{i + 1} AS MATERIALIZED (SELECT g, y, x, z, rb + b * (x - xb) AS eta FROM m{i}, b{i})""")
    last = steps - 1
    return "WITH " + ",\n".join(out) + f"""
SELECT 'v' AS variable, round(any_value(b), 6) AS estimate, round(sqrt({meat}) / abs(sum(mu * (z - zb) * (x - xb))), 6) AS std_error FROM m{last}, b{last}"""


@query(_irls_sql("avg(value)", "sum(((x - xb) * (y - mu)) ^ 2) * count(*) / (count(*) - 1 - count(DISTINCT g))"))
def ppml_fe1(spark, sf_dir):
    return short(spark, poisson.ppmlhdfe(_counts(spark, sf_dir), y="n", x=["v"], absorb=["event_type"]), 6)


def _irls2_sql(steps: int = 10, sweeps: int = 10) -> str:
    """Steps with two effects: within each, working outcome and regressor are swept by either effect in turn."""
    out = ["""c AS (SELECT user_id AS u, event_type AS g, count(*)::DOUBLE AS y, avg(value) AS x FROM events GROUP BY 1, 2),
c1 AS (SELECT * FROM c WHERE u IN (SELECT u FROM c GROUP BY u HAVING count(*) > 1) AND g IN (SELECT g FROM c GROUP BY g HAVING count(*) > 1)),
s0 AS MATERIALIZED (SELECT *, ln(greatest(0.5 * (y + avg(y) OVER ()), 0.05 * y, 1e-3)) AS eta FROM c1)"""]
    for i in range(steps):
        out.append(f"m{i}_0 AS MATERIALIZED (SELECT u, g, y, x AS x0, exp(eta) AS mu, eta - 1 + y / exp(eta) AS r0, eta - 1 + y / exp(eta) AS r, x FROM s{i})")
        for k in range(sweeps):
            part = "ug"[k % 2]
            out.append(f"m{i}_{k + 1} AS MATERIALIZED (SELECT u, g, y, x0, mu, r0, r - sum(mu * r) OVER p / sum(mu) OVER p AS r, x - sum(mu * x) OVER p / sum(mu) OVER p AS x FROM m{i}_{k} WINDOW p AS (PARTITION BY {part}))")
        out.append(f"""b{i} AS MATERIALIZED (SELECT sum(mu * x * r) / sum(mu * x * x) AS b FROM m{i}_{sweeps}),
s{i + 1} AS MATERIALIZED (SELECT u, g, y, x0 AS x, r0 - (r - b * x) AS eta FROM m{i}_{sweeps}, b{i})""")
    at = f"m{steps - 1}_{sweeps}"
    return "WITH " + ",\n".join(out) + f""",
v AS (SELECT sum(x * (y - mu)) AS s, sum(mu * x * x) AS a, count(*) AS n, any_value(b) AS b FROM {at}, b{steps - 1} GROUP BY u)
SELECT 'v' AS variable, round(any_value(b), 6) AS estimate, round(sqrt(sum(s * s) * CLUSTERS) / sum(a), 6) AS std_error FROM v"""


@query(_irls2_sql().replace("CLUSTERS", "(sum(n) - 1) / (sum(n) - 1 - (SELECT count(DISTINCT g) FROM c1)) * count(*) / (count(*) - 1.0)"))
def ppml_fe2(spark, sf_dir):
    return short(spark, poisson.ppmlhdfe(_counts(spark, sf_dir), y="n", x=["v"], absorb=["user_id", "event_type"], cluster="user_id"), 6)


@query(_irls_sql("max(value)", "sum(((z - zb) * (y - mu)) ^ 2) * count(*) / (count(*) - 1.0)"))
def ivppml(spark, sf_dir):
    """The mean value, with the largest one as its instrument."""
    return short(spark, poisson.ivppmlhdfe(_counts(spark, sf_dir), y="n", endog=["v"], instruments=["m"], absorb=["event_type"]), 6)


@query("""WITH c AS (SELECT l_suppkey AS g, l_partkey AS h, CASE WHEN l_quantity > 48 THEN l_quantity ELSE 0 END AS y FROM lineitem),
c1 AS (SELECT * FROM c WHERE h IN (SELECT h FROM c GROUP BY h HAVING max(y) > 0) AND g IN (SELECT g FROM c GROUP BY g HAVING max(y) > 0)),
c2 AS (SELECT * FROM c1 WHERE h IN (SELECT h FROM c1 GROUP BY h HAVING max(y) > 0) AND g IN (SELECT g FROM c1 GROUP BY g HAVING max(y) > 0))
SELECT 'separated' AS name, ((SELECT count(*) FROM c) - count(*))::DOUBLE AS value FROM c2""")
def fe_separated(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("h"), F.when(F.col("l_quantity") > 48, F.col("l_quantity")).otherwise(0.0).alias("y"))
    return named(spark, [("separated", poisson.fe_separated(d, ["g", "h"])[1])])


# ------------------------------------------------------------------------------------------- design, checks, recovery


@query("""SELECT 'o_orderpriority[' || o_orderpriority || ']' AS name, count(*)::DOUBLE AS value FROM orders
WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) GROUP BY o_orderpriority""")
def factor_design(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols, _ = expanded(o, [factor("o_orderpriority")])
    row = o.agg(*(F.sum(c.column) for c in cols)).first()
    return named(spark, zip((c.name for c in cols), row, strict=True))


@query("""SELECT 'l_returnflag[' || l_returnflag || ']#l_discount' AS name, round(sum(l_discount), 3) AS value FROM lineitem WHERE l_returnflag <> (SELECT min(l_returnflag) FROM lineitem) GROUP BY l_returnflag
UNION ALL SELECT 'l_discount', round(sum(l_discount), 3) FROM lineitem
UNION ALL SELECT 'l_returnflag[' || l_returnflag || ']', count(*)::DOUBLE FROM lineitem WHERE l_returnflag <> (SELECT min(l_returnflag) FROM lineitem) GROUP BY l_returnflag""")
def factor_interaction(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    cols, _ = expanded(d, "i(l_returnflag)##c(l_discount)")
    return named(spark, zip((c.name for c in cols), d.agg(*(F.sum(c.column) for c in cols)).first(), strict=True), 3)


@query("""WITH m AS (SELECT c_nationkey AS g, c_acctbal AS y, length(c_name)::DOUBLE + c_custkey % 7 AS x FROM customer),
d AS (SELECT g, y, x, y - avg(y) OVER (PARTITION BY g) AS yd, x - avg(x) OVER (PARTITION BY g) AS xd FROM m), b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b FROM d)
SELECT 'c_nationkey' AS term, g::VARCHAR AS level, round(avg(y) - any_value(b) * avg(x), 4) AS coef, count(*)::DOUBLE AS mass FROM d, b GROUP BY g""")
def fe_recover_oneway(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("x", F.length("c_name") + F.col("c_custkey") % 7)
    r = linear.olshdfe(c, y="c_acctbal", x=["x"], absorb=["c_nationkey"])
    return effects.recover(r).select("term", "level", F.round("coef", 4).alias("coef"), "mass")


def _recovery_sql(n: int = 60) -> str:
    """Cells' means, then each effect's mean given the other's, in turn."""
    out = ["c AS (SELECT c_nationkey AS g, c_mktsegment AS h, avg(c_acctbal) AS y, count(*) AS n FROM customer GROUP BY 1, 2)", "a0 AS (SELECT g, h, y, n, 0.0::DOUBLE AS b FROM c)"]
    for i in range(n):
        out.append(f"""d{i} AS MATERIALIZED (SELECT g, h, y, n, sum(n * (y - b)) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS a FROM a{i}),
a{i + 1} AS MATERIALIZED (SELECT g, h, y, n, a, sum(n * (y - a)) OVER (PARTITION BY h) / sum(n) OVER (PARTITION BY h) AS b FROM d{i})""")
    return "WITH " + ",\n".join(out) + f""", z AS (SELECT avg(b) AS shift FROM (SELECT h, any_value(b) AS b FROM a{n} GROUP BY h))
SELECT 'c_nationkey' AS term, g::VARCHAR AS level, round(any_value(a) + any_value(shift), 4) AS coef, 0::BIGINT AS component, true AS identified FROM a{n}, z GROUP BY g
UNION ALL SELECT 'c_mktsegment', h, round(any_value(b) - any_value(shift), 4), 0::BIGINT, true FROM a{n}, z GROUP BY h"""


@query(_recovery_sql())
def fe_recover_twoway(spark, sf_dir):
    r = linear.olshdfe(table(spark, sf_dir, "customer"), y="c_acctbal", absorb=["c_nationkey", "c_mktsegment"])
    return effects.recover(r).select("term", "level", F.round("coef", 4).alias("coef"), "component", "identified")


@query("""SELECT 'l_suppkey' AS variable, count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(stddev_pop(n) / avg(n), 6) AS cv, round(max(n) / sum(n), 6) AS share, round(sum(n) ^ 2 / sum(n * n), 4) AS effective
FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey)""".replace("min(n) AS smallest", "min(n)::BIGINT AS smallest").replace("max(n) AS largest", "max(n)::BIGINT AS largest"))
def cluster_diagnostics(spark, sf_dir):
    d = resampling.cluster_diagnostics(table(spark, sf_dir, "lineitem"), ["l_suppkey"])[0]
    row = (d["variable"], d["clusters"], d["min"], d["max"], round(d["cv"], 6), round(d["largest_share"], 6), round(d["effective"], 4))
    return spark.createDataFrame([row], "variable string, clusters long, smallest long, largest long, cv double, share double, effective double")


@query("SELECT 'few_clusters' AS code, 'l_returnflag' AS \"column\", 'warning' AS severity UNION ALL SELECT 'missing_column', 'nowhere', 'error' UNION ALL SELECT 'non_numeric', 'l_linestatus', 'error'")
def preflight(spark, sf_dir):
    need = data_requirements(y="l_extendedprice", x=["l_quantity", "l_linestatus", "nowhere"], absorb=["l_suppkey"], cluster=["l_returnflag"])
    found = sources.preflight(table(spark, sf_dir, "lineitem"), need, level="strict")
    return spark.createDataFrame([(i.code, i.column, i.severity) for i in found], "code string, column string, severity string")


@query("SELECT c_mktsegment AS level, count(*) AS n, (row_number() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM customer GROUP BY c_mktsegment")
def identifier_encode(spark, sf_dir):
    return sources.encoded(table(spark, sf_dir, "customer"), "c_mktsegment")[1].select("level", "n", "code")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey")
def model_data(spark, sf_dir):
    """A specification's columns, projected before anything else."""
    d = sources.materialize_model_data(spark, f"{sf_dir}/lineitem.parquet", y="l_quantity", absorb=["l_suppkey"])
    return d.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(se_sql("any_value(a) * sum(u * u) / (any_value(n) - 1 - any_value(k))"))
def session_ols(spark, sf_dir):
    spec = sessions.OLSSpec("l_extendedprice", ("l_quantity",), ("l_suppkey",))
    s = sessions.Session(items(spark, sf_dir), [spec, sessions.OLSSpec("l_extendedprice", ("l_discount",), ("l_suppkey",))])
    return short(spark, s.fit(spec))


#: Without the hypothesis' effect, residuals are y within; all signs of the three clusters are draws.
@query(within_sql() + """, c AS (SELECT sum(s) AS s FROM e GROUP BY l_returnflag), o AS (SELECT any_value(b) AS b, any_value(a) AS a, any_value(n)::DOUBLE AS n, any_value(k) AS k FROM e),
l AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS j FROM e GROUP BY l_returnflag),
d AS (SELECT range AS d FROM range(8)),
r AS (SELECT d.d, g, l_returnflag, x, y * (((d.d >> l.j::BIGINT) & 1) * 2 - 1) AS y FROM e JOIN l USING (l_returnflag), d),
i AS (SELECT d, l_returnflag, x, y - avg(y) OVER (PARTITION BY d, g) AS y FROM r),
j AS (SELECT d, sum(x * y) / sum(x * x) AS b FROM i GROUP BY d),
q AS (SELECT d, any_value(b) AS b, sum(x * (y - b * x)) AS s FROM i JOIN j USING (d) GROUP BY d, l_returnflag),
f AS (SELECT (n - 1) / (n - 1 - k) * 3 / 2 * a * a AS f FROM o),
t AS (SELECT o.b / sqrt(f * (SELECT sum(s * s) FROM c)) AS t FROM o, f),
w AS (SELECT d, any_value(b) / sqrt(any_value(f) * sum(s * s)) AS t FROM q, f GROUP BY d)
SELECT 'statistic' AS name, round(t, 5) AS value FROM t UNION ALL SELECT 'pvalue', round(avg(CASE WHEN abs(w.t) >= abs(t.t) - 1e-9 THEN 1.0 ELSE 0.0 END), 5) FROM w, t
UNION ALL SELECT 'clusters', count(*)::DOUBLE FROM l UNION ALL SELECT 'draws', count(*)::DOUBLE FROM w""")
def wild_cluster(spark, sf_dir):
    r = _ols1(spark, sf_dir, cluster="l_returnflag")
    t = resampling.wild_cluster_test(r, param="l_quantity", reps=999)
    r.release()
    return named(spark, [("statistic", t.statistic), ("pvalue", t.pvalue), ("clusters", t.clusters), ("draws", len(t.draws))])


_MAP_SWEEPS = ["s0 AS (SELECT c_nationkey AS g, c_mktsegment AS h, c_acctbal AS y, (c_custkey % 7)::DOUBLE AS x FROM customer)"] + [
    f"s{i + 1} AS MATERIALIZED (SELECT g, h, y - avg(y) OVER (PARTITION BY {'gh'[i % 2]}) AS y, x - avg(x) OVER (PARTITION BY {'gh'[i % 2]}) AS x FROM s{i})" for i in range(60)
]


@query("WITH " + ",\n".join(_MAP_SWEEPS) + """, b AS (SELECT sum(x * y) / sum(x * x) AS b, 1 / sum(x * x) AS a, count(*) AS n, count(DISTINCT g) + count(DISTINCT h) - 1 AS k FROM s60)
SELECT 'x' AS variable, round(any_value(b), 4) AS estimate, round(sqrt(any_value(a) * sum((y - b.b * x) ^ 2) / (any_value(n) - 1 - any_value(k))), 4) AS std_error FROM s60, b""")
def ols_map_solver(spark, sf_dir):
    """Alternating projections on the cluster, as for data that the driver can't hold."""
    r = linear.olshdfe(table(spark, sf_dir, "customer").withColumn("x", F.col("c_custkey") % 7), y="c_acctbal", x=["x"], absorb=["c_nationkey", "c_mktsegment"], config=HDFEConfig(solver="map", tolerance=1e-7))
    return short(spark, r)


def _separation_sql(steps: int = 30) -> str:
    """Rows with v above 60 have y = 0 and z > 0 and go; z is zero on all others and is dropped."""
    fit = _irls_sql("0.0", "1.0", steps).partition("\nSELECT 'v'")[0]
    fit = fit.replace("avg(value) AS x, 0.0 AS z FROM events GROUP BY user_id, event_type)", "avg(day(ts)) AS x, avg(day(ts)) AS z, avg(value) AS v FROM events GROUP BY user_id, event_type HAVING avg(value) <= 60)")
    return fit + f"""
SELECT 'nobs' AS name, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'separated', count(*)::DOUBLE FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING avg(value) > 60) UNION ALL SELECT 'd', round(b, 4) FROM b{steps - 1}"""


@query(_separation_sql())
def ppml_separation(spark, sf_dir):
    """A regressor that is positive only where the outcome is zero."""
    d = _counts(spark, sf_dir).withColumn("y", F.when(F.col("v") > 60, 0.0).otherwise(F.col("n"))).withColumn("z", F.when(F.col("v") > 60, F.col("v") - 60).otherwise(0.0))
    r = poisson.ppmlhdfe(d, y="y", x=["d", "z"], absorb=["event_type"], collinearity="drop", config=PPMLConfig())
    r.release()
    return named(spark, [("nobs", r.n), ("separated", r.stats["separated"]), *r.params.items()], 4)
