"""Line deduplication by how many sites a line is on: sketches for all lines, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


def normal(line: Column) -> Column:
    """A line as it is compared: trimmed of ASCII white space, A-Z and other letters in lower case."""
    return F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line, site) for each line that isn't blank; line and doc are hashes."""
    text = F.coalesce("text", F.lit(""))
    at = docs.select(F.xxhash64("doc_id", "source", "text").alias("doc"), "doc_id", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    at = at.withColumn("n", normal(F.col("raw"))).where("n <> ''")
    # Two hashes of the line: 128 bits name it.
    return at.select("doc", "doc_id", "site", "pos", F.xxhash64("n").alias("line"), F.xxhash64(F.lit(7), F.col("n")).alias("line2"))


def line_deduped(docs: DataFrame, least_sites: int = 5, deviation: float = 0.1, hot_share: int = 10_000) -> DataFrame:
    """docs with each line that stands on least_sites sites or more left only where it stands first; the input's columns and n_lines, n_removed.

    docs: doc_id, text, source (the site) and any others, whatever their names (columns n_lines and n_removed are replaced).
    A line is what stands between newlines; lines compare trimmed and
    in lower case; blank lines are never removed. A null source is one site. A line's first place is the one with the
    smallest (doc_id, hash of the row, position), a null doc_id last. Rows are never dropped: a null text stays null with
    0 lines; a text may become blank. Rows that are equal in doc_id, source and text get equal results. An empty table gives
    an empty result. Texts without a removed line come back unchanged, byte for byte.

    One aggregation gives each line a HyperLogLog sketch of its sites (merged from the tasks' partial sketches), and its
    smallest and largest site. Lines of one site need no more. While few registers are hit, an estimate never exceeds the
    number of sites (hits can only collide), so an estimate of least_sites or more is proof there for small thresholds;
    every other line with at least two sites is near the threshold and gets an exact distinct count, as do all lines when
    least_sites is over 8. Lines so common that one key would be much work (more than 1/hot_share of all lines) are at most
    hot_share many and are broadcast; the others are joined by key.
    """
    if least_sites < 2:
        raise ValueError("least_sites must be 2 or more")
    key = ["line", "line2"]
    lines = _lines(docs)
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "doc", "pos")
    stats = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("site", deviation).alias("est"), F.min("site").alias("lo"), F.max("site").alias("hi"), F.min(first).alias("first"))
    several = written(stats.where("n > 1 and lo <> hi"))
    sure = F.col("est") >= least_sites if least_sites <= 8 else F.lit(False)
    total = several.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * hot_share > max(total, 1)

    def dealt(marks):
        """lines, left joined with a broadcast of hot lines' marks; k and k2 are the keys of cold lines, and for each hot row a key of its own that no cold line has."""
        got = lines.join(F.broadcast(marks), key, "left")
        return got.withColumn("k", F.when(F.col("hot").isNull(), F.col("line")).otherwise(F.xxhash64("doc", "pos"))).withColumn("k2", F.when(F.col("hot").isNull(), F.col("line2")))

    doubtful = several.where(~sure)
    cold = doubtful.where(~hot).select(F.col("line").alias("k"), F.col("line2").alias("k2"), F.lit(True).alias("cold"))
    asked = dealt(doubtful.where(hot).select(*key, F.lit(True).alias("hot"))).join(cold, ["k", "k2"], "left").where("hot or cold")
    # Sites of a line are made distinct before its rows meet.
    exact = asked.select(*key, "site").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= least_sites)
    spread = written(several.where(sure).select(*key, "n", "first").unionByName(several.join(exact.select(*key), key).select(*key, "n", "first")))

    known = dealt(spread.where(hot).select(*key, F.col("first").alias("hot")))
    cold = spread.where(~hot).select(F.col("line").alias("k"), F.col("line2").alias("k2"), "first")
    gone = known.join(cold, ["k", "k2"], "left").select("doc", "pos", F.coalesce("hot", "first").alias("first")).where("first is not null")
    gone = gone.where((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    gone = gone.groupBy("doc").agg(F.collect_set("pos").alias("gone"))

    # The input's columns travel as one, so that none of their names can clash with those used here.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = docs.select(whole, F.xxhash64("doc_id", "source", "text").alias("doc")).join(gone, "doc", "left")
    text = F.col("row").getField("text")
    parts = F.split(text, "\n", -1)
    left = F.concat_ws("\n", F.filter(parts, lambda x, i: ~F.array_contains("gone", i)))
    n_lines, n_removed = F.when(text.isNull(), 0).otherwise(F.size(parts)), F.coalesce(F.size("gone"), F.lit(0))
    cut = F.when(F.col("gone").isNull(), text).otherwise(left).alias("text")
    rest = (cut if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed"))
    return kept.select(*rest, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_deduped(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: %s: a table of documents, and the least number of sites.
KEPT_SQL = """
ln AS (
  SELECT doc_id, source, i - 1 AS pos, parts[i] AS raw, lower(regexp_replace(parts[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')) AS n
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}) d, unnest(range(1, len(parts) + 1)) t(i)
), spread AS (
  SELECT n, min((doc_id * 1000000 + pos)::HUGEINT) AS first FROM ln WHERE n <> ''
  GROUP BY n HAVING count(DISTINCT coalesce(source, '')) + 0 >= {sites}
), marked AS (
  SELECT ln.doc_id, ln.pos, ln.raw, (s.n IS NOT NULL AND (ln.doc_id * 1000000 + ln.pos)::HUGEINT <> s.first) AS gone
  FROM ln LEFT JOIN spread s ON ln.n = s.n
), left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)"""

OP7_SQL = "WITH " + KEPT_SQL.format(docs="documents", sites=5) + """
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5 FROM left_over
"""
