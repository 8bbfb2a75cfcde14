import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = ("ols_fe1_cluster", "ols_driscoll_kraay", "wls_pweight", "iv_diagnostics", "singletons", "factor_interaction", "fe_recover_oneway", "preflight", "iv_liml", "iv_gmm2s", "iv_rank_tests", "wild_cluster", "fe_recover_twoway", "dof_exact")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: d[cols].astype(str).sort_values(cols).to_numpy().tolist()
    assert key(got) == key(want)
