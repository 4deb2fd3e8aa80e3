import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["flagship", "pricing_summary", "group_changelog_max", "lookup_pipeline", "merge_merge"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in df.select(*cols).collect())
