import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["log_debias", "confusion_metrics", "keyword_flags", "affiliation_split", "topk_per_group", "profile_summary"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(map(tuple, got.select(*columns).collect())) == key(want.select(*columns).fetchall())
