import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 90


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "file_path", "size"]
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["c18_near", "a13_directory_rollup", "d6_tokens", "w4_history_dedupe"])
def test_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    twin = con.sql(entry.oracle_sql()[name])
    order = [twin.columns.index(c) for c in df.columns]
    plain = lambda rows: sorted(repr([str(v) for v in r]) for r in rows)
    assert plain(df.collect()) == plain([[r[i] for i in order] for r in twin.fetchall()])
