"""Every registered query with oracle SQL agrees with DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.check_oracle import _rows

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert {"capture_id", "status", "details", "flows_analyzed"} <= set(df.columns)
