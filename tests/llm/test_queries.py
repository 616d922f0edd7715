"""The registered queries against their SQL."""

import duckdb
import pytest

from tideclock.llm import queries as L

TABLES = "documents pages benchmark labels conversations".split()


def test_registry():
    import __spark_entry__ as entry

    assert set(L.QUERIES) <= set(entry.queries()) and set(L.ORACLE) <= set(entry.oracle_sql())
    assert {n.split("_")[0] for n in L.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(L.ORACLE))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(L.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = L.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
