"""Every query of the graph library against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from omicsgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows == sorted(tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "set_name"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
