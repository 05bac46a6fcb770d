"""Queries against their SQL on tables with keys of six digits: ids keep five of them, so genes share ids in pairs."""

import os

import duckdb
import pytest
from test_queries import SF, TABLES, plain

from omicsgraph.queries import ORACLE_SQL, QUERIES

NAMES = ["a18_go_counts", "a19_hypergeom_sf", "a20_go_enrichment", "j1_build_loci", "j17_add_go_names", "t3_top_terms"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("six_digits")
    c = duckdb.connect()
    for t in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        if key:
            c.sql(f"copy (select * replace ({key}+100000 as {key}) from '{SF}/{t}.parquet') to '{out}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    expected = sorted(tuple(plain(dict(zip(want.columns, r))[k]) for k in columns) for r in want.fetchall())
    assert expected and sorted(tuple(plain(r[k]) for k in columns) for r in df.collect()) == expected
