"""Hand-worked cases and properties of the scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omicsgraph.functions import scalars as S


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_region_id(spark):
    r = S.parse_region_id(F.col("r"), strict=False)
    got = values(spark, r, [("Chr1:500-100",), (" Chr2:1-9 ",), ("chr1:1-2",), (None,)], "r string")
    assert [tuple(x) if x else None for x in got] == [("Chr1", 100, 500), ("Chr2", 1, 9), None, None]
    with pytest.raises(Exception, match="not a region id"):
        values(spark, S.parse_region_id(F.col("r")), [("x",)], "r string")


def test_canonical_chrom(spark):
    got = values(spark, S.canonical_chrom(F.col("c")), [(x,) for x in ("Chr01", "chrM", "ChrC", "2", "Chr5a", "000", "Mito")], "c string")
    assert got == ["1", "MT", "PT", "2", "5A", "0", "MT"]


def test_window_id(spark):
    ids = ["Chr2:4990-5030", "Chr2:2000-2000", "Chr2:2001-2001"]
    assert values(spark, S.window_id(F.col("r")), [(x,) for x in ids], "r string") == ["Chr2:4001-8000", "Chr2:1-4000", "Chr2:2001-6000"]


def test_pad_and_windows(spark):
    got = values(spark, S.pad_or_center_truncate(F.col("s"), F.col("n")), [("ACGTA", 2), ("ACGT", 3), ("ACGTA", 4), ("AC", 5), ("ac", 0), (None, 2)], "s string, n int")
    assert got == ["CG", "CGT", "ACGT", "NACNN", "AC", "NN"]
    assert values(spark, S.split_windows(F.col("s"), 4, 3), [("ABCDEFGHIJ",), ("",), ("abc",)], "s string") == [["ABCD", "DEFG", "GHIJ"], [], ["ABC"]]
    assert values(spark, S.split_windows(F.col("s"), 4, 4), [("ABCDEFGHIJ",)], "s string") == [["ABCD", "EFGH", "GHIJ"]]


def test_locus_id(spark):
    c = S.extract_locus_id(F.col("a"), F.col("b"), F.col("c"))
    assert values(spark, c, [("locus:1", "at1g01010.1", "X|AT2G00001"), ("x", None, ""), (None, None, "y AT5G12345x")], "a string, b string, c string") == ["AT1G01010", None, "AT5G12345"]


def test_genotypes_and_scores(spark):
    rows = [(0, 0), (0, 1), (1, 1), (-1, -1), (-1, 1), (1, 2), (2, 2), (None, 1)]
    assert values(spark, S.carries_alt(F.col("a"), F.col("b")), rows, "a int, b int") == [False, True, True, False, False, True, False, False]
    assert values(spark, S.is_snp(F.col("r"), F.col("a")), [("A", ["T", "GG"]), ("AC", ["T"]), ("A", []), (None, None)], "r string, a array<string>") == [True, False, False, False]
    assert values(spark, S.ppi_normalize(F.col("s"), "divide_1000"), [(150.0,)], "s double") == [0.15]
    assert math.isclose(values(spark, S.ppi_normalize(F.col("s"), "log1p"), [(150.0,)], "s double")[0], 0.726221, abs_tol=1e-6)
    assert values(spark, S.to_double(F.col("s")), [("0.5",), ("abc",), ("1d",), (" 1e3 ",), (None,)], "s string") == [0.5, None, None, 1000.0, None]
    assert values(spark, S.safe_sample_id(F.col("s")), [("a b/c.é-1",)], "s string") == ["a_b_c.é-1"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTNRYacgt", max_size=40), st.integers(1, 50)), min_size=1, max_size=20))
def test_sequence_properties(spark, rows):
    df = spark.createDataFrame(rows, "s string, n int")
    for r in df.select("s", "n", S.reverse_complement(S.reverse_complement(F.col("s"))).alias("twice"), S.pad_or_center_truncate(F.col("s"), F.col("n")).alias("p"), S.split_windows(F.col("s"), 7, 3).alias("w")).collect():
        assert r.twice == r.s
        assert len(r.p) == r.n
        assert not r.s or (r.s.upper().endswith(r.w[-1]) and r.s.upper().startswith(r.w[0]))
