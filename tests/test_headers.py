"""Flattened headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import grids


def test_flatten_header_makes_each_value_once(spark):
    """Names of a wide header: repeats numbered, empty ones by place; the letters of a cell are looked up by one expression, not by one for each use."""
    wide = [[["A b"] * 40 + ["", "Ç d", "", "a B"], ["A b"] * 40 + ["", "", "x", "a B"]]]
    df = spark.createDataFrame([(g, 2) for g in wide] + [(None, 1), ([], 1), ([["a"]], 0)], "g array<array<string>>, n int").select(grids.flatten_header(F.col("g"), F.col("n")).alias("names"))
    got = [r[0] for r in df.collect()]
    assert got == [["a_b", *(f"a_b_{i}" for i in range(2, 41)), "col_40", "c_d", "x", "a_b_41"], [], [], ["col_0"]]
    assert df._jdf.queryExecution().analyzed().toString().count("translate(") == 1
