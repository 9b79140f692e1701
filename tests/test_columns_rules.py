"""Null / NaN / sentinel edge cases (FIXTURES F9) for expressions and rules."""


import pytest
from pyspark.sql import functions as F

from tabwright.functions import columns as C
from tabwright.operators import filters, impute, joins, profile


def test_nan_and_null_matrix(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 4.0), (4, -0.0), (5, 0.0)], "id int, x double")
    clean = C.nan_to_null(df)
    assert {r["id"] for r in clean.where("x is null").collect()} == {1, 2}
    flags = impute.add_flags(clean, {"pos": F.col("x") > 3, "zero": F.col("x") == 0}).orderBy("id").collect()
    assert [r["pos"] for r in flags] == [0, 0, 1, 0, 0]
    assert [r["zero"] for r in flags] == [0, 0, 0, 1, 1]
    nulled = df.select("id", C.null_out("x", [0.0]).alias("x")).orderBy("id").collect()
    assert nulled[3]["x"] is None and nulled[4]["x"] is None


def test_complement_split_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 2005), (2, 2012), (3, None)], "id int, y int")
    yes, rest = filters.split_by(df, F.col("y") < 2010)
    assert {r["id"] for r in yes.collect()} == {1}
    assert {r["id"] for r in rest.collect()} == {2, 3}


def test_coercions(spark):
    df = spark.createDataFrame([("12",), ("x1",), (" ",), (None,)], "s string")
    got = [r["n"] for r in df.select(C.coerce_numeric("s", "bigint", 0).alias("n")).collect()]
    assert got == [12, 0, 0, 0]
    d = spark.createDataFrame([("2020-01-31",), ("2020-02-30",), ("9999-12-31",), ("junk",)], "s string")
    years = [r["y"] for r in d.select(F.year(C.coerce_timestamp("s")).alias("y")).collect()]
    assert years == [2020, None, 9999, None]
    p = spark.createDataFrame([("0,027",), ("0,822",), ("",)], "s string")
    assert [r["v"] for r in p.select(C.parse_decimal("s").alias("v")).collect()] == [0.027, 0.822, None]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(a,) for a in [17, 18, 19, 99, 100, None]], "age int")
    b, lab = C.bucketize("age", 18, 100, 2)
    got = [(r["b"], r["l"]) for r in df.select(b.alias("b"), lab.alias("l")).collect()]
    assert got == [(None, None), (0, "18-19"), (0, "18-19"), (40, "98-99"), (None, None), (None, None)]


def test_rounding_is_half_even_on_binary(spark):
    import numpy as np
    vals = [0.125, 0.135, 2.675, 550.055, -1.005, 1234.565]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["r"] for r in df.select(C.round_half_even("x", 2).alias("r")).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    txt = [r["t"] for r in df.select(C.to_fixed("x", 2, as_text=True).alias("t")).collect()]
    assert txt == [f"{np.round(v, 2):.2f}" for v in vals]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (4.0, 2.0)], "a double, b double")
    assert [r["q"] for r in df.select(C.safe_div("a", "b", 0.0).alias("q")).collect()] == [0.0, 0.0, 2.0]


def test_fill_rules_only_touch_missing(spark):
    df = spark.createDataFrame([(1, None, "HOUSEHOLD"), (2, "X", "HOUSEHOLD"), (3, None, "OTHER")],
                               "id int, t string, kind string")
    out = impute.fill_when(df, "t", [(F.col("kind") == "HOUSEHOLD", "H")]).orderBy("id").collect()
    assert [r["t"] for r in out] == ["H", "X", None]
    ff = impute.flag_and_fill(df, {"t": "N.v.t."}).orderBy("id").collect()
    assert [(r["t"], r["t_missing"]) for r in ff] == [("N.v.t.", 1), ("X", 0), ("N.v.t.", 1)]


def test_lookup_rejects_duplicate_keys(spark):
    with pytest.raises(ValueError):
        C.lookup("x", _DupDict())


class _DupDict(dict):
    def keys(self):
        return ["a", "a"]

    def items(self):
        return [("a", 1), ("a", 2)]


def test_null_safe_join_matches_null_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "k")], "id int, key string")
    dim = spark.createDataFrame([(None, 10), ("k", 20)], "dkey string, v int")
    plain = {r["id"]: r["v"] for r in joins.enrich(left, dim, on=[("key", "dkey")]).collect()}
    safe = {r["id"]: r["v"] for r in joins.enrich(left, dim, on=[("key", "dkey")], null_safe=True).collect()}
    assert plain == {1: None, 2: 20}
    assert safe == {1: 10, 2: 20}


def test_suffixes_on_collision(spark):
    a = spark.createDataFrame([(1, 1.0)], "id int, rate double")
    b = spark.createDataFrame([(1, 2.0)], "rid int, rate double")
    out = joins.enrich(a, b, on=[("id", "rid")])
    assert set(out.columns) == {"id", "rid", "rate_x", "rate_y"}


def test_profile_constant_column_corr_is_null(spark):
    from tabwright.operators import assoc
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "c double, y int")
    assert assoc.corr_with_label(df, "y", ["c"]).first()["corr"] is None


def test_shape_stats_bias_corrected(spark):
    vals = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.shape_stats(df, ["x"]).first()
    # Bias-corrected skewness and excess kurtosis of (1, 2, 4, 9).
    assert r["skew"] == pytest.approx(1.3309377322476703)
    assert r["kurt"] == pytest.approx(1.5, abs=1e-9)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r["bin"]: r["n"] for r in profile.histogram(df, "x", bins=5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
