"""Sources/sinks round trips (S2, S4-S6), schema selection (P10), encoders (E1, E2), I10 floor."""

import tempfile

import pytest

from pyspark.sql import functions as F

from tabwright.functions import columns as C
from tabwright.operators import encode, filters, knn
from tabwright.sources import io


def test_semicolon_csv_with_bom_and_decimal_comma(spark):
    d = tempfile.mkdtemp(prefix="tw-io-")
    path = f"{d}/rates.csv"
    with open(path, "w", encoding="utf-8-sig") as fh:
        fh.write("Complex;Mutatiegraad\n1001;0,027\n1002;0,822\n1003;0,1\n")
    df = io.read_delimited(spark, path, sep=";", schema="Complex int, Mutatiegraad string")
    assert df.columns == ["Complex", "Mutatiegraad"]
    got = {r["Complex"]: r["rate"] for r in df.select("Complex", C.parse_decimal("Mutatiegraad").alias("rate")).collect()}
    assert got == {1001: 0.027, 1002: 0.822, 1003: 0.1}
    inferred = io.read_delimited(spark, path, sep=";")
    assert inferred.columns[0] == "Complex"


def test_write_read_round_trip_and_stage(spark):
    d = tempfile.mkdtemp(prefix="tw-io-")
    df = spark.createDataFrame([(1, 1.5, "a"), (2, float("nan"), None)], "id int, x double, s string")
    io.write_table(df, f"{d}/t_csv", fmt="csv")
    back = io.read_table(spark, f"{d}/t_csv", fmt="csv", schema="id int, x double, s string")
    rows = sorted(back.collect())
    assert rows[0]["x"] == 1.5 and rows[1]["x"] is None  # NaN written as missing
    staged = io.materialize_stage(df, f"{d}/stage")
    assert staged.count() == 2 and staged.schema["x"].dataType.simpleString() == "double"


def test_partitioned_splits(spark):
    d = tempfile.mkdtemp(prefix="tw-io-")
    df = spark.createDataFrame([(i, "random" if i % 2 else "ordered", ["train", "val", "test"][i % 3]) for i in range(30)],
                               "id int, scheme string, split string")
    io.write_splits(df, f"{d}/splits")
    part = io.read_split(spark, f"{d}/splits", "random", "val")
    assert sorted(r["id"] for r in part.collect()) == [i for i in range(30) if i % 2 and i % 3 == 1]
    assert "PartitionFilters" in part._jdf.queryExecution().executedPlan().toString()


def test_select_by_type(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean") \
        .withColumn("t", F.current_timestamp())
    assert filters.select_by_type(df, "number") == ["a", "b"]
    assert filters.select_by_type(df, "string") == ["c"]
    assert filters.select_by_type(df, "timestamp") == ["t"]


def test_drop_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 5, None)], "a int, b int, c int")
    assert filters.drop_sparse_columns(df, 60.0).columns == ["a"]
    assert filters.drop_sparse_columns(df, 70.0).columns == ["a", "b", "c"]


def test_label_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, s string")
    enc, model = encode.label_encode(df, "s", "code")
    got = {r["id"]: r["code"] for r in enc.collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: 2}
    dec = {r["id"]: r["back"] for r in encode.label_decode(enc.where("code is not null"), model, "code", "back").collect()}
    assert dec == {1: "b", 2: "a", 4: "c"}


def test_one_hot_fit_on_one_apply_to_other(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    other = spark.createDataFrame([("b",), ("z",), (None,)], "s string")
    enc = encode.OneHotWide(["s"]).fit(train)
    assert enc.output_columns() == ["s_b", "s_c"]
    rows = enc.transform(other).collect()
    assert [(r["s_b"], r["s_c"]) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_knn_categorical_floor_vs_nearest(spark):
    rows = [(1, "a", 0.0), (2, "b", 0.1), (3, "b", 0.11), (4, "c", 10.0), (5, None, 0.06)]
    df = spark.createDataFrame(rows, "id long, t string, f double")
    # the 3 nearest of 0.06 are a, b, b: mean code 2/3 -> nearest 1 ('b'), floor 0 ('a')
    near = {r["id"]: r["t"] for r in knn.knn_impute_categorical(df, "id", "t", ["f"], k=3, rounding="nearest").collect()}
    flo = {r["id"]: r["t"] for r in knn.knn_impute_categorical(df, "id", "t", ["f"], k=3, rounding="floor").collect()}
    assert near[5] == "b" and flo[5] == "a"
    assert all(near[i] == t for i, t, _ in rows[:4])


def test_level_lists_refuse_identifier_columns(spark):
    from tabwright.operators.encode import OneHotWide, level_lists
    df = spark.range(0, 3000).select((F.col("id") % 3).cast("string").alias("c"), F.col("id").alias("k"))
    assert level_lists(df, ["c"]) == {"c": ["0", "1", "2"]}
    with pytest.raises(ValueError, match="too many levels"):
        level_lists(df, ["k"], max_levels=100)
    with pytest.raises(ValueError, match="too many levels"):
        OneHotWide(["c", "k"], max_levels=100).fit(df)


def test_level_lists_read_the_rows_once(spark):
    """Columns of several types, with nulls and repeated names of values, share one pass over the input."""
    from tabwright.operators.encode import level_lists
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    df = spark.range(0, 900, 1, 3).selectExpr("if(id % 3 = 0, null, id % 3) as a", "string(id % 2) as b", "id % 2 as c", "string(null) as e") \
        .mapInArrow(seen, "a long, b string, c long, e string")
    assert level_lists(df, ["a", "b", "c", "e"]) == {"a": [1, 2], "b": ["0", "1"], "c": [0, 1], "e": []}
    assert reads.value == 900 and level_lists(df, []) == {}
