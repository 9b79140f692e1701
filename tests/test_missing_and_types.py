"""NaN as missing, id types, level counts, parameter names: rules that the driver's tables do not show."""

import math

import pytest
from pyspark.sql import functions as F

from tabwright.operators import encode, filters, groups, knn, ml, profile

NAN = float("nan")


def values(spark):
    return spark.createDataFrame([(1, 1.0, 5.0), (2, NAN, 5.0), (3, 2.0, 5.0), (4, None, 5.0), (5, 6.0, NAN)], "id int, v double, c double")


def test_describe_ignores_nan(spark):
    r = profile.describe(values(spark), ["v"]).first()
    assert (r["count"], r["mean"], r["min"], r["max"], r["p50"]) == (3, 3.0, 1.0, 6.0, 2.0)
    assert r["std"] == pytest.approx(math.sqrt(7))


def test_shape_of_a_constant_column_is_zero(spark):
    r = profile.shape_stats(values(spark), ["c"]).first()
    assert (r["skew"], r["kurt"]) == (0.0, 0.0)


def test_zscore_histogram_and_kde_ignore_nan(spark):
    z = {r["id"]: r["v_z"] for r in profile.zscore(values(spark), ["v"]).collect()}
    assert z[2] is None and z[1] == pytest.approx(-2 / math.sqrt(7))
    h = profile.histogram(values(spark), "v", bins=5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 1, 0, 0, 1] and h[0]["bin_lo"] == 1.0 and h[-1]["bin_hi"] == pytest.approx(6.0)
    assert all(math.isfinite(r["density"]) for r in profile.kde(values(spark), "v", 5).collect())
    box = profile.box_stats(values(spark), "v").first()
    assert (box["n"], box["median"]) == (3, 2.0)


def test_sparse_columns_count_nan(spark):
    assert filters.null_shares(values(spark), ["v", "id"]).first().asDict() == {"v": 0.4, "id": 0.0}


def test_null_keys_get_no_group_statistic(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 7.0)], "k string, v double")
    got = sorted(((r["k"] or "", r["v"]), r["m"]) for r in groups.group_mean(df, "k", "v", "m").collect())
    assert got == [(("", 1.0), None), (("", 3.0), None), (("a", 5.0), 6.0), (("a", 7.0), 6.0)]


def test_conditional_distinct_counts(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("b", 3, None), ("b", None, "x")]
    df = spark.createDataFrame(rows, "k string, v int, lab string")
    out = groups.group_nunique_if(df, "k", "v", {"n": F.lit(True), "nx": F.col("lab") == "x", "ny": F.col("lab") == "y"})
    assert {(r["k"], r["n"], r["nx"], r["ny"]) for r in out.collect()} == {("a", 2, 1, 2), ("b", 1, 0, 0)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_many_levels_encode_and_unseen_ones_do_not(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("level"), F.col("id").cast("string")).alias("s"))
    enc, codes = encode.label_encode(df, "s", "code")
    r = enc.agg(F.count_distinct("code"), F.min("code"), F.max("code")).first()
    assert tuple(r) == (50_000, 0, 49_999)
    other = spark.createDataFrame([("level7",), ("new",), (None,)], "s string")
    assert [x["code"] is None for x in encode.apply_codes(other, codes, "s", "code").orderBy(F.desc_nulls_last("code")).collect()] == [False, True, True]


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None), (5, "z")], "id int, s string")
    codes = encode.level_codes(df.where("id < 5"), "s")
    got = {r["id"]: r["h"].toArray().tolist() for r in encode.one_hot_vector(df, codes, "s", "h").collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 1.0], 4: [0.0, 0.0], 5: [0.0, 0.0]}


def people(spark):
    rows = [("p1", 1.0, "a"), ("p2", 1.1, "c"), ("p3", 1.2, "c"), ("p4", 9.0, "b"), ("p5", 1.05, None)]
    return spark.createDataFrame(rows, "pid string, f double, cat string")


def test_knn_takes_string_ids(spark):
    df = people(spark).withColumn("vec", F.array("f"))
    got = knn.knn_join(df.where("cat is null"), df.where("cat is not null").withColumnRenamed("pid", "did"), "pid", "did", "vec", 2)
    assert [(r["pid"], r["did"]) for r in got.orderBy("rank").collect()] == [("p5", "p1"), ("p5", "p2")]


@pytest.mark.parametrize("rounding,want", [("nearest", "b"), ("floor", "b"), ("vote", "c")])
def test_categorical_rounding_rules(spark, rounding, want):
    out = knn.knn_impute_categorical(people(spark), "pid", "cat", ["f"], k=3, rounding=rounding)
    assert {r["pid"]: r["cat"] for r in out.collect()}["p5"] == want
    with pytest.raises(ValueError):
        knn.knn_impute_categorical(people(spark), "pid", "cat", ["f"], rounding="up")


def test_model_parameters_by_either_name(spark):
    b = ml.boosted({"n_estimators": 150, "learning_rate": 0.2, "subsample": 0.5, "colsample_bytree": 0.4, "min_child_weight": 3,
                    "gamma": 0.1, "max_depth": 7})
    assert (b.getMaxIter(), b.getStepSize(), b.getSubsamplingRate(), b.getFeatureSubsetStrategy(), b.getMinInstancesPerNode(),
            b.getMaxDepth(), b.getMinInfoGain()) == (150, 0.2, 0.5, "0.4", 3, 7, 0.0)
    f = ml.forest({"n_estimators": 70, "max_features": None, "criterion": "entropy", "min_samples_split": 4})
    assert (f.getNumTrees(), f.getFeatureSubsetStrategy(), f.getImpurity()) == (70, "all", "entropy")
    for bad in ({"max_depth": 31}, {"maxDepth": 40}, {"trees": 3}):
        with pytest.raises(ValueError):
            ml.forest(bad)
    for model, space in (("tree", "tree"), ("forest", "forest"), ("boosted", "boosted"), ("boosted", "boosted_grid")):
        for seed in range(20):
            ml.MODELS[model](ml.draw_params(ml.SPACES[space], ml.random.Random(seed)))


def test_permutation_importance_of_a_rule(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 (F.col("id") % 2).cast("int").alias("y"))
    copies = ml.permuted(df, "id", ["a", "b"], 3, 5).collect()
    for r in range(3):
        mine = [x for x in copies if x["rep"] == r]
        assert sorted(x["id"] for x in mine) == list(range(200))
        assert sum(x["donor"]["b"] for x in mine) == sum(i % 7 for i in range(200))
    rule = lambda f: f.withColumn("pred", F.col("a").cast("int"))
    got = {r["feature"]: r["importance_mean"] for r in ml.permutation_importance(rule, df, ["a", "b"], "y", "id", 3, min_abs=-1.0).collect()}
    assert got["b"] == 0.0 and 0.0 <= got["a"] <= 1.0


def test_tuned_model_is_scored_on_both_stages(spark):
    df = spark.range(300).select((F.col("id") % 5).cast("int").alias("f"), (F.col("id") % 13).cast("double").alias("a"),
                                 F.element_at(F.array(*map(F.lit, ["train", "train", "train", "val", "test"])), (F.col("id") % 5 + 1).cast("int")).alias("split"),
                                 ((F.col("id") % 13) > 6).cast("int").alias("y"))
    df = encode.assemble(df.withColumn("fold", F.when(F.col("split") == "train", F.col("f"))), ["a"])
    log, rows, best = ml.tune_and_test("tree", {"max_depth": (2, 4)}, 2, df, "y")
    assert log.count() == 2 and 2 <= best["max_depth"] <= 4
    assert {(s, m) for s, m, _ in rows} == {(s, m) for s in ("val", "test") for m in ml.METRICS}
    assert all(v == 1.0 for _, _, v in rows)


def test_broadcast_is_taken_up_only_for_a_small_side(spark, monkeypatch):
    from tabwright.operators import joins
    left = spark.range(20).selectExpr("id", "id % 4 as k")
    dim = spark.range(4).selectExpr("id as k", "id * 10 as v")
    plan = lambda: joins.enrich(left, dim, [("k", "k")], broadcast=True)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert "strategy=broadcast" not in plan()
    assert joins.enrich(left, dim, [("k", "k")], broadcast=True).count() == 20
