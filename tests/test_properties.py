"""Property tests (hypothesis): fills, splits, folds and indexes under random inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.operators import impute, ordering, split

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=40)


@settings(**SETTINGS)
@given(values)
def test_fill_is_idempotent_and_flags_are_lossless(spark, vals):
    df = spark.createDataFrame(list(enumerate(vals)), "id long, x double")
    once = impute.fill_const(df, ["x"], 0.0)
    twice = impute.fill_const(once, ["x"], 0.0)
    assert sorted(once.collect()) == sorted(twice.collect())
    ff = impute.flag_and_fill(df, {"x": -1.0}).collect()
    back = {r["id"]: (None if r["x_missing"] else r["x"]) for r in ff}
    assert back == dict(enumerate(vals))


@settings(**SETTINGS)
@given(st.integers(1, 400), st.integers(1, 20))
def test_random_split_exact_disjoint_exhaustive(spark, n, parts):
    df = spark.range(n).withColumnRenamed("id", "cid").repartition(parts)
    out = split.random_split_exact(df, "cid").collect()
    assert sorted(r["cid"] for r in out) == list(range(n))
    sizes = {s: sum(1 for r in out if r["split"] == s) for s in ("train", "val", "test")}
    hold = math.ceil(0.4 * n)
    assert sizes["train"] == n - hold and sizes["test"] == math.ceil(0.5 * hold)


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 2), min_size=5, max_size=120), st.integers(2, 6))
def test_stratified_fold_class_counts_differ_by_at_most_one(spark, labels, k):
    df = spark.createDataFrame(list(enumerate(labels)), "pos long, y int")
    out = split.stratified_folds(df, "y", ["pos"], k=k).collect()
    for c in set(labels):
        per = [sum(1 for r in out if r["y"] == c and r["fold"] == f) for f in range(k)]
        assert max(per) - min(per) <= 1
        assert sum(per) == labels.count(c)


@settings(**SETTINGS)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=200), st.integers(1, 9))
def test_group_index_independent_of_partitioning(spark, keys, parts):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long").repartition(parts)
    got = {r["id"]: r["row_in_group"] for r in ordering.group_row_index(df, ["k"], ["id"]).collect()}
    exp = {}
    seen = {}
    for i, k in enumerate(keys):
        exp[i] = seen.get(k, 0)
        seen[k] = exp[i] + 1
    assert got == exp
