"""Global/group row index, exact quantiles, splits and folds."""


import pytest
from pyspark.sql import functions as F

from tabwright.operators import groups, ordering, ranks, split, window


def test_global_row_index_is_a_permutation(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(5)
    out = ordering.global_row_index(df, ["k", "id"]).select("k", "row_idx").collect()
    got = sorted((r["row_idx"], r["k"]) for r in out)
    assert [g[0] for g in got] == list(range(1000))
    assert [g[1] for g in got] == sorted(r["k"] for r in out)


def test_group_row_index_hot_key(spark):
    # one key holds a third of the rows: it must still be numbered 0..n-1 exactly
    rows = [(0 if i % 3 == 0 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "key long, id long").repartition(4)
    out = ordering.group_row_index(df, ["key"], ["id"]).collect()
    hot = sorted(r["row_in_group"] for r in out if r["key"] == 0)
    assert hot == list(range(300))
    assert all(r["group_size"] == 300 for r in out if r["key"] == 0)


def test_exact_quantiles_match_linear_interpolation(spark):
    import numpy as np
    vals = [float(x) for x in [5, 1, 9, 3, 3, 8, 2, 7, 4, 6, 10, 0.5]]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    q = ordering.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9]).first()
    for nm, p in zip(["q10", "q25", "q50", "q90"], [0.1, 0.25, 0.5, 0.9]):
        assert q[nm] == pytest.approx(float(np.quantile(vals, p)))


def test_running_best_across_partitions(spark):
    vals = [(i, float((i * 13) % 17)) for i in range(300)]
    df = spark.createDataFrame(vals, "t long, v double").repartition(6)
    out = {r["t"]: r["best_so_far"] for r in window.running_best(df, ["t"], "v").collect()}
    best = -1
    for t, v in vals:
        best = max(best, v)
        assert out[t] == best


def test_random_split_sizes_and_disjoint(spark):
    df = spark.range(0, 16770).withColumnRenamed("id", "cid")
    out = split.random_split_exact(df, "cid", seed=777)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    # 60/20/20 of 16,770 rows gives 10,062 / 3,354 / 3,354.
    assert sizes == {"train": 10062, "val": 3354, "test": 3354}
    assert out.select("cid").distinct().count() == 16770


def test_random_split_ignores_partitioning(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "cid")
    a = {r["cid"]: r["split"] for r in split.random_split_exact(df.repartition(3), "cid").collect()}
    b = {r["cid"]: r["split"] for r in split.random_split_exact(df.repartition(11), "cid").collect()}
    assert a == b


def test_ordered_split_head_is_train(spark):
    df = spark.range(0, 101).withColumn("age", 200 - F.col("id"))
    out = split.ordered_split(df, [-F.col("age")], "id", frac=0.6)
    train = sorted(r["id"] for r in out.where("split = 'train'").collect())
    assert train == list(range(60))
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 60, "val": 20, "test": 21}


def test_kfold_sizes(spark):
    out = split.kfold(spark.range(0, 23).withColumnRenamed("id", "cid"), "cid", k=5)
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]


def _reference_stratified(labels, k):
    """Unshuffled stratified K-fold allocation, written out from the documented rule: classes are
    numbered by first appearance, the sorted numbers dealt round-robin."""
    classes = list(dict.fromkeys(labels))
    y_sorted = sorted(classes.index(y) for y in labels)
    alloc = [[sum(1 for y in y_sorted[i::k] if y == c) for c in range(len(classes))] for i in range(k)]
    folds = [None] * len(labels)
    for ci, c in enumerate(classes):
        seq = [i for i in range(k) for _ in range(alloc[i][ci])]
        idx = [j for j, y in enumerate(labels) if y == c]
        for j, f in zip(idx, seq):
            folds[j] = f
    return folds


@pytest.mark.parametrize("labels,k", [([(i * 7) % 3 % 2 for i in range(137)], 5), ([1, 0, 1, 0, 1, 0, 1, 0], 3),
                                      (list("cabacbbbaacc"), 4)])
def test_stratified_folds_match_rule(spark, labels, k):
    df = spark.createDataFrame(list(enumerate(labels)), ["pos", "y"]).repartition(3)
    out = {r["pos"]: r["fold"] for r in split.stratified_folds(df, "y", ["pos"], k=k).collect()}
    assert [out[i] for i in range(len(labels))] == _reference_stratified(labels, k)


def test_stratified_folds_leave_unlabelled_rows_out(spark):
    df = spark.createDataFrame([(0, None), (1, 1), (2, 0), (3, 1), (4, 0)], "pos int, y int")
    out = {r["pos"]: r["fold"] for r in split.stratified_folds(df, "y", ["pos"], k=2).collect()}
    assert out[0] is None and {out[i] for i in range(1, 5)} == {0, 1}
    with pytest.raises(ValueError):
        split.stratified_folds(df, "pos", ["pos"], k=2, max_classes=3)


@pytest.mark.parametrize("limit", [3, 50, 20_000])
def test_keys_at_positions(spark, limit):
    rows = [(None if i % 11 == 0 else float((i * 37) % 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, id long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0.0, r[1]))
    positions = [0, 1, 57, 199, 398, 399]
    got = ranks.keys_at(df, ["v", "id"], positions, limit=limit)
    for p in positions:
        hit = df.where(ranks.order_key(["v", "id"]) == got[p]).collect()
        assert [(r["v"], r["id"]) for r in hit] == [want[p]]


@pytest.mark.parametrize("order, limit", [(["s", "id"], 1), (["d", "t", "id"], 1), (["n", "s", "id"], 200), (["dec", "id"], 200),
                                          (["b", "x", "id"], 1), (["big", "id"], 200), (["s", "id"], 20_000)])
def test_cuts_of_all_groups_and_types(spark, order, limit):
    """Positions of every group at once against a sort; values that repeat, are null, or agree in their first bytes."""
    rows = [(i, "g" if i % 3 else None, None if i % 7 == 0 else "a common beginning %d" % (i * 31 % 57), i % 5 if i % 4 else None,
             float("nan") if i % 13 == 0 else (float("inf") if i % 17 == 0 else (i * 7 % 23) - 11.5), i % 2 == 0, (1 << 60) + (i * 37 % 101))
            for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, s string, n int, x double, b boolean, big long").repartition(5) \
        .withColumn("d", F.when(F.col("n").isNotNull(), F.date_add(F.lit("1960-01-01").cast("date"), F.col("n") * 1000))) \
        .withColumn("t", F.when(F.col("n").isNotNull(), F.timestamp_micros(F.col("id") % 9))).withColumn("dec", (F.col("n") * 7).cast("decimal(30,2)"))
    positions = [0, 51, 200, 465]
    got, tied = ranks.cut_keys(df, order, lambda sizes: {g: positions for g in sizes}, by="g", limit=limit)
    assert not tied
    for g, n in ((None, 234), ("g", 466)):
        own = df.where(F.col("g").eqNullSafe(F.lit(g)))
        want = [r["id"] for r in own.orderBy(ranks.order_key(order)).collect()]
        assert len(want) == n
        for p in positions:
            if p < n:
                assert own.where(ranks.order_key(order) == got[g, p]).first()["id"] == want[p]


def _counting(spark, n):
    """n rows (cid, y) and an accumulator of the rows read from them."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("cid"), (F.col("id") % 2).alias("y"))
    return df.mapInArrow(seen, "cid long, y long"), reads


@pytest.mark.parametrize("k", [2, 40])
def test_cuts_share_their_passes(spark, k):
    """The keys are read at most four times for any number of cuts, and the input once."""
    n = 60_000
    starts = split.fold_starts(n, k)[1:]
    keys, reads = _counting(spark, n)
    found, _ = ranks.cut_keys(keys, [split.hash_order("cid", 1), "cid"], lambda rows: {0: starts})
    assert len(found) == k - 1 and reads.value <= 4 * n
    keys, reads = _counting(spark, n)
    found, _ = ranks.cut_keys(keys, ["cid"], lambda rows: {g: [s // 2 for s in starts] for g in rows}, by="y")
    assert len(found) == 2 * (k - 1) and reads.value <= 4 * n
    df, reads = _counting(spark, n)
    split.kfold(df, "cid", k=k)
    assert reads.value == n


def test_long_cuts_read_the_keys_three_times(spark):
    """Stretches still too long to list after the counting pass are written and narrowed there, also when a
    small group has ended before; keys are those of a sort."""
    n = 60_000
    keys, reads = _counting(spark, n)
    keys = keys.withColumn("y", F.when(F.col("cid") < n - 50, F.lit("long")))
    positions = [7, 20_000, 41_003, n - 51]
    order = [split.hash_order("cid", 1), "cid"]
    found, tied = ranks.cut_keys(keys, order, lambda rows: {g: [p for p in positions if p < m] for g, m in rows.items()}, by="y", limit=100)
    assert not tied and len(found) == 5 and reads.value <= 3 * n
    for g in ("long", None):
        own = spark.range(0, n).select(F.col("id").alias("cid")).where(F.col("cid") < n - 50 if g else F.col("cid") >= n - 50)
        want = [r["cid"] for r in own.orderBy(*order).collect()]
        for p in (p for p in positions if p < len(want)):
            assert own.where(ranks.order_key(order) == found[g, p]).first()["cid"] == want[p]


def test_repeated_ids_keep_exact_sizes(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "cid long, v int").repartition(4)
    sizes = {r["split"]: r["count"] for r in split.random_split_exact(df, "cid").groupBy("split").count().collect()}
    assert sizes == {"train": 18, "val": 6, "test": 6}
    folds = split.kfold(df, "cid", k=5)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [6] * 5 and folds.columns == ["cid", "v", "fold"]
    ordered = split.ordered_split(df, ["cid"], "cid", frac=0.5)
    assert {r["split"]: r["count"] for r in ordered.groupBy("split").count().collect()} == {"train": 15, "val": 7, "test": 8}
    assert max(r["cid"] for r in ordered.where("split = 'train'").collect()) <= min(r["cid"] for r in ordered.where("split <> 'train'").collect())
    strata = split.stratified_folds(df.withColumn("y", F.col("v") % 2), "y", ["cid"], k=3)
    assert [r["count"] for r in strata.groupBy("fold", "y").count().collect()] == [5] * 6


def test_keys_at_of_equal_keys(spark):
    df = spark.createDataFrame([(7,)] * 300, "v int").repartition(4)
    got = ranks.keys_at(df, ["v"], [0, 150, 299], limit=5)
    assert df.where(ranks.order_key(["v"]) == got[150]).count() == 300


@pytest.mark.parametrize("limit", [2, 20_000])
def test_column_quantiles_match_numpy(spark, limit):
    import numpy as np
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.standard_normal(300), [5.0] * 200, [1e300, -1e300]])
    b = rng.integers(0, 4, len(a)).astype(float)
    b[::7] = np.nan
    rows = [(float(x), None if i % 5 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, e double").repartition(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = ranks.column_quantiles(df, ["a", "b", "e"], qs, limit=limit)
    kept = [y for _, y, _ in rows if y is not None and not np.isnan(y)]
    assert got["a"] == pytest.approx([float(np.quantile(a, q)) for q in qs])
    assert got["b"] == pytest.approx([float(np.quantile(kept, q)) for q in qs]) and got["e"] == [None] * 6


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_sum_does_not_depend_on_partitions(spark, parts):
    vals = [None, 1.0, None, 3.0, None, None, 2.0, None]
    df = spark.createDataFrame(list(enumerate(vals)), "t int, v double")
    out = {r["t"]: r["running_sum"] for r in ordering.running_agg(df, ["t"], "v", "sum", num_partitions=parts).collect()}
    assert [out[i] for i in range(8)] == [None, 1.0, 1.0, 4.0, 4.0, 4.0, 6.0, 6.0]


def test_rows_without_a_key_have_no_sequence(spark):
    df = spark.createDataFrame([(1, 1, 10.0, "a"), (None, 2, 20.0, "b"), (None, 3, 30.0, "c"), (1, 4, float("nan"), "d")],
                               "k int, t int, v double, lab string")
    assert {r["t"]: r["seq"] for r in window.sequence_no(df, "k", ["t"]).collect()} == {1: 1, 2: None, 3: None, 4: 2}
    got = {r["t"]: r["m"] for r in window.rolling_mean(df, "k", ["t"], "v", "m").collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: 10.0}
    prev = {r["t"]: r["p"] for r in window.prev_value(df, "k", ["t"], "lab", "p", default="none").collect()}
    assert prev == {1: "none", 2: None, 3: None, 4: "a"}


def test_sequence_prev_and_rolling(spark):
    rows = [(1, 1, 10.0, "a"), (1, 2, None, "b"), (1, 3, 30.0, "c"), (1, 4, 40.0, "d"), (2, 1, 5.0, "x")]
    df = spark.createDataFrame(rows, "k long, t long, v double, lab string")
    seq = {(r["k"], r["t"]): r["seq"] for r in window.sequence_no(df, "k", ["t"]).collect()}
    assert seq == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 4, (2, 1): 1}
    prev = {(r["k"], r["t"]): r["p"] for r in window.prev_value(df, "k", ["t"], "lab", "p", default="n.v.t.").collect()}
    assert prev[(1, 1)] == "n.v.t." and prev[(1, 3)] == "b" and prev[(2, 1)] == "n.v.t."
    roll = {(r["k"], r["t"]): r["m"] for r in window.rolling_mean(df, "k", ["t"], "v", "m", n=3).collect()}
    assert roll[(1, 1)] == 10.0 and roll[(1, 2)] == 10.0 and roll[(1, 3)] == 20.0 and roll[(1, 4)] == 35.0


def test_moving_average_valid_golden(spark):
    # Fixed values (FIXTURES F7): fold F1 0.66, 0.68, 0.67, 0.67, 0.66 -> 0.67, 0.673333, 0.666667
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.66, 0.68, 0.67, 0.67, 0.66])], "fold int, f1 double")
    got = [r["moving_avg"] for r in window.moving_average(df, "fold", "f1", n=3).orderBy("fold").collect()]
    assert got == pytest.approx([0.67, 0.673333, 0.666667], abs=1e-6)


def test_window_operators_on_hot_key_match_pandas(spark):
    # key 0 holds a third of 1,200 rows over 6 input partitions; values have nulls and ties in time
    n = 1200
    df = (spark.range(0, n).repartition(6)
          .select("id",
                  F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17 + 1).alias("key"),
                  ((F.col("id") * 37) % 101).alias("t"),
                  F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 13) % 29).cast("double").alias("v")))
    order = ["t", "id"]
    out = window.sequence_no(df, "key", order)
    out = window.prev_value(out, "key", order, "v", "prev_v", default=-1.0)
    out = window.rolling_mean(out, "key", order, "v", "roll_v", n=3)
    got = out.toPandas().sort_values("id").reset_index(drop=True)

    pdf = df.toPandas().sort_values(["key", "t", "id"]).reset_index(drop=True)
    g = pdf.groupby("key", sort=False)
    pdf["seq"] = g.cumcount() + 1
    pdf["prev_v"] = g["v"].shift(1).fillna(-1.0)
    pdf["roll_v"] = g["v"].transform(lambda s: s.rolling(3, min_periods=1).mean())
    want = pdf.sort_values("id").reset_index(drop=True)

    assert (got["seq"].to_numpy() == want["seq"].to_numpy()).all()
    assert got["prev_v"].tolist() == pytest.approx(want["prev_v"].tolist(), nan_ok=True)
    assert got["roll_v"].tolist() == pytest.approx(want["roll_v"].tolist(), nan_ok=True)
    assert (got["key"] == 0).sum() == n // 3


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours_cross_any_number_of_partitions(spark, partitions):
    """Fewer rows than partitions, null keys, null values, and lags longer than a partition."""
    rows = [(None if i % 10 == 9 else (0 if i < 25 else i // 8), i, None if i % 6 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, t int, v double").repartition(4)
    out, lags = ordering.neighbours(df, "key", ["t"], "v", 5, num_partitions=partitions)
    got = {r["t"]: (r["seq"], [r[c] for c in lags]) for r in out.collect()}
    before = {}
    for k, t, v in rows:
        own = before.setdefault(k, [])
        assert got[t] == (len(own) + 1, (own[::-1] + [None] * 5)[:5])
        own.append(v)


@pytest.mark.parametrize("limit, bins", [(5, 8), (20, 1024), (20_000, 4)])
def test_group_quantiles_narrow_in_shared_passes(spark, limit, bins):
    import numpy as np
    rng = np.random.default_rng(2)
    groups_ = {None: rng.standard_normal(400), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 60), "far": np.append(rng.standard_normal(90), [1e300, -1e300]),
               "one": np.array([3.5]), "same": np.full(70, -0.25), "small": np.array([1.0, 4.0, 2.0])}
    rows = [(g, float(v), i % 2) for g, own in groups_.items() for i, v in enumerate(own)] + [("none", None, 0), ("none", float("nan"), 0)]
    df = spark.createDataFrame(rows, "g string, v double, h int").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in
           ordering.exact_quantiles(df, "v", qs, by=["g"], names=[f"q{i}" for i in range(6)], limit=limit, bins=bins).collect()}
    assert set(got) == set(groups_)
    for g, own in groups_.items():
        assert got[g] == pytest.approx([float(np.quantile(own, q)) for q in qs])


def test_group_quantiles_and_running_max_on_hot_key(spark):
    n = 1500
    df = (spark.range(0, n).repartition(7)
          .select("id",
                  F.when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id") % 9).alias("key"),
                  (((F.col("id") * 7919) % 503) / 7.0).alias("v")))
    q = ordering.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], by=["key"], names=["a", "b", "c", "d"]).toPandas()
    pdf = df.toPandas()
    for _, r in q.iterrows():
        s = pdf.loc[pdf["key"] == r["key"], "v"]
        assert [r["a"], r["b"], r["c"], r["d"]] == pytest.approx([s.quantile(x) for x in (0.1, 0.25, 0.5, 0.9)])
    assert sorted(q["key"]) == sorted(pdf["key"].unique())

    run = ordering.running_agg(df, ["id"], "v", fn="max", by=["key"], out="best").toPandas().sort_values("id")
    want = pdf.set_index("id").sort_index().groupby("key")["v"].cummax()
    assert run["best"].tolist() == pytest.approx(want.loc[run["id"].to_numpy()].tolist())


def test_group_statistics_on_hot_key_match_pandas(spark):
    n = 1800
    df = (spark.range(0, n).repartition(6)
          .select("id",
                  F.when(F.col("id") % 3 == 2, F.lit(7)).otherwise(F.col("id") % 13).alias("key"),
                  ((F.col("id") * 31) % 47).cast("double").alias("v"),
                  ((F.col("id") * 17) % 23).alias("c"),
                  F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("lab")))
    out = groups.group_mean(df, "key", "v", "m")
    out = groups.group_nunique(out, "key", "c", "nu")
    out = groups.group_nunique_if(out, "key", "c", {"nu_x": F.col("lab") == "x"})
    got = out.toPandas().set_index("id").sort_index()
    pdf = df.toPandas().set_index("id").sort_index()
    g = pdf.groupby("key")
    assert got["m"].tolist() == pytest.approx(g["v"].transform("mean").tolist())
    assert got["nu"].tolist() == g["c"].transform("nunique").tolist()
    nx = pdf[pdf["lab"] == "x"].groupby("key")["c"].nunique()
    assert got["nu_x"].tolist() == pdf["key"].map(nx).fillna(0).astype(int).tolist()
