"""Benchmark: headline queries + tuning throughput at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed fully through the ``noop`` sink (no driver collect). The tuning entries
are the whole tree study (50 trials x 5 folds over the whole space) and one fit each of a forest
and a boosted model from inside their spaces; every figure is measured, none multiplied up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "class_balance", "describe_numeric", "missing_profile", "iqr_outliers", "box_stats_by", "kde_grid",
    "corr_with_label", "chi2_stat", "join_left_rate", "fill_group_constant", "tenant_sequence",
    "prev_label", "rolling_mean", "running_best", "split_random", "split_ordered", "stratified_folds",
    "one_hot", "features_per_split", "roc_auc", "knn_join", "knn_impute", "knn_graph",
    "propagate_one_step",
]

# one setting from inside each search space (operators.ml.SPACES)
FITS = {
    "forest": {"n_estimators": 70, "max_depth": 10, "max_features": "sqrt", "criterion": "gini", "min_samples_leaf": 2},
    "boosted": {"n_estimators": 150, "max_depth": 7, "learning_rate": 0.1, "subsample": 0.6, "colsample_bytree": 0.6,
                "min_child_weight": 5},
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tree_trials = int(os.environ.get("BENCH_TREE_TRIALS", "50"))
    only = os.environ.get("BENCH_ONLY")
    from tabwright.session import build_session
    from tabwright.plans.registry import QUERIES, load_all

    logdir = tempfile.mkdtemp(prefix="bench-events-")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir})
    load_all()
    # JVM start, class loading and first code generation are reported apart from the timings.
    t0 = time.time()
    QUERIES["scan_count"](spark, sf_dir).collect()
    warmup = round(time.time() - t0, 3)
    times: dict[str, float] = {}
    names = [q for q in HEADLINE if not only or re.search(only, q)]
    for q in names:
        t0 = time.time()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.time() - t0, 3)

    extra = {}
    if not only or re.search(only, "tuning"):
        from tabwright.operators import ml
        from tabwright.plans.q_models import train_with_folds
        from tabwright.session import materialize
        t0 = time.time()
        train, _ = train_with_folds(spark, sf_dir)
        # stage boundary (S5): the tuning input is written once and every fit reads it
        train = materialize(train.select("features", "target", "fold"))
        n_rows = train.count()
        times["tune_prepare"] = round(time.time() - t0, 3)
        # the tree study has the reference's size and whole space: trials x 5 folds
        t0 = time.time()
        ml.random_search("tree", ml.SPACES["tree"], tree_trials, train, "fold", "target", k=5, parallelism=2 * int(cpus)).count()
        dt = time.time() - t0
        times["tune_tree"] = round(dt, 3)
        extra["tune_tree_fits"] = tree_trials * 5
        extra["tune_tree_fits_per_sec"] = round(tree_trials * 5 / dt, 3)
        # one measured fit each of the forest and the boosted model, inside their spaces; no study is
        # extrapolated from them
        for model, params in FITS.items():
            t0 = time.time()
            fit = ml.MODELS[model](params, label="target").fit(train)
            times[f"fit_{model}"] = round(time.time() - t0, 3)
            extra[f"fit_{model}_params"] = params
            extra[f"fit_{model}_nodes"] = fit.totalNumNodes
        extra["tune_train_rows"] = n_rows
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_plus_tuning_wall_clock", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus), "warmup_sec": warmup, **extra, "event_log": logdir}))
    spark.stop()


if __name__ == "__main__":
    main()
