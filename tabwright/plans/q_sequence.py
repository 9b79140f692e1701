"""Catalog: sequences in groups, splits and folds, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import columns as C
from tabwright.operators import encode, groups, joins, split, window
from tabwright.plans.common import R4, r4
from tabwright.plans.contracts import labelled_contracts, with_contracts
from tabwright.plans.q_prep import (HOUSE_AGE_SQL, RENT_EDGES, RENT_LABELS, RENT_SQL, RENT_UNKNOWN,
                                    house_age)
from tabwright.plans.registry import query

SEED = 777
K = 5
PREV_CODE = {"n.v.t.": -1, "<=3": 0, ">3": 1}


def labelled(spark, d):
    """Labelled contracts only (the modelling population)."""
    return labelled_contracts(spark, d).where(F.col("label").isNotNull())


LAB_SQL = "lab AS (SELECT * FROM lc WHERE label IS NOT NULL)"


# ------------------------------------------------------------------ W1-W5

@query("tenant_sequence", with_contracts("""
SELECT contract_id, CAST(row_number() OVER (PARTITION BY property_id ORDER BY start_ts, contract_id) AS INTEGER) AS seq
FROM contracts"""))
def q_tenant_sequence(spark, d):
    from tabwright.plans.contracts import contracts
    df = contracts(spark, d).select("contract_id", "property_id", "start_ts")
    return window.sequence_no(df, "property_id", ["start_ts", "contract_id"]).select("contract_id", "seq")


@query("prev_label", with_contracts("""
SELECT contract_id, prev_label,
       CASE prev_label WHEN 'n.v.t.' THEN -1 WHEN '<=3' THEN 0 WHEN '>3' THEN 1 END AS prev_label_code
FROM (SELECT contract_id, coalesce(lag(label) OVER (PARTITION BY property_id ORDER BY start_ts, contract_id), 'n.v.t.') AS prev_label
      FROM lab)""", LAB_SQL))
def q_prev_label(spark, d):
    df = labelled(spark, d).select("contract_id", "property_id", "start_ts", "label")
    out = window.prev_value(df, "property_id", ["start_ts", "contract_id"], "label", "prev_label", default="n.v.t.")
    return out.select("contract_id", "prev_label", C.lookup("prev_label", PREV_CODE).alias("prev_label_code"))


@query("rolling_mean", with_contracts(f"""
SELECT contract_id,
       {R4('avg(value) OVER (PARTITION BY property_id ORDER BY start_ts, contract_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_value
FROM contracts"""))
def q_rolling_mean(spark, d):
    from tabwright.plans.contracts import contracts
    df = contracts(spark, d).select("contract_id", "property_id", "start_ts", "value")
    out = window.rolling_mean(df, "property_id", ["start_ts", "contract_id"], "value", "rolling_value", n=3)
    return out.select("contract_id", r4("rolling_value").alias("rolling_value"))


@query("moving_average_valid", with_contracts(f"""
SELECT region, month, n, ma3 FROM (
  SELECT region, month, n,
         {R4('avg(n) OVER (PARTITION BY region ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS ma3,
         row_number() OVER (PARTITION BY region ORDER BY month) AS rn
  FROM (SELECT region, strftime(start_ts, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM contracts GROUP BY ALL))
WHERE rn >= 3"""))
def q_moving_average(spark, d):
    from tabwright.plans.contracts import contracts
    monthly = (contracts(spark, d).groupBy("region", F.date_format("start_ts", "yyyy-MM").alias("month"))
               .agg(F.count(F.lit(1)).alias("n")))
    out = window.moving_average(monthly, "month", "n", n=3, by=["region"], out="ma3")
    return out.select("region", "month", "n", r4("ma3").alias("ma3"))


@query("running_best", with_contracts("""
SELECT contract_id, max(value) OVER (PARTITION BY property_id ORDER BY start_ts, contract_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM contracts"""))
def q_running_best(spark, d):
    from tabwright.plans.contracts import contracts
    df = contracts(spark, d).select("contract_id", "property_id", "start_ts", "value")
    out = window.running_best(df, ["start_ts", "contract_id"], "value", by=["property_id"])
    return out.select("contract_id", "best_so_far")


# ------------------------------------------------------------------ T2-T8, U1

HASH_SQL = f"md5(CAST(contract_id AS VARCHAR) || '|{SEED}')"

RANDOM_SPLIT_SQL = f"""{LAB_SQL},
rs_idx AS (SELECT *, row_number() OVER (ORDER BY {HASH_SQL}, contract_id) - 1 AS idx, count(*) OVER () AS n FROM lab),
rsplit AS (SELECT *, CASE WHEN idx < n - ceil(0.4 * n) THEN 'train'
                          WHEN idx < n - ceil(0.5 * ceil(0.4 * n)) THEN 'val' ELSE 'test' END AS split FROM rs_idx)"""

ORDERED_SPLIT_SQL = f"""{LAB_SQL},
os_idx AS (SELECT *, row_number() OVER (ORDER BY {HOUSE_AGE_SQL} DESC, contract_id) - 1 AS idx, count(*) OVER () AS n FROM lab),
os_rest AS (SELECT *, row_number() OVER (ORDER BY {HASH_SQL}, contract_id) - 1 AS idx2, count(*) OVER () AS m
            FROM os_idx WHERE idx >= CAST(floor(0.6 * n) AS BIGINT)),
osplit AS (SELECT contract_id, 'train' AS split FROM os_idx WHERE idx < CAST(floor(0.6 * n) AS BIGINT)
           UNION ALL
           SELECT contract_id, CASE WHEN idx2 < m - ceil(0.5 * m) THEN 'val' ELSE 'test' END FROM os_rest)"""


def random_splits(spark, d):
    return split.random_split_exact(labelled(spark, d), "contract_id", seed=SEED)


def ordered_splits(spark, d):
    df = labelled(spark, d)
    df = df.withColumn("house_age", house_age(df))
    return split.ordered_split(df, [-F.col("house_age")], "contract_id", frac=0.6, seed=SEED)


@query("split_random", with_contracts("SELECT contract_id, split FROM rsplit", RANDOM_SPLIT_SQL))
def q_split_random(spark, d):
    return random_splits(spark, d).select("contract_id", "split")


@query("split_ordered", with_contracts("SELECT contract_id, split FROM osplit", ORDERED_SPLIT_SQL))
def q_split_ordered(spark, d):
    return ordered_splits(spark, d).select("contract_id", "split")


@query("kfold_random", with_contracts(f"""
SELECT contract_id,
       CAST(CASE WHEN idx < (n % {K}) * (n // {K} + 1) THEN idx // (n // {K} + 1)
                 ELSE (n % {K}) + (idx - (n % {K}) * (n // {K} + 1)) // (n // {K}) END AS INTEGER) AS fold
FROM (SELECT contract_id, row_number() OVER (ORDER BY {HASH_SQL}, contract_id) - 1 AS idx, count(*) OVER () AS n FROM lab)""",
    LAB_SQL))
def q_kfold(spark, d):
    return split.kfold(labelled(spark, d), "contract_id", k=K, seed=SEED).select("contract_id", "fold")


@query("stratified_folds", with_contracts(f"""
SELECT r.contract_id, CAST(a.i AS INTEGER) AS fold
FROM (SELECT contract_id, target, row_number() OVER (PARTITION BY target ORDER BY contract_id) - 1 AS j FROM lab) r
JOIN cum a ON r.target = a.target AND r.j < a.hi AND r.j >= a.hi - a.cnt""", f"""{LAB_SQL},
cc AS (SELECT target, count(*) AS n, min(contract_id) AS first_id FROM lab GROUP BY target),
st AS (SELECT target, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cc),
al AS (SELECT target, i,
              greatest(0, CAST(ceil((s + n - i) / {float(K)}) AS BIGINT)) - greatest(0, CAST(ceil((s - i) / {float(K)}) AS BIGINT)) AS cnt
       FROM st, range({K}) t(i)),
cum AS (SELECT target, i, cnt, sum(cnt) OVER (PARTITION BY target ORDER BY i) AS hi FROM al)"""))
def q_stratified(spark, d):
    return split.stratified_folds(labelled(spark, d), "target", ["contract_id"], k=K).select("contract_id", "fold")


@query("split_sizes", with_contracts("""
SELECT 'random' AS scheme, split, CAST(count(*) AS BIGINT) AS n FROM rsplit GROUP BY split
UNION ALL SELECT 'ordered' AS scheme, split, CAST(count(*) AS BIGINT) AS n FROM osplit GROUP BY split""",
    RANDOM_SPLIT_SQL + "," + ORDERED_SPLIT_SQL.replace(LAB_SQL + ",", "", 1)))
def q_split_sizes(spark, d):
    both = joins.union_rows(random_splits(spark, d).select(F.lit("random").alias("scheme"), "split"),
                            ordered_splits(spark, d).select(F.lit("ordered").alias("scheme"), "split"))
    return split.split_sizes(both)


@query("union_train_val", with_contracts("""
SELECT contract_id, split FROM rsplit WHERE split = 'train' UNION ALL SELECT contract_id, split FROM rsplit WHERE split = 'val'""",
    RANDOM_SPLIT_SQL))
def q_union_train_val(spark, d):
    s = random_splits(spark, d).select("contract_id", "split")
    return joins.union_rows(s.where(F.col("split") == "train"), s.where(F.col("split") == "val"))


@query("best_trial", with_contracts("""
SELECT contract_id, value FROM contracts ORDER BY value DESC, contract_id LIMIT 1"""))
def q_best_trial(spark, d):
    from tabwright.plans.contracts import contracts
    return split.best_row(contracts(spark, d).select("contract_id", "value"), "value", "contract_id")


@query("head_n", "SELECT o_orderkey AS contract_id, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 5")
def q_head_n(spark, d):
    from tabwright.plans.contracts import table
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_totalprice").alias("value"))
    return split.head_n(o, ["contract_id"], 5)


# ------------------------------------------------------------------ E1-E3

@query("label_encode", with_contracts("""
SELECT contract_id, CAST(CASE WHEN pt IS NOT NULL THEN dense_rank() OVER (ORDER BY pt) - 1 END AS DOUBLE) AS prop_type_code
FROM (SELECT contract_id, CASE WHEN prop_type = 'BUILDING' THEN NULL ELSE prop_type END AS pt FROM contracts)"""))
def q_label_encode(spark, d):
    from tabwright.plans.contracts import contracts
    df = contracts(spark, d).withColumn("pt", C.null_out("prop_type", ["BUILDING"]))
    enc, _ = encode.label_encode(df, "pt", "prop_type_code")
    return enc.select("contract_id", F.col("prop_type_code").cast("double").alias("prop_type_code"))


OH_LEVELS = {"prop_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
             "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}


@query("one_hot", with_contracts("SELECT contract_id, " + ", ".join(
    f"CAST(coalesce({c} = '{lv}', false) AS INTEGER) AS \"{c}_{lv}\"" for c, lvs in OH_LEVELS.items() for lv in lvs[1:])
    + " FROM lc"))
def q_one_hot(spark, d):
    """Levels are learned on the random-split training rows only, then applied to all contracts."""
    train = random_splits(spark, d).where(F.col("split") == "train")
    enc = encode.OneHotWide(["prop_type", "region"]).fit(train)
    return enc.transform(labelled_contracts(spark, d)).select("contract_id", *enc.output_columns())


@query("features_per_split", with_contracts(f"""
SELECT contract_id, split,
       {R4('avg(duration_days) OVER (PARTITION BY split, property_id)')} AS avg_dur_property,
       {R4('avg(duration_days) OVER (PARTITION BY split, prop_type)')} AS avg_dur_type,
       {R4('avg(duration_days) OVER (PARTITION BY split, complex_id)')} AS avg_dur_complex,
       {R4('avg(duration_days) OVER (PARTITION BY split, city)')} AS avg_dur_city,
       {R4('avg(duration_days) OVER (PARTITION BY split, region)')} AS avg_dur_region,
       {R4('avg(value) OVER (PARTITION BY split, property_id ORDER BY start_ts, contract_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_value,
       CAST(coalesce(room1 > 0, false) AS INTEGER) + CAST(coalesce(room2 > 0, false) AS INTEGER)
           + CAST(coalesce(room3 > 0, false) AS INTEGER) AS n_rooms,
       CASE WHEN rent IS NULL THEN '{RENT_UNKNOWN}'
            {' '.join(f"WHEN rent <= {e} THEN '{lab}'" for e, lab in zip(RENT_EDGES, RENT_LABELS))}
            ELSE '{RENT_LABELS[-1]}' END AS price_class
FROM (SELECT *, {RENT_SQL} AS rent FROM rsplit)""", RANDOM_SPLIT_SQL))
def q_features_per_split(spark, d):
    """The feature bundle computed per split: every group and window key includes the split,
    so no statistic crosses from one split into another."""
    df = random_splits(spark, d).withColumn("split_property", F.concat("split", F.lit("|"), F.col("property_id").cast("string")))
    means = {"avg_dur_property": "property_id", "avg_dur_type": "prop_type", "avg_dur_complex": "complex_id",
             "avg_dur_city": "city", "avg_dur_region": "region"}
    for name, key in means.items():
        df = groups.group_mean(df, ["split", key], "duration_days", name)
    # the window sees its own columns only
    rolled = window.rolling_mean(df.select("contract_id", "split_property", "start_ts", "value"), "split_property",
                                 ["start_ts", "contract_id"], "value", "rolling_value", n=3)
    df = df.join(rolled.select("contract_id", "rolling_value"), "contract_id")
    df = df.withColumns({
        "n_rooms": C.count_positive(["room1", "room2", "room3"]),
        "price_class": C.banded(F.col("value") / F.col("area") * 0.3, RENT_EDGES, RENT_LABELS, RENT_UNKNOWN)})
    return df.select("contract_id", "split", *[r4(m).alias(m) for m in means], r4("rolling_value").alias("rolling_value"),
                     "n_rooms", "price_class")
