"""Catalog: sources, projections, joins, set operations, rules and scalar functions.

Each query is written with the library operators; the paired SQL is an independent DuckDB
statement over the same parquet tables. Floating outputs are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabwright.functions import columns as C
from tabwright.operators import filters, impute, joins
from tabwright.plans.contracts import AS_OF, CUTOFF_YEAR, contracts, labelled_contracts, table, with_contracts
from tabwright.plans.common import R4, RND, r4, rnd
from tabwright.plans.registry import query
from tabwright.session import ensure_checkpoint_dir
from tabwright.sources import io


# ------------------------------------------------------------------ fixed values of the stand-in
SCAN_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SENTINEL_DATE = "9999-12-31"
# Code -> label dictionary for the complex code (I8), and city -> region dictionary (F2).
COMPLEX_TYPE = {0: "detached", 1: "terraced", 2: "apartment", 3: "upstairs", 4: "downstairs",
                5: "maisonette", 6: "studio", 7: "senior"}
CITY_REGION = {"nation_0": "north", "nation_1": "north", "nation_2": "east", "nation_3": "south",
               "nation_4": "west", "nation_5": "west", "nation_6": "centre"}
# Per-region price constant.
REGION_PRICE = {"AFRICA": 1.10, "AMERICA": 1.25, "ASIA": 0.95, "EUROPE": 1.40}
# Rent bands (F10) that fit the stand-in's rents: right-closed edges and labels, null -> unknown.
RENT_EDGES = (300.0, 450.0, 600.0, 900.0)
RENT_LABELS = ("low", "moderate", "middle", "upper", "top")
RENT_UNKNOWN = "unknown"


def rate_text(discount):
    """Decimal-comma rate text derived from a discount: 0.05 -> '0,005'."""
    return F.concat(F.lit("0,"), F.lpad(F.round(discount * 100).cast("int").cast("string"), 3, "0"))


RATE_TEXT_SQL = "'0,' || lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 3, '0')"


def complex_rates(spark, d):
    """Per-complex (supplier nation) rate table in decimal-comma text, one row per nation."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_discount")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    g = (li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey")
         .agg(F.floor(F.sum(cents) * 10.0 / F.count(F.lit(1))).cast("bigint").alias("__r")))
    return g.select(F.col("s_nationkey").alias("rate_complex"),
                    F.concat(F.lit("0,"), F.lpad(F.col("__r").cast("string"), 3, "0")).alias("rate_text"))


COMPLEX_RATES_SQL = """
rates AS (
  SELECT s_nationkey AS rate_complex,
         '0,' || lpad(CAST(CAST(floor(sum(CAST(round(l_discount * 100) AS BIGINT)) * 10.0 / count(*)) AS BIGINT) AS VARCHAR), 3, '0') AS rate_text
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey
)"""


# ------------------------------------------------------------------ S: sources

@query("scan_count", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in SCAN_TABLES))
def q_scan_count(spark, d):
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
             for t in SCAN_TABLES]
    return joins.union_rows(*parts)


@query("parse_decimal_comma", f"""
SELECT rate_text, CAST(replace(rate_text, ',', '.') AS DOUBLE) AS rate, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {RATE_TEXT_SQL} AS rate_text FROM lineitem) GROUP BY rate_text""")
def q_parse_decimal(spark, d):
    li = table(spark, d, "lineitem").select(rate_text(F.col("l_discount")).alias("rate_text"))
    return (li.withColumn("rate", C.parse_decimal("rate_text"))
            .groupBy("rate_text", "rate").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ P: projections / filters

@query("coerce_numeric", """
SELECT o_orderkey AS contract_id,
       coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT), 0) AS priority_num,
       coalesce(TRY_CAST(o_orderstatus AS BIGINT), 0) AS status_num,
       TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price_num
FROM orders""")
def q_coerce_numeric(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("contract_id"),
                    C.coerce_numeric(F.substring("o_orderpriority", 1, 1), "bigint", 0).alias("priority_num"),
                    C.coerce_numeric("o_orderstatus", "bigint", 0).alias("status_num"),
                    C.coerce_numeric("o_totalprice", "double").alias("price_num"))


@query("coerce_timestamp", """
SELECT contract_id, CAST(year(ts) AS DOUBLE) AS start_year, strftime(ts, '%Y-%m-%d') AS start_text
FROM (SELECT o_orderkey AS contract_id,
             try_strptime(CASE WHEN o_orderstatus = 'P' THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END,
                          '%Y-%m-%d') AS ts
      FROM orders)""")
def q_coerce_timestamp(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ts = C.coerce_timestamp(raw, "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("contract_id"), ts.alias("ts")).select(
        "contract_id", F.year("ts").cast("double").alias("start_year"), F.date_format("ts", "yyyy-MM-dd").alias("start_text"))


@query("null_out_sentinels", with_contracts("""
SELECT contract_id,
       CASE WHEN discount = 0 THEN NULL ELSE discount END AS discount,
       CASE WHEN prop_type IN ('BUILDING', '') THEN NULL ELSE prop_type END AS prop_type,
       CAST(year(CASE WHEN demolish_ts = TIMESTAMP '9999-12-31 00:00:00' THEN NULL ELSE demolish_ts END) AS DOUBLE) AS demolish_year
FROM contracts"""))
def q_null_out(spark, d):
    df = C.null_out_columns(contracts(spark, d), {
        "discount": [0.0], "prop_type": ["BUILDING", ""],
        "demolish_ts": [F.lit(SENTINEL_DATE).cast("timestamp_ntz")]})
    return df.select("contract_id", "discount", "prop_type", F.year("demolish_ts").cast("double").alias("demolish_year"))


@query("compose_key", with_contracts("""
SELECT contract_id, 'HO ' || CAST(complex_id AS VARCHAR) || '/' || CAST(property_id AS VARCHAR) || '/' || CAST(contract_id AS VARCHAR) AS unit_key
FROM contracts"""))
def q_compose_key(spark, d):
    df = contracts(spark, d)
    return df.select("contract_id", C.compose_key(["complex_id", "property_id", "contract_id"], prefix="HO ").alias("unit_key"))


@query("filter_cutoff", with_contracts(f"SELECT contract_id, start_year FROM lc WHERE start_year >= {CUTOFF_YEAR}"))
def q_filter_cutoff(spark, d):
    df = labelled_contracts(spark, d)
    return df.where(F.col("start_year") >= CUTOFF_YEAR).select("contract_id", "start_year")


@query("drop_nulls_subset", with_contracts("""
SELECT contract_id, duration_days FROM contracts WHERE duration_days IS NOT NULL AND area IS NOT NULL AND room1 IS NOT NULL"""))
def q_drop_nulls(spark, d):
    df = filters.drop_nulls(contracts(spark, d), subset=["duration_days", "area", "room1"])
    return df.select("contract_id", "duration_days")


@query("split_cutoff_rest", with_contracts("""
SELECT contract_id, CASE WHEN coalesce(year(end_ts) < 1998, false) THEN 'before' ELSE 'rest' END AS part FROM contracts"""))
def q_split_cutoff(spark, d):
    df = contracts(spark, d).select("contract_id", "end_ts")
    yes, rest = filters.split_by(df, F.year("end_ts") < 1998)
    return joins.union_rows(yes.select("contract_id", F.lit("before").alias("part")),
                            rest.select("contract_id", F.lit("rest").alias("part")))


@query("split_labeled", with_contracts("""
SELECT contract_id, CAST(label IS NOT NULL AS INTEGER) AS is_labeled FROM lc"""))
def q_split_labeled(spark, d):
    df = labelled_contracts(spark, d).select("contract_id", "label")
    lab, unl = filters.split_labeled(df, "label")
    return joins.union_rows(lab.select("contract_id", F.lit(1).alias("is_labeled")),
                            unl.select("contract_id", F.lit(0).alias("is_labeled")))


@query("filter_abs", with_contracts("SELECT contract_id, acctbal FROM contracts WHERE abs(acctbal) > 5000"))
def q_filter_abs(spark, d):
    return filters.filter_abs(contracts(spark, d).select("contract_id", "acctbal"), "acctbal", 5000)


@query("numeric_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n FROM lineitem"
    for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")))
def q_numeric_columns(spark, d):
    df = table(spark, d, "lineitem")
    cols = [c for c in filters.select_by_type(df, "number") if c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]
    one = df.agg(*[F.count(c).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in cols])).alias("s")).select("s.*")


# ------------------------------------------------------------------ S2, S4-S6: round trips through the shared folder

def stage_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


NARROW_SQL = "SELECT contract_id, status, value, discount FROM contracts"


@query("stage_roundtrip", with_contracts(NARROW_SQL))
def q_stage(spark, d):
    return io.materialize_stage(contracts(spark, d).select("contract_id", "status", "value", "discount"), stage_path(spark, "stage"))


@query("delimited_roundtrip", with_contracts(NARROW_SQL))
def q_delimited(spark, d):
    df = contracts(spark, d).select("contract_id", "status", "value", "discount")
    path = stage_path(spark, "delimited")
    io.write_table(df, path, fmt="csv", sep=";")
    return io.read_delimited(spark, path, schema=df.schema)


@query("split_roundtrip", with_contracts(
    "SELECT contract_id, value FROM contracts WHERE CAST(year(start_ts) AS INTEGER) = 1996 AND status = 'O'"))
def q_split_roundtrip(spark, d):
    df = contracts(spark, d).select("contract_id", "value", F.year("start_ts").cast("string").alias("scheme"), F.col("status").alias("split"))
    path = stage_path(spark, "splits")
    io.write_splits(df, path)
    return io.read_split(spark, path, "1996", "O").select("contract_id", "value")


SPARSE_COLS = ("end_ts", "duration_days", "area", "room1", "room2", "room3", "discount", "demolish_ts")


@query("drop_sparse_columns", with_contracts(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {R4(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0')} AS missing_pct, "
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 > 50.0 AS dropped FROM c2"
    for c in SPARSE_COLS), """c2 AS (
  SELECT end_ts, duration_days, area, room1, room2, room3,
         CASE WHEN discount = 0 THEN NULL ELSE discount END AS discount,
         CASE WHEN demolish_ts = TIMESTAMP '9999-12-31 00:00:00' THEN NULL ELSE demolish_ts END AS demolish_ts
  FROM contracts)"""))
def q_drop_sparse(spark, d):
    df = C.null_out_columns(contracts(spark, d), {"discount": [0.0],
                                                   "demolish_ts": [F.lit(SENTINEL_DATE).cast("timestamp_ntz")]})
    rep = filters.sparse_column_report(df.select(*SPARSE_COLS), 50.0)
    return rep.select("column_name", r4("missing_pct").alias("missing_pct"), "dropped")


PROXIES = ("n_tenants", "n_short", "n_long", "share_short", "share_long", "ratio_short_long",
           "ratio_long_short", "turnover", "seq", "prev_label", "prev_label_code", "not_a_column")


@query("drop_proxies", with_contracts(f"""
SELECT contract_id, property_id, {R4('value')} AS value, area, complex_id, prop_type, label
FROM lc"""))
def q_drop_proxies(spark, d):
    from tabwright.operators.groups import tenancy_history
    df = labelled_contracts(spark, d).withColumn("house_age", F.lit(1))
    hist = tenancy_history(df, "property_id", "contract_id", "label", "house_age")
    kept = filters.drop_proxies(hist, PROXIES)
    return kept.select("contract_id", "property_id", r4("value").alias("value"), "area", "complex_id", "prop_type", "label")


# ------------------------------------------------------------------ J: joins

@query("join_left_contract", f"""
SELECT o.o_orderkey AS contract_id, c.c_name AS c_name, {R4('c.c_acctbal')} AS c_acctbal
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_join_left_contract(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    j = joins.enrich(o, c, on=[("o_custkey", "c_custkey")])
    return j.select(F.col("o_orderkey").alias("contract_id"), "c_name", r4("c_acctbal").alias("c_acctbal"))


@query("join_left_null_safe", """
WITH seg AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg, c_custkey FROM customer),
     segdim AS (SELECT seg AS seg_key, count(*) AS seg_customers FROM seg GROUP BY seg)
SELECT s.c_custkey AS property_id, s.seg, CAST(d.seg_customers AS BIGINT) AS seg_customers
FROM seg s LEFT JOIN segdim d ON s.seg IS NOT DISTINCT FROM d.seg_key""")
def q_join_null_safe(spark, d):
    c = table(spark, d, "customer")
    seg = c.select(C.null_out("c_mktsegment", ["BUILDING"]).alias("seg"), "c_custkey")
    dim = seg.groupBy(F.col("seg").alias("seg_key")).agg(F.count(F.lit(1)).alias("seg_customers"))
    j = joins.enrich(seg, dim, on=[("seg", "seg_key")], null_safe=True)
    return j.select(F.col("c_custkey").alias("property_id"), "seg", "seg_customers")


@query("join_left_rate", with_contracts("""
SELECT c.contract_id, r.rate_text, CAST(replace(r.rate_text, ',', '.') AS DOUBLE) AS rate
FROM contracts c LEFT JOIN rates r ON c.complex_id = r.rate_complex""", COMPLEX_RATES_SQL))
def q_join_left_rate(spark, d):
    df = contracts(spark, d).select("contract_id", "complex_id")
    j = joins.enrich(df, complex_rates(spark, d), on=[("complex_id", "rate_complex")])
    return j.select("contract_id", "rate_text", C.parse_decimal("rate_text").alias("rate"))


UNITS_SQL = """
units AS (
  SELECT 'HO ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS unit_key, max(l_tax) AS unit_rate
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""


def units(spark, d):
    li = table(spark, d, "lineitem")
    return (li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("unit_rate"))
            .select(C.compose_key(["l_orderkey", "l_linenumber"], prefix="HO ").alias("unit_key"), "unit_rate"))


@query("join_left_composite", with_contracts("""
SELECT c.contract_id, c.k AS unit_key, u.unit_rate
FROM (SELECT contract_id, 'HO ' || CAST(contract_id AS VARCHAR) || '/1' AS k FROM contracts) c
LEFT JOIN units u ON c.k = u.unit_key""", UNITS_SQL))
def q_join_left_composite(spark, d):
    df = contracts(spark, d).select("contract_id", C.compose_key(["contract_id", F.lit(1)], prefix="HO ").alias("k"))
    j = joins.enrich(df, units(spark, d), on=[("k", "unit_key")])
    return j.select("contract_id", F.col("k").alias("unit_key"), "unit_rate")


@query("join_suffix", with_contracts("""
SELECT c.contract_id, c.area AS area_x, f.area AS area_y, c.discount AS discount_x, f.discount AS discount_y
FROM contracts c LEFT JOIN (
  SELECT l_orderkey, min(l_discount) AS discount, max(l_quantity) AS area FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey
) f ON c.contract_id = f.l_orderkey"""))
def q_join_suffix(spark, d):
    df = contracts(spark, d).select("contract_id", "area", "discount")
    li = table(spark, d, "lineitem").where(F.col("l_linenumber") == 1)
    first = li.groupBy("l_orderkey").agg(F.min("l_discount").alias("discount"), F.max("l_quantity").alias("area"))
    j = joins.enrich(df, first, on=[("contract_id", "l_orderkey")])
    return j.select("contract_id", "area_x", "area_y", "discount_x", "discount_y")


@query("anti_rest", with_contracts(f"""
SELECT contract_id FROM lc WHERE contract_id NOT IN (SELECT contract_id FROM lc WHERE start_year < {CUTOFF_YEAR})"""))
def q_anti_rest(spark, d):
    df = labelled_contracts(spark, d).select("contract_id", "start_year")
    taken = df.where(F.col("start_year") < CUTOFF_YEAR)
    return joins.anti_rest(df, taken, "contract_id").select("contract_id")


@query("semi_in_list", with_contracts("""
SELECT contract_id FROM contracts
WHERE prop_type IN ('AUTOMOBILE', 'MACHINERY')
  AND property_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"""))
def q_semi_in(spark, d):
    df = contracts(spark, d).select("contract_id", "prop_type", "property_id")
    rich = table(spark, d, "customer").where(F.col("c_acctbal") > 5000)
    df = joins.semi_in(df, "prop_type", ["AUTOMOBILE", "MACHINERY"])
    return joins.semi_in(df, "property_id", rich, "c_custkey").select("contract_id")


# ------------------------------------------------------------------ U: set operations

@query("union_unlabeled", with_contracts("""
SELECT contract_id, target FROM lc WHERE label IS NOT NULL
UNION ALL
SELECT contract_id, -1 AS target FROM lc WHERE label IS NULL"""))
def q_union_unlabeled(spark, d):
    df = labelled_contracts(spark, d).select("contract_id", "label", "target")
    lab, unl = filters.split_labeled(df, "label")
    return joins.union_unlabeled(lab.select("contract_id", "target"), unl.select("contract_id"), "target")


@query("distinct_values", "SELECT DISTINCT c_mktsegment AS prop_type FROM orders JOIN customer ON o_custkey = c_custkey")
def q_distinct(spark, d):
    return joins.distinct_values(contracts(spark, d), "prop_type")


# ------------------------------------------------------------------ I: rules

@query("fill_const", with_contracts("""
SELECT contract_id, coalesce(room1, 0.0) AS room1, coalesce(room2, 0.0) AS room2, coalesce(room3, 0.0) AS room3 FROM contracts"""))
def q_fill_const(spark, d):
    return impute.fill_const(contracts(spark, d), ["room1", "room2", "room3"], 0).select(
        "contract_id", "room1", "room2", "room3")


@query("missing_flags", with_contracts("""
SELECT contract_id,
       CAST(coalesce(room1 > 0, false) AS INTEGER) AS room1_flag,
       CAST(coalesce(room2 > 0, false) AS INTEGER) AS room2_flag,
       CAST(coalesce(room3 > 0, false) AS INTEGER) AS room3_flag,
       CAST(end_ts IS NULL AS INTEGER) AS end_missing_flag,
       CAST(coalesce(discount = 0, false) AS INTEGER) AS zero_discount_flag
FROM contracts"""))
def q_missing_flags(spark, d):
    df = impute.add_flags(contracts(spark, d), {
        "room1_flag": F.col("room1") > 0, "room2_flag": F.col("room2") > 0, "room3_flag": F.col("room3") > 0,
        "end_missing_flag": F.col("end_ts").isNull(), "zero_discount_flag": F.col("discount") == 0})
    return df.select("contract_id", "room1_flag", "room2_flag", "room3_flag", "end_missing_flag", "zero_discount_flag")


@query("flag_and_fill", with_contracts("""
SELECT contract_id,
       CAST(end_ts IS NULL AS INTEGER) AS end_ts_missing,
       strftime(coalesce(end_ts, TIMESTAMP '2100-12-31 00:00:00'), '%Y-%m-%d') AS end_date,
       CAST(duration_days IS NULL AS INTEGER) AS duration_days_missing,
       coalesce(duration_days, -1) AS duration_days,
       CAST(pt IS NULL AS INTEGER) AS prop_type_missing,
       coalesce(pt, 'N.v.t.') AS prop_type
FROM (SELECT *, CASE WHEN prop_type = 'BUILDING' THEN NULL ELSE prop_type END AS pt FROM contracts)"""))
def q_flag_and_fill(spark, d):
    df = contracts(spark, d).withColumn("prop_type", C.null_out("prop_type", ["BUILDING"]))
    df = impute.flag_and_fill(df, {"end_ts": "2100-12-31 00:00:00", "duration_days": -1, "prop_type": "N.v.t."})
    return df.select("contract_id", "end_ts_missing", F.date_format("end_ts", "yyyy-MM-dd").alias("end_date"),
                     "duration_days_missing", "duration_days", "prop_type_missing", "prop_type")


@query("fill_when_rules", with_contracts("""
SELECT contract_id,
       coalesce(pt, CASE WHEN complex_id IN (1, 2, 3) THEN 'TYPE_A'
                         WHEN city = 'NATION_5' THEN 'TYPE_B'
                         WHEN region = 'ASIA' THEN 'TYPE_C' END) AS prop_type
FROM (SELECT *, CASE WHEN prop_type = 'BUILDING' THEN NULL ELSE prop_type END AS pt FROM contracts)"""))
def q_fill_when(spark, d):
    df = contracts(spark, d).withColumn("prop_type", C.null_out("prop_type", ["BUILDING"]))
    df = impute.fill_when(df, "prop_type", [(F.col("complex_id").isin(1, 2, 3), "TYPE_A"),
                                            (F.col("city") == "NATION_5", "TYPE_B"),
                                            (F.col("region") == "ASIA", "TYPE_C")])
    return df.select("contract_id", "prop_type")


@query("fill_nested_case", with_contracts("""
SELECT contract_id,
       CASE WHEN status = 'P' THEN 0.0 WHEN dz IS NULL THEN -1.0 ELSE dz END AS energy
FROM (SELECT *, CASE WHEN discount = 0 THEN NULL ELSE discount END AS dz FROM contracts)"""))
def q_fill_nested(spark, d):
    df = contracts(spark, d).withColumn("dz", C.null_out("discount", [0.0]))
    return df.select("contract_id", impute.case_when(
        [(F.col("status") == "P", 0.0), (F.col("dz").isNull(), -1.0)], F.col("dz")).alias("energy"))


@query("rule_any_positive", with_contracts("""
SELECT contract_id,
       CASE WHEN prop_type = 'HOUSEHOLD'
            THEN CASE WHEN coalesce(room1 > 0, false) OR coalesce(room2 > 0, false) OR coalesce(room3 > 0, false)
                      THEN 'WITH_ROOMS' ELSE 'NO_ROOMS' END
            ELSE prop_type END AS prop_type
FROM contracts"""))
def q_rule_any_positive(spark, d):
    df = impute.rule_any_positive(contracts(spark, d), "prop_type", "prop_type", "HOUSEHOLD",
                                  ["room1", "room2", "room3"], "WITH_ROOMS", "NO_ROOMS")
    return df.select("contract_id", "prop_type")


@query("rule_two_columns", with_contracts("""
SELECT contract_id,
       CASE WHEN status = 'F' THEN 'CLOSED' ELSE prop_type END AS prop_type,
       CASE WHEN status = 'F' THEN '0-NONE' ELSE priority END AS priority
FROM contracts"""))
def q_rule_two(spark, d):
    df = impute.rule_set_columns(contracts(spark, d), F.col("status") == "F",
                                 {"prop_type": "CLOSED", "priority": "0-NONE"})
    return df.select("contract_id", "prop_type", "priority")


def _map_case(col, mapping, quote):
    q = (lambda v: f"'{v}'") if quote else str
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN '{v}'" for k, v in mapping.items()) + " END"


def _num_case(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items()) + " END"


@query("map_fill", with_contracts(f"""
SELECT contract_id,
       coalesce(CASE WHEN prop_type = 'BUILDING' THEN NULL ELSE prop_type END, {_map_case('complex_id', COMPLEX_TYPE, False)}) AS type_label,
       coalesce({_map_case('complex_id', COMPLEX_TYPE, False)}, CAST(complex_id AS VARCHAR)) AS complex_label
FROM contracts"""))
def q_map_fill(spark, d):
    df = contracts(spark, d).withColumn("type_label", C.null_out("prop_type", ["BUILDING"]))
    df = impute.map_values(df, "complex_id", COMPLEX_TYPE, into="type_label", only_null=True)
    df = df.withColumn("complex_label", F.col("complex_id"))
    df = impute.map_values(df, "complex_label", COMPLEX_TYPE)
    return df.select("contract_id", "type_label", "complex_label")


@query("fill_formula", with_contracts(f"""
SELECT contract_id,
       coalesce(rent, CASE WHEN value > 0 THEN {RND('value * 0.0055', 2)} END) AS rent
FROM (SELECT *, CASE WHEN status = 'O' THEN NULL ELSE {RND('value / 100.0', 2)} END AS rent FROM contracts)"""))
def q_fill_formula(spark, d):
    df = contracts(spark, d).withColumn(
        "rent", F.when(F.col("status") != "O", rnd(F.col("value") / 100.0, 2)))
    df = impute.fill_formula(df, "rent", F.col("value") * 0.0055, cond=F.col("value") > 0, digits=2)
    return df.select("contract_id", "rent")


@query("fill_ratio", with_contracts(f"""
SELECT contract_id, {R4('coalesce(ppu, CASE WHEN coalesce(area > 0, false) THEN value / area END)')} AS ppu
FROM (SELECT *, CASE WHEN status = 'F' THEN value / 1000.0 END AS ppu FROM contracts)"""))
def q_fill_ratio(spark, d):
    df = contracts(spark, d).withColumn("ppu", F.when(F.col("status") == "F", F.col("value") / 1000.0))
    df = impute.fill_ratio(df, "ppu", "value", "area")
    return df.select("contract_id", r4("ppu").alias("ppu"))


@query("fill_group_constant", with_contracts(f"""
SELECT contract_id,
       coalesce(est, {RND(_num_case('region', REGION_PRICE) + ' * area', 2)}) AS est_value
FROM (SELECT *, CASE WHEN status = 'P' THEN NULL ELSE value END AS est FROM contracts)"""))
def q_fill_group_constant(spark, d):
    df = contracts(spark, d).withColumn("est_value", F.when(F.col("status") != "P", F.col("value")))
    df = impute.fill_group_constant(df, "region", REGION_PRICE, "est_value", scale="area", digits=2)
    return df.select("contract_id", "est_value")


@query("to_fixed", with_contracts(f"""
SELECT contract_id, {RND('value / area', 2)} AS ppu, printf('%.2f', {RND('value / area', 2)}) AS ppu_text
FROM contracts"""))
def q_to_fixed(spark, d):
    df = contracts(spark, d)
    ratio = C.safe_div("value", "area")
    return df.select("contract_id", C.to_fixed(ratio, 2).alias("ppu"), C.to_fixed(ratio, 2, as_text=True).alias("ppu_text"))


# ------------------------------------------------------------------ F: scalar functions

@query("normalize_lookup", with_contracts(f"""
SELECT contract_id, lower(trim(city)) AS city_key,
       coalesce({_map_case('lower(trim(city))', CITY_REGION, True)}, 'Unknown Region') AS region_label
FROM contracts"""))
def q_normalize_lookup(spark, d):
    df = contracts(spark, d).withColumn("city_key", C.normalize_text("city"))
    return df.select("contract_id", "city_key", C.lookup("city_key", CITY_REGION, "Unknown Region").alias("region_label"))


@query("strip_letters", "SELECT p_partkey, regexp_replace(p_brand, '[A-Za-z]', '', 'g') AS brand_code FROM part")
def q_strip_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", C.strip_letters("p_brand").alias("brand_code"))


@query("year_parts", with_contracts("""
SELECT contract_id, CAST(year(start_ts) AS INTEGER) AS start_ts_year, CAST(year(end_ts) AS DOUBLE) AS end_ts_year,
       CAST(year(CASE WHEN demolish_ts = TIMESTAMP '9999-12-31 00:00:00' THEN NULL ELSE demolish_ts END) AS DOUBLE) AS demolish_ts_year
FROM contracts"""))
def q_year_parts(spark, d):
    df = C.null_out_columns(contracts(spark, d), {"demolish_ts": [F.lit(SENTINEL_DATE).cast("timestamp_ntz")]})
    df = C.add_years(df.select("contract_id", "start_ts", "end_ts", "demolish_ts"))
    return df.select("contract_id", "start_ts_year", F.col("end_ts_year").cast("double").alias("end_ts_year"),
                     F.col("demolish_ts_year").cast("double").alias("demolish_ts_year"))


HOUSE_AGE_SQL = f"""CAST(year(coalesce(CASE WHEN demolish_ts = TIMESTAMP '9999-12-31 00:00:00' THEN NULL ELSE demolish_ts END,
                          TIMESTAMP '{AS_OF} 00:00:00')) - build_year AS INTEGER)"""


def house_age(df):
    dem = C.null_out("demolish_ts", [F.lit(SENTINEL_DATE).cast("timestamp_ntz")])
    return (F.year(F.coalesce(dem, F.lit(AS_OF).cast("timestamp_ntz"))) - F.col("build_year")).cast("int")


@query("house_age", with_contracts(f"SELECT contract_id, {HOUSE_AGE_SQL} AS house_age FROM contracts"))
def q_house_age(spark, d):
    df = contracts(spark, d)
    return df.select("contract_id", house_age(df).alias("house_age"))


@query("threshold_label", with_contracts("SELECT contract_id, label, target FROM lc"))
def q_threshold_label(spark, d):
    return labelled_contracts(spark, d).select("contract_id", "label", "target")


AGE_SQL = "(start_year - birth_year)"


@query("bucketize", with_contracts(f"""
SELECT contract_id, age,
       CASE WHEN age >= 18 AND age < 100 THEN CAST(floor((age - 18) / 2) AS DOUBLE) END AS bucket,
       CASE WHEN age >= 18 AND age < 100 THEN CAST(18 + 2 * CAST(floor((age - 18) / 2) AS INTEGER) AS VARCHAR) || '-' ||
                                             CAST(19 + 2 * CAST(floor((age - 18) / 2) AS INTEGER) AS VARCHAR) END AS bucket_label
FROM (SELECT contract_id, CAST({AGE_SQL} AS INTEGER) AS age FROM lc)"""))
def q_bucketize(spark, d):
    df = labelled_contracts(spark, d).withColumn("age", (F.col("start_year") - F.col("birth_year")).cast("int"))
    b, lab = C.bucketize("age", 18, 100, 2)
    return df.select("contract_id", "age", b.cast("double").alias("bucket"), lab.alias("bucket_label"))


RENT_SQL = "value / area * 0.3"


@query("price_class", with_contracts(f"""
SELECT contract_id,
       CASE WHEN rent IS NULL THEN '{RENT_UNKNOWN}'
            {' '.join(f"WHEN rent <= {e} THEN '{l}'" for e, l in zip(RENT_EDGES, RENT_LABELS))}
            ELSE '{RENT_LABELS[-1]}' END AS price_class
FROM (SELECT contract_id, {RENT_SQL} AS rent FROM contracts)"""))
def q_price_class(spark, d):
    df = contracts(spark, d).withColumn("rent", F.col("value") / F.col("area") * 0.3)
    return df.select("contract_id", C.banded("rent", RENT_EDGES, RENT_LABELS, RENT_UNKNOWN).alias("price_class"))


@query("count_positive", with_contracts("""
SELECT contract_id, CAST(coalesce(room1 > 0, false) AS INTEGER) + CAST(coalesce(room2 > 0, false) AS INTEGER)
                    + CAST(coalesce(room3 > 0, false) AS INTEGER) AS n_rooms
FROM contracts"""))
def q_count_positive(spark, d):
    df = contracts(spark, d)
    return df.select("contract_id", C.count_positive(["room1", "room2", "room3"]).alias("n_rooms"))
