"""The ``contracts`` stand-in: one row per order, enriched like the merged contract table.

``orders`` LEFT JOIN (``lineitem`` aggregated per order) LEFT JOIN ``customer`` LEFT JOIN
``nation`` LEFT JOIN ``region``. The same view exists as SQL (``CONTRACTS_CTE``) for the DuckDB
oracle; both must stay in lock step.

Plan shape at scale: ``lineitem`` is shuffled on ``l_orderkey`` and aggregated there. An order has few lines, and
they need not lie together in the file, so a map-side aggregate would hold nearly every order of its
split and spill. The partitioning is reused by the sort-merge join with ``orders``, so only ``orders``
moves for that join. ``customer`` grows with the data and is joined
by whatever AQE decides from runtime sizes (broadcast only under the size threshold). ``nation`` and
``region`` are fixed 25/5-row dimensions and are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.sources.io import read_table
from tabwright.functions.columns import threshold_label, binary_target

# Fixed values of the stand-in mapping: a label boundary of 730 days plays the reference's
# three years, and 1997 plays its cut-off year.
LABEL_DAYS = 730
CUTOFF_YEAR = 1997
AS_OF = "2024-01-01"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order facts from ``lineitem`` in a single aggregate (no pivot shuffle) on rows moved by order."""
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    room = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity")))
    return (li.groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("end_ts"),
                 F.sum("l_quantity").alias("area"),
                 room(1).alias("room1"), room(2).alias("room2"), room(3).alias("room3"),
                 F.min("l_discount").alias("discount"),
                 F.count(F.lit(1)).alias("n_lines")))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    lines = order_lines(spark, sf_dir)
    df = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(c, o.o_custkey == c.c_custkey, "left")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
          .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))
    pid = F.col("o_custkey")
    return df.select(
        F.col("o_orderkey").alias("contract_id"),
        pid.alias("property_id"),
        F.col("o_orderdate").alias("start_ts"),
        F.col("end_ts"),
        F.datediff(F.to_date("end_ts"), F.to_date("o_orderdate")).alias("duration_days"),
        F.col("o_totalprice").alias("value"),
        "area", "room1", "room2", "room3", "discount", "n_lines",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").alias("complex_id"),
        F.col("c_mktsegment").alias("prop_type"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        (F.lit(1950) + (pid % 60)).cast("int").alias("build_year"),
        (F.lit(1900) + (pid % 85)).cast("int").alias("birth_year"),
        F.when(pid % 7 == 0, F.make_timestamp_ntz(F.lit(2020) + pid % 5, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
         .otherwise(F.make_timestamp_ntz(F.lit(9999), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)))
         .alias("demolish_ts"),
    )


def labelled_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contracts`` plus the class label, binary target and period flags."""
    df = contracts(spark, sf_dir)
    return df.withColumns({
        "label": threshold_label("duration_days", LABEL_DAYS),
        "target": binary_target("duration_days", LABEL_DAYS),
        "start_year": F.year("start_ts"),
    })


# The same view in SQL (DuckDB dialect) for the oracle.
CONTRACTS_CTE = f"""
lines AS (
  SELECT l_orderkey,
         max(l_shipdate) AS end_ts,
         sum(l_quantity) AS area,
         max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS room1,
         max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS room2,
         max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS room3,
         min(l_discount) AS discount,
         count(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey
),
contracts AS (
  SELECT o.o_orderkey AS contract_id,
         o.o_custkey AS property_id,
         o.o_orderdate AS start_ts,
         li.end_ts,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.end_ts AS DATE)) AS INTEGER) AS duration_days,
         o.o_totalprice AS value,
         li.area, li.room1, li.room2, li.room3, li.discount, li.n_lines,
         o.o_orderstatus AS status,
         o.o_orderpriority AS priority,
         c.c_nationkey AS complex_id,
         c.c_mktsegment AS prop_type,
         c.c_acctbal AS acctbal,
         n.n_name AS city,
         r.r_name AS region,
         CAST(1950 + o.o_custkey % 60 AS INTEGER) AS build_year,
         CAST(1900 + o.o_custkey % 85 AS INTEGER) AS birth_year,
         CASE WHEN o.o_custkey % 7 = 0 THEN make_timestamp(CAST(2020 + o.o_custkey % 5 AS BIGINT), 1, 1, 0, 0, 0)
              ELSE TIMESTAMP '9999-12-31 00:00:00' END AS demolish_ts
  FROM orders o
  LEFT JOIN lines li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
lc AS (
  SELECT *,
         CASE WHEN duration_days <= {LABEL_DAYS} THEN '<=3' WHEN duration_days IS NOT NULL THEN '>3' END AS label,
         CAST(coalesce(duration_days > {LABEL_DAYS}, false) AS INTEGER) AS target,
         CAST(year(start_ts) AS INTEGER) AS start_year
  FROM contracts
)
"""


def with_contracts(sql_body: str, extra_ctes: str = "") -> str:
    """Prefix a query with the contracts CTEs (and optional further CTEs)."""
    more = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {CONTRACTS_CTE}{more}\n{sql_body}"
