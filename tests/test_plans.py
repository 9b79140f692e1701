"""Plan-shape guards: no cartesian or nested-loop joins, scans read only the needed columns."""

import re

import pytest

from tabwright.plans.registry import QUERIES, load_all
from tools.plan_audit import plan_text

load_all()
SF = "/root/testdata/sf0.001"
KEYS = ["class_balance", "describe_numeric", "group_mean_property", "tenant_sequence", "rolling_mean",
        "one_hot", "chi2_stat", "features_per_split", "knn_join", "knn_graph", "fill_group_constant",
        "roc_auc", "moving_average_valid", "running_best"]


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_and_pruned_scans(spark, key):
    txt = plan_text(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in txt
    assert "BroadcastNestedLoopJoin" not in txt
    for cols in re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", txt):
        assert len(cols.split(",")) <= 6, cols


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from tabwright.plans.contracts import table
    df = table(spark, SF, "lineitem").where(F.col("l_linenumber") == 1).select("l_orderkey")
    txt = plan_text(df)
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in txt


def test_windows_and_box_need_no_second_sort(spark):
    """Neighbours: one hash exchange for the local windows over the written ranges, no join of the rows
    with themselves; quantiles: no range exchange."""
    from tabwright.operators import profile, window
    df = spark.range(0, 5000).selectExpr("id", "id % 7 as k", "id * 3 % 11 * 1D as v")
    txt = plan_text(window.rolling_mean(df, "k", ["id"], "v", "m", n=4))
    main = txt.split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in main and "rangepartitioning" not in txt
    box = plan_text(profile.box_stats(df, "v", by=["k"]))
    assert "rangepartitioning" not in box and "Scan ExistingRDD" not in box


def test_contract_lines_move_before_they_are_aggregated(spark, tmp_path):
    """No aggregate of ``lineitem`` below its exchange, where lines in no order would fill the map side; repeated
    and null keys keep their rows."""
    from tabwright.plans.contracts import contracts
    day = "timestamp_ntz'1996-01-0{}'".format
    tables = {
        "region": "select 1L as r_regionkey, 'ASIA' as r_name",
        "nation": "select 1 as n_nationkey, 'N' as n_name, 1L as n_regionkey",
        "customer": "select * from values (1L, 1, 5D, 'A'), (1L, 1, 6D, 'B'), (null, 1, 7D, 'C') as t(c_custkey, c_nationkey, c_acctbal, c_mktsegment)",
        "orders": f"select *, 'O' as o_orderstatus, 9D as o_totalprice, {day(1)} as o_orderdate, 'LOW' as o_orderpriority "
                  "from values (1L, 1L), (2L, 2L), (null, null), (3L, 1L) as t(o_orderkey, o_custkey)",
        "lineitem": f"select *, {day(5)} as l_shipdate from values (1L, 1, 2D, 0.1D), (null, 1, 8D, 0.5D), (2L, 1, 4D, 0.3D), (1L, 2, 3D, 0.2D), (1L, 1, 5D, 0.4D) "
                    "as t(l_orderkey, l_linenumber, l_quantity, l_discount)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    df = contracts(spark, str(tmp_path)).select("contract_id", "acctbal", "area", "room1", "room2", "discount", "n_lines", "duration_days")
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted([(1, 5.0, 10.0, 5.0, 3.0, 0.1, 3, 4), (1, 6.0, 10.0, 5.0, 3.0, 0.1, 3, 4), (2, None, 4.0, 4.0, None, 0.3, 1, 4),
                          (3, 5.0, None, None, None, None, None, None), (3, 6.0, None, None, None, None, None, None),
                          (None, None, None, None, None, None, None, None)], key=repr)
    txt = plan_text(df)
    assert txt.rindex("Exchange hashpartitioning(l_orderkey") > txt.rindex("HashAggregate(keys=[l_orderkey")
