"""Audit physical plans of registered queries: cartesian / nested-loop joins, single-partition
exchanges, windows without partition keys, and the columns each parquet scan reads.

usage: python tools/plan_audit.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwright.plans.registry import QUERIES, load_all  # noqa: E402
from tabwright.session import build_session  # noqa: E402

FLAGS = {
    "cartesian": r"CartesianProduct",
    "nested_loop": r"BroadcastNestedLoopJoin",
    "single_partition": r"Exchange SinglePartition",
    "python_udf": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    load_all()
    spark = build_session()
    for k in keys or sorted(QUERIES):
        try:
            df = QUERIES[k](spark, sf_dir)
            txt = plan_text(df)
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} ERROR {str(e)[:120]}")
            continue
        hits = [name for name, pat in FLAGS.items() if re.search(pat, txt)]
        scans = sorted(set(re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", txt)))
        widest = max((len(s.split(",")) for s in scans), default=0)
        pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", txt))
        print(f"{k:28s} flags={','.join(hits) or '-':28s} scans={len(scans)} widest_scan_cols={widest} pushed_filters={pushed}")


if __name__ == "__main__":
    main()
