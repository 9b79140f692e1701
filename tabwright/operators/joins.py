"""Joins and set operations.

Only left equi-joins exist in the source workload. Join strategy is left to Catalyst + AQE:
a side is broadcast only when its size is checked (explicit ``broadcast=True`` for small
dimensions) or when AQE's runtime statistics put it under
``spark.sql.autoBroadcastJoinThreshold``; otherwise a sort-merge join with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BROADCAST_ROWS = 100_000


def enrich(df: DataFrame, dim: DataFrame, on: Sequence[tuple[str, str]], how: str = "left",
           suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False,
           broadcast: bool = False) -> DataFrame:
    """Left join on differently named keys.

    * ``null_safe=True`` matches null keys with each other (pandas ``merge`` does), via ``<=>``.
    * Non-key columns present on both sides get ``suffixes`` (pandas ``_x``/``_y``); Spark would
      otherwise keep two columns of the same name.
    * The right-hand key columns are dropped when they carry the same name as the left keys.
    * ``broadcast=True`` is taken up only after a count shows that ``dim`` has at most
      ``BROADCAST_ROWS`` rows; a larger side is left to AQE.
    """
    left_keys = {l for l, _ in on}
    right_keys = {r for _, r in on}
    clash = (set(df.columns) & set(dim.columns)) - (left_keys & right_keys)
    lren = {c: f"{c}{suffixes[0]}" for c in clash if c not in left_keys}
    rren = {c: f"{c}{suffixes[1]}" for c in clash if c not in right_keys}
    left = df.withColumnsRenamed(lren) if lren else df
    right = dim.withColumnsRenamed(rren) if rren else dim
    # Right keys that clash with left keys are renamed to private names for the condition.
    rkey = {r: (f"__r_{r}" if r in left.columns else r) for _, r in on}
    right = right.withColumnsRenamed({r: n for r, n in rkey.items() if n != r})
    if broadcast and dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    conds = []
    for l, r in on:
        lc, rc = left[l], right[rkey[r]]
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    out = left.join(right, cond, how)
    private = [n for r, n in rkey.items() if n != r]
    same_name = [rkey[r] for l, r in on if l == r]
    return out.drop(*set(private) | set(same_name))


def anti_rest(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``taken`` (``~index.isin``)."""
    return df.join(taken.select(id_col), id_col, "left_anti")


def semi_in(df: DataFrame, col: str, values: Sequence | DataFrame, other_col: str | None = None) -> DataFrame:
    """Membership. Literal lists become ``isin``; a table becomes a left-semi join."""
    if isinstance(values, DataFrame):
        oc = other_col or col
        keys = values.select(F.col(oc).alias("__k")).where(F.col("__k").isNotNull())
        return df.join(keys, df[col] == keys["__k"], "left_semi")
    return df.where(F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def union_rows(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Row union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def union_unlabeled(labeled: DataFrame, unlabeled: DataFrame, label: str, fill: int = -1) -> DataFrame:
    """Labelled rows plus unlabelled rows carrying ``fill`` as label."""
    return labeled.unionByName(unlabeled.withColumn(label, F.lit(fill).cast(labeled.schema[label].dataType)))


def name_overlap(a: DataFrame, b: DataFrame, col: str = "column_name") -> DataFrame:
    """Venn data of two name lists: (column_name, part) with part in
    ``both`` / ``only_a`` / ``only_b``."""
    a1, b1 = a.select(col).distinct(), b.select(col).distinct()
    both = a1.intersect(b1).withColumn("part", F.lit("both"))
    only_a = a1.exceptAll(b1).withColumn("part", F.lit("only_a"))
    only_b = b1.exceptAll(a1).withColumn("part", F.lit("only_b"))
    return both.unionByName(only_a).unionByName(only_b)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (partial distinct per partition, then one shuffle)."""
    return df.select(col).distinct()
