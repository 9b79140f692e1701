"""Group statistics broadcast back to rows.

``groupBy().agg()`` + join instead of ``avg().over(partitionBy(key))``: the aggregate is partial
(map-side combine) so a key holding a third of the rows never sits in one task, and the joined
side has one row per key (AQE broadcasts it when small, otherwise a sort-merge join whose skewed
partitions AQE splits). Distinct counts are two-level aggregates, also skew-safe; Spark has no
distinct count over windows anyway.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import safe_div


def _attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Plain equality: a null key gets null statistics (pandas drops null groups). Rows without a key
    # match nothing; a salt spreads them, or they would all be shuffled to one task.
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salt = F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("int"))
    return df.withColumn("__salt", salt).join(stats.withColumn("__salt", F.lit(0)), [*keys, "__salt"], "left").drop("__salt")


def group_apply(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Generic: aggregate per key, attach to every row of the key."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return _attach(df, stats, keys)


def group_mean(df: DataFrame, key: str | Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of ``value`` per key on every row (``groupby().transform('mean')``)."""
    keys = [key] if isinstance(key, str) else list(key)
    return group_apply(df, keys, {out: F.avg(value)})


def group_nunique(df: DataFrame, key: str | Sequence[str], value: str, out: str) -> DataFrame:
    """Number of distinct ``value`` per key on every row."""
    keys = [key] if isinstance(key, str) else list(key)
    return group_apply(df, keys, {out: F.count_distinct(value)})


def group_nunique_if(df: DataFrame, key: str | Sequence[str], value: str,
                     conds: Mapping[str, Column], fill: int = 0) -> DataFrame:
    """Distinct count of ``value`` among rows meeting each condition, per key, on every row
    of the key; keys without a matching row get ``fill`` (0). One aggregate per (key, value) keeps
    whether any row met each condition, a second one counts: no row is expanded per condition."""
    keys = [key] if isinstance(key, str) else list(key)
    met = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")) \
        .agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conds.items()])
    stats = met.groupBy(*keys).agg(*[F.count_if(F.col(n)).alias(n) for n in conds])
    return _attach(df, stats, keys).withColumns({n: F.coalesce(F.col(n), F.lit(fill)) for n in conds})


def tenancy_history(df: DataFrame, key: str, contract: str, label: str, age: str,
                    short: str = "<=3", long: str = ">3", eps: float = 1e-9) -> DataFrame:
    """A12-A15 bundle: tenants per property, short/long counts, shares, ratios and turnover.

    * ``n_tenants`` distinct contracts per property; ``n_short``/``n_long`` distinct contracts
      with each label (0 when none), on every row of the property.
    * ``share_short``/``share_long`` = count / n_tenants, undefined -> 0.
    * ``ratio_short_long`` = n_short / (n_long + eps) and the reverse.
    * ``turnover`` = n_tenants / age, +-inf and undefined -> 0.
    """
    out = group_nunique_if(df, key, contract, {
        "n_tenants": F.lit(True), "n_short": F.col(label) == short, "n_long": F.col(label) == long})
    return out.withColumns({
        "share_short": safe_div("n_short", "n_tenants", 0.0),
        "share_long": safe_div("n_long", "n_tenants", 0.0),
        "ratio_short_long": F.col("n_short") / (F.col("n_long") + F.lit(eps)),
        "ratio_long_short": F.col("n_long") / (F.col("n_short") + F.lit(eps)),
        "turnover": safe_div("n_tenants", age, 0.0),
    })
