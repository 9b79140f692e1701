"""Sequence operators inside groups (W1-W5), skew-proof.

A ``Window.partitionBy(key)`` puts every row of a key into one task; with a key holding a third of
the data that is one task for a third of the data. These operators work on a range-sorted table
(``ordering.neighbours``): windows inside (range partition, key), completed by a small table of what
earlier partitions hold of the same key. One exchange besides the range partitioning, no self-join.
Windows are still used where the partition is bounded (per range partition, per fold table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.ordering import neighbours, running_agg


def _keyed(key: str, x: Column) -> Column:
    return F.when(F.col(key).isNotNull(), x)


def sequence_no(df: DataFrame, key: str, order: Sequence[str | Column], out: str = "seq") -> DataFrame:
    """1-based running ordinal inside ``key`` (``cumcount() + 1``). Put the row id last in
    ``order`` so ties are broken deterministically. A row without a key has no ordinal."""
    return neighbours(df, key, order, seq=out)[0].withColumn(out, _keyed(key, F.col(out)))


def prev_value(df: DataFrame, key: str, order: Sequence[str | Column], value: str, out: str,
               default=None, seq: str = "seq") -> DataFrame:
    """Value of the previous row in the group (``groupby().shift(1)``), ``default`` when none;
    null for a row without a key. ``seq`` is added too."""
    rows, (lag,) = neighbours(df, key, order, value, 1, seq)
    value_before = F.col(lag) if default is None else F.coalesce(F.col(lag), F.lit(default))
    return rows.withColumns({out: _keyed(key, value_before), seq: _keyed(key, F.col(seq))}).drop(lag)


def rolling_mean(df: DataFrame, key: str, order: Sequence[str | Column], value: str, out: str,
                 n: int = 3, seq: str = "seq") -> DataFrame:
    """Mean of the current and ``n-1`` previous rows in the group, nulls skipped, at least one
    non-null value needed (``rolling(n, min_periods=1).mean()``). ``seq`` is added too."""
    rows, lags = neighbours(df, key, order, value, n - 1, seq)
    names = [value, *lags]
    seen = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names]
    s = sum((F.when(ok, F.col(c)).otherwise(F.lit(0.0)) for ok, c in zip(seen, names)), F.lit(0.0))
    k = sum((ok.cast("int") for ok in seen), F.lit(0))
    return rows.withColumns({out: F.when(F.col(key).isNotNull() & (k > 0), s / k), seq: _keyed(key, F.col(seq))}).drop(*lags)


def moving_average(df: DataFrame, order: str, value: str, n: int = 3, by: Sequence[str] = (),
                   out: str = "moving_avg", mode: str = "valid") -> DataFrame:
    """Trailing mean over ``n`` rows (``np.convolve(x, ones(n)/n, 'valid')`` laid on the
    last row of each window); in ``valid`` mode only rows with a full window are kept. Built on
    the same range partitions as ``rolling_mean``; without ``by`` the whole frame is one series in many
    of them, never a partition-less window."""
    key = "__series"
    base = df.withColumn(key, F.to_json(F.struct(*by)) if by else F.lit(""))
    out_df = rolling_mean(base, key, [order], value, out, n=n, seq="__seq")
    if mode == "valid":
        out_df = out_df.where(F.col("__seq") >= n)
    return out_df.drop("__seq", key)


def running_best(df: DataFrame, order: Sequence[str | Column], value: str, by: Sequence[str] = (),
                 out: str = "best_so_far", maximize: bool = True) -> DataFrame:
    """Best value so far over ``order`` (optimisation history), skew-proof."""
    return running_agg(df, order, value, fn="max" if maximize else "min", by=by, out=out)
