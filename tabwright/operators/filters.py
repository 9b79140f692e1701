"""Row filters and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from tabwright.functions.columns import is_true


def split_by(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Complement split. Rows where ``cond`` is true go left; false *and null* go right
    (pandas ``~mask`` keeps missing comparisons). Both halves are plain filters of one scan."""
    yes = is_true(cond)
    return df.where(yes), df.where(~yes)


def split_labeled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Labelled / unlabelled halves."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any",
               ignore: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a null in ``subset`` (default: every column except ``ignore``).
    NaN counts as missing, as in pandas."""
    cols = list(subset) if subset is not None else [c for c in df.columns if c not in set(ignore)]
    return df.na.drop(how=how, subset=cols)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop by list; absent names are ignored (``errors='ignore'``)."""
    return df.drop(*[n for n in names if n in df.columns])


drop_proxies = drop_columns


_KINDS = {
    "number": lambda t: isinstance(t, NumericType) and not isinstance(t, BooleanType),
    "string": lambda t: isinstance(t, StringType),
    "timestamp": lambda t: isinstance(t, (TimestampType, TimestampNTZType, DateType)),
    "bool": lambda t: isinstance(t, BooleanType),
}


def select_by_type(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> list[str]:
    """P10: column names of a kind (``number``/``string``/``timestamp``/``bool``), from the schema."""
    test = _KINDS[kind]
    return [f.name for f in df.schema.fields if test(f.dataType) and f.name not in set(exclude)]


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values per column as one row, in a single aggregate pass."""
    cols = list(cols) if cols is not None else df.columns
    kinds = dict(df.dtypes)
    missing = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in cols}
    return df.agg(*[F.avg(m.cast("double")).alias(c) for c, m in missing.items()])


def sparse_column_report(df: DataFrame, max_pct: float, cols: Sequence[str] | None = None) -> DataFrame:
    """P11 decision table: (column_name, missing_pct, dropped)."""
    cols = list(cols) if cols is not None else df.columns
    one = null_shares(df, cols)
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col(c) * 100.0).alias("missing_pct")) for c in cols
    ])).alias("s")).select("s.*")
    return stacked.withColumn("dropped", F.col("missing_pct") > F.lit(max_pct))


def drop_sparse_columns(df: DataFrame, max_pct: float = 85.0) -> DataFrame:
    """Drop columns whose missing share exceeds ``max_pct``. Two steps by nature: one
    aggregate action (a single row comes back) decides, then a projection drops."""
    row = null_shares(df).first()
    drop = [c for c in df.columns if row[c] is not None and row[c] * 100.0 > max_pct]
    return df.drop(*drop)


def filter_abs(df: DataFrame, col: str, t: float) -> DataFrame:
    """Keep rows with ``abs(col) > t``."""
    return df.where(is_true(F.abs(F.col(col)) > F.lit(t)))
