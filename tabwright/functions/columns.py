"""Scalar column expressions.

Every helper returns a Catalyst ``Column`` (or a DataFrame built from one projection) so it stays
inside whole-stage codegen. Null rules of the pandas original are made explicit here:
comparisons against null yield false, NaN becomes null, division by zero yields null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampNTZType, TimestampType, DateType


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Ingest policy: NaN is missing. Replace NaN by null in floating columns."""
    names = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if not names:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def is_true(cond: Column) -> Column:
    """Null-safe predicate: null counts as false (pandas mask semantics)."""
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------- P1-P3 coercion and sentinels

def coerce_numeric(c: str | Column, to: str = "bigint", fill=None) -> Column:
    """Numeric parse, unparsable -> null (or ``fill``). ``try_cast`` never raises under ANSI."""
    out = col_(c).cast("string").try_cast(to)
    return F.coalesce(out, F.lit(fill).cast(to)) if fill is not None else out


def coerce_timestamp(c: str | Column, fmt: str | None = "yyyy-MM-dd") -> Column:
    """Timestamp parse, unparsable -> null."""
    return F.try_to_timestamp(col_(c), F.lit(fmt)) if fmt else F.try_to_timestamp(col_(c))


def null_out(c: str | Column, values: Sequence) -> Column:
    """Sentinel values -> null (``9999-12-31``, ``''``, price ``0`` ...)."""
    cc = col_(c)
    return F.when(~is_true(cc.isin(list(values))), cc)


def null_out_columns(df: DataFrame, spec: Mapping[str, Sequence]) -> DataFrame:
    """P3 over several columns in one projection."""
    return df.withColumns({c: null_out(c, v) for c, v in spec.items()})


def compose_key(parts: Sequence[str | Column], prefix: str = "", sep: str = "/") -> Column:
    """Composite text key such as ``'HO a/b/c'``. A null part makes the key null (no
    ``'nan'`` text keys)."""
    cols = [col_(p).cast("string") for p in parts]
    body = F.concat(*[x for pair in zip(cols, [F.lit(sep)] * len(cols)) for x in pair][:-1])
    return F.concat(F.lit(prefix), body) if prefix else body


def abs_above(c: str | Column, t: float) -> Column:
    """``abs(x) > t`` with null -> false."""
    return is_true(F.abs(col_(c)) > F.lit(t))


# ---------------------------------------------------------------- S3 / F1-F5 strings

def parse_decimal(c: str | Column, decimal: str = ",") -> Column:
    """Locale decimal text (``'0,027'``) -> double; unparsable -> null."""
    return F.replace(col_(c).cast("string"), F.lit(decimal), F.lit(".")).try_cast("double")


def normalize_text(c: str | Column) -> Column:
    """``lower(trim(x))``."""
    return F.lower(F.trim(col_(c)))


def lookup(c: str | Column, mapping: Mapping, default=None) -> Column:
    """F2/I8: dictionary lookup through a literal map (small, constant-size dictionaries only;
    data-sized dictionaries go through a join). Duplicate keys are rejected up front."""
    keys = list(mapping.keys())
    if len(set(keys)) != len(keys):
        raise ValueError("duplicate keys in lookup mapping")
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    out = F.try_element_at(m, col_(c))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def strip_letters(c: str | Column) -> Column:
    """remove ASCII letters (``1234AB`` -> ``1234``)."""
    return F.regexp_replace(col_(c), "[A-Za-z]", "")


# ---------------------------------------------------------------- F6-F12 dates, labels, bins

def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType))]


def add_years(df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "_year") -> DataFrame:
    """``<col>_year`` for every timestamp column (schema-driven), one projection."""
    names = list(cols) if cols is not None else timestamp_columns(df)
    return df.withColumns({f"{c}{suffix}": F.year(c) for c in names})


def years_between(start: str | Column, end: str | Column, as_of: str) -> Column:
    """whole-year difference, open end replaced by ``as_of`` (the reference used 'today')."""
    return F.year(F.coalesce(col_(end), F.lit(as_of).cast("timestamp_ntz"))) - F.year(col_(start))


def threshold_label(c: str | Column, t: float, low: str = "<=3", high: str = ">3") -> Column:
    """F8: class label; null stays null."""
    cc = col_(c)
    return F.when(cc <= t, F.lit(low)).when(cc.isNotNull(), F.lit(high))


def binary_target(c: str | Column, t: float) -> Column:
    """F8: 1 when value > t, else 0 (null -> 0, as ``np.where`` does)."""
    return is_true(col_(c) > t).cast("int")


def bucketize(c: str | Column, lo: int, hi: int, step: int) -> tuple[Column, Column]:
    """fixed-width, left-closed bins ``[lo, lo+step) ... [hi-step, hi)``.
    Returns (bucket number, label ``'a-b'``); outside the range both are null."""
    cc = col_(c)
    inside = is_true((cc >= lo) & (cc < hi))
    b = F.when(inside, F.floor((cc - F.lit(lo)) / F.lit(step)).cast("int"))
    lo_edge = F.lit(lo) + b * F.lit(step)
    label = F.concat(lo_edge.cast("string"), F.lit("-"), (lo_edge + F.lit(step - 1)).cast("string"))
    return b, F.when(inside, label)


def banded(c: str | Column, edges: Sequence[float], labels: Sequence[str], null_label: str) -> Column:
    """right-closed bands with irregular edges; ``len(labels) == len(edges) + 1``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    cc = col_(c)
    out = F.when(cc.isNull(), F.lit(null_label))
    for e, lab in zip(edges, labels):
        out = out.when(cc <= F.lit(e), F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


def count_positive(cols: Sequence[str | Column]) -> Column:
    """number of columns holding a value > 0 (null counts as not positive)."""
    return sum((is_true(col_(c) > 0).cast("int") for c in cols), F.lit(0))


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    """NumPy's rounding: half-even on the binary value, ``rint(x * 10^d) / 10^d``. (Spark's
    ``bround`` rounds the shortest decimal text, which differs on exact binary ties.)"""
    s = float(10 ** digits)
    return F.rint(col_(c).cast("double") * F.lit(s)) / F.lit(s)


def to_fixed(c: str | Column, digits: int = 2, as_text: bool = False) -> Column:
    """Round half-even (NumPy's rule) and keep numeric; text only on export."""
    r = round_half_even(c, digits)
    return F.when(r.isNotNull(), F.format_string(f"%.{digits}f", r)) if as_text else r


def safe_div(a: str | Column, b: str | Column, fill=None) -> Column:
    """Division where zero or null divisors give null (or ``fill``) instead of an
    ANSI error or +-inf."""
    q = F.try_divide(col_(a), col_(b))
    return F.coalesce(q, F.lit(fill)) if fill is not None else q
