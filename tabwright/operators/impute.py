"""Rule-based cleaning and imputation.

Every rule is a column expression; several rules are applied in one ``withColumns`` projection so
the optimizer fuses them into one codegen stage (the reference ran one pass per rule). Lookups that
are data-sized go through a join; fixed small dictionaries through literal maps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import is_true, lookup, round_half_even


def fill_const(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """Constant fill of a column list."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in cols})


def add_flags(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """0/1 flag columns from predicates; a null predicate yields 0."""
    return df.withColumns({n: is_true(c).cast("int") for n, c in flags.items()})


def flag_and_fill(df: DataFrame, spec: Mapping[str, object], flag_suffix: str = "_missing") -> DataFrame:
    """Flag missing values, then fill them with a placeholder; one projection, the flag is
    computed from the unfilled column."""
    cols = {}
    for c, placeholder in spec.items():
        cols[f"{c}{flag_suffix}"] = F.col(c).isNull().cast("int")
        cols[c] = F.coalesce(F.col(c), F.lit(placeholder).cast(df.schema[c].dataType))
    return df.withColumns(cols)


def fill_when(df: DataFrame, target: str, rules: Sequence[tuple[Column, object]], only_null: bool = True) -> DataFrame:
    """I4: conditional constants. Rules are tried in order; with ``only_null`` a rule only fills a
    missing target."""
    expr = None
    for cond, value in rules:
        c = is_true(cond)
        expr = F.when(c, F.lit(value)) if expr is None else expr.when(c, F.lit(value))
    tgt = F.col(target)
    new = F.coalesce(tgt, expr) if only_null else F.coalesce(expr, tgt)
    return df.withColumn(target, new.cast(df.schema[target].dataType))


def case_when(branches: Sequence[tuple[Column, Column | object]], otherwise) -> Column:
    """Nested conditional value (``np.where(a, x, np.where(b, y, z))``)."""
    expr = None
    for cond, val in branches:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(is_true(cond), v) if expr is None else expr.when(is_true(cond), v)
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def rule_any_positive(df: DataFrame, target: str, when_col: str, when_value, cols: Sequence[str],
                      yes, no) -> DataFrame:
    """For rows where ``when_col == when_value``: ``yes`` if any of ``cols`` > 0 else ``no``
    (overwrites); other rows keep their value."""
    anyp = None
    for c in cols:
        p = is_true(F.col(c) > 0)
        anyp = p if anyp is None else anyp | p
    hit = is_true(F.col(when_col) == F.lit(when_value))
    return df.withColumn(target, F.when(hit, F.when(anyp, F.lit(yes)).otherwise(F.lit(no))).otherwise(F.col(target)))


def rule_set_columns(df: DataFrame, cond: Column, values: Mapping[str, object]) -> DataFrame:
    """One condition setting several columns at once."""
    c = is_true(cond)
    return df.withColumns({k: F.when(c, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def map_values(df: DataFrame, col: str, mapping: Mapping, into: str | None = None,
               only_null: bool = True, default=None) -> DataFrame:
    """I8: dictionary replace/fill. ``into`` is the column filled (default: ``col`` itself,
    i.e. replace codes by labels); with ``only_null`` existing values of ``into`` are kept."""
    target = into or col
    mapped = lookup(col, mapping, default)
    if into is None:
        new = mapped if default is not None else F.coalesce(mapped, F.col(col).cast("string"))
    else:
        new = F.coalesce(F.col(target), mapped) if only_null else F.coalesce(mapped, F.col(target))
    return df.withColumn(target, new)


def map_values_table(df: DataFrame, col: str, dim: DataFrame, dim_key: str, dim_value: str,
                     into: str) -> DataFrame:
    """I8/I13 for data-sized dictionaries: left join + coalesce (join strategy by AQE)."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(dim_value).alias("__v"))
    j = df.join(d, df[col] == d["__k"], "left")
    base = F.col(into) if into in df.columns else F.lit(None)
    return j.withColumn(into, F.coalesce(base, F.col("__v"))).drop("__k", "__v")


def fill_formula(df: DataFrame, target: str, expr: Column, cond: Column | None = None,
                 digits: int | None = 2) -> DataFrame:
    """``target = expr`` where target is missing (and ``cond`` holds), rounded half-even."""
    e = expr if cond is None else F.when(is_true(cond), expr)
    if digits is not None:
        e = round_half_even(e, digits)
    return df.withColumn(target, F.coalesce(F.col(target), e))


def fill_ratio(df: DataFrame, target: str, num: str, den: str) -> DataFrame:
    """``target = num / den`` where missing and ``den > 0``."""
    return df.withColumn(target, F.coalesce(F.col(target), F.when(is_true(F.col(den) > 0), F.col(num) / F.col(den))))


def fill_group_constant(df: DataFrame, group_col: str, constants: Mapping, target: str,
                        scale: str | None = None, digits: int | None = 2) -> DataFrame:
    """Group constant (per region) where missing; optionally multiplied back by ``scale``."""
    const = lookup(group_col, constants)
    value = const * F.col(scale) if scale else const
    if digits is not None:
        value = round_half_even(value, digits)
    return df.withColumn(target, F.coalesce(F.col(target), value))
