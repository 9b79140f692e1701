"""Association measures and tests.

Correlations: all columns in one aggregate pass, pairwise-complete like pandas, constant columns
give null instead of an ANSI divide-by-zero. Chi-square: a dense contingency table built by SQL
(levels x classes per feature, bounded by the feature's cardinality), statistic with Yates'
continuity correction when dof = 1, p-value by the closed forms of the tail as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corr_with_label(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with ``label`` -> (column_name, corr)."""
    y = F.col(label).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        xs, ys = F.when(both, x), F.when(both, y)
        aggs.append(F.try_divide(F.covar_pop(xs, ys), F.sqrt(F.var_pop(xs) * F.var_pop(ys))).alias(c))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("corr")) for c in cols])).alias("s")).select("s.*")


def low_corr_columns(corr: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Columns whose absolute correlation is below ``threshold`` (undefined counts as low)."""
    return corr.where(F.coalesce(F.abs(F.col("corr")) < threshold, F.lit(True))).select("column_name")


def contingency(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Long cross-tabulation (feature, level, label, n) of every feature against the label;
    rows with a missing level or label are skipped (``pd.crosstab``)."""
    long = df.select(F.col(label).cast("string").alias("label"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features
    ])).alias("s")).select("s.feature", "s.level", "label")
    long = long.where(F.col("level").isNotNull() & F.col("label").isNotNull())
    return long.groupBy("feature", "level", "label").agg(F.count(F.lit(1)).alias("n"))


def chi2_cells(table: DataFrame) -> DataFrame:
    """Every cell of every feature's table, zeros included, with its expected count: (feature, level,
    label, n, expected, dof, n_levels, n_classes). A level's counts are one map, so the table is
    completed by two aggregates and one join per feature, not by joining levels with classes."""
    by_level = table.groupBy("feature", "level").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("seen"), F.sum("n").alias("row_n"))
    margins = table.groupBy("feature", "label").agg(F.sum("n").alias("col_n")).groupBy("feature").agg(
        F.collect_list(F.struct("label", "col_n")).alias("cols"), F.sum("col_n").alias("total"),
        F.count(F.lit(1)).alias("n_classes"))
    levels = by_level.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"))
    cells = by_level.join(margins.join(levels, "feature"), "feature").select("*", F.explode("cols").alias("c"))
    return cells.select(
        "feature", "level", "c.label", F.coalesce(F.col("seen")[F.col("c.label")], F.lit(0)).alias("n"),
        (F.col("row_n") * F.col("c.col_n") / F.col("total")).alias("expected"),
        ((F.col("n_levels") - 1) * (F.col("n_classes") - 1)).cast("int").alias("dof"), "n_levels", "n_classes")


def chi2_statistic(table: DataFrame, yates: bool = True) -> DataFrame:
    """(feature, statistic, dof, n_levels, n_classes) from a long contingency table."""
    cells = chi2_cells(table)
    diff = F.abs(F.col("n") - F.col("expected"))
    if yates:
        diff = F.when(F.col("dof") == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    cells = cells.withColumn("term", F.try_divide(diff * diff, F.col("expected")))
    return cells.groupBy("feature").agg(
        F.sum("term").alias("statistic"), F.first("dof").alias("dof"),
        F.first("n_levels").alias("n_levels"), F.first("n_classes").alias("n_classes"))


# terms of the series and of the continued fraction of erfc: both agree to 1e-15 where they meet
ERFC_TERMS, ERFC_FRACTION = 60, 80


def _erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: the alternating-free series of erf for small z, the
    continued fraction for large z."""
    sq = z * z
    # erf(z) = 2/sqrt(pi) exp(-z^2) sum of 2^n z^(2n+1) / (1*3*...*(2n+1)); the state is (sum, term)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(ERFC_TERMS)), F.struct(z.alias("s"), z.alias("t")),
                         lambda st, n: F.struct((st.s + st.t * 2.0 * sq / (2 * n + 1)).alias("s"), (st.t * 2.0 * sq / (2 * n + 1)).alias("t")),
                         lambda st: st.s)
    small = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-sq) * series
    fraction = F.aggregate(F.sequence(F.lit(ERFC_FRACTION), F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, n: 1.0 + n / (2.0 * sq) / f)
    large = F.exp(-sq) / (z * math.sqrt(math.pi)) / fraction
    return F.when(z < 2.0, small).otherwise(large)


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution in closed form: for even degrees of freedom
    exp(-x/2) times the first terms of the exponential series, for odd ones erfc(sqrt(x/2)) and such a
    sum over half-integers. Terms are carried as logarithms, so thousands of degrees do not
    overflow. Null without degrees of freedom."""
    x = F.greatest(stat.cast("double"), F.lit(0.0)) / 2.0
    odd = dof % 2 == 1
    # log of the first term: exp(-x) for even, exp(-x) sqrt(x) / Gamma(3/2) for odd
    first = F.when(odd, -x + F.ln(x) / 2.0 - math.log(math.sqrt(math.pi) / 2)).otherwise(-x)
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), terms), F.struct(F.lit(0.0).alias("s"), first.alias("l")),
                        lambda st, i: F.struct((st.s + F.exp(st.l)).alias("s"), (st.l + F.ln(x) - F.ln(i + shift)).alias("l")), lambda st: st.s)
    tail = F.when(terms > 0, total).otherwise(0.0) + F.when(odd, _erfc(F.sqrt(x))).otherwise(0.0)
    known = stat.isNotNull() & ~F.isnan(stat) & (dof > 0)
    return F.when(known, F.when(x <= 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0))))


def chi2_test(df: DataFrame, features: Sequence[str], label: str, yates: bool = True,
              alpha: float = 0.05) -> DataFrame:
    """Statistic, dof, p-value and verdict per feature."""
    stat = chi2_statistic(contingency(df, features, label), yates=yates)
    return (stat.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))
            .withColumn("verdict", F.when(F.col("p_value") < alpha, F.lit("reject")).otherwise(F.lit("keep"))))
