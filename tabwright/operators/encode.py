"""Encoding and feature assembly.

Codes are a table of (level, code) that is joined, whatever its size. Only the wide one-hot, which
makes a column per level, lists levels on the driver, and it refuses more than ``MAX_LEVELS``.
Fitting on one split and applying to all splits never leaks rows across.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.ordering import global_row_index
from tabwright.session import stage

# a wide one-hot makes one column per level; beyond this use one_hot_vector
MAX_LEVELS = 4096
# columns whose levels are found in one pass
TOGETHER = 16


def level_lists(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted non-null distinct values of each column, for encodings that make a column per level.
    At most ``max_levels`` + 1 values reach the driver; more levels are an error, by the exact count."""
    out = {}
    for at in range(0, len(cols), TOGETHER):
        part = cols[at:at + TOGETHER]
        names = [f"v{i}" for i in range(len(part))]
        values = df.select(*(F.col(c).alias(v) for c, v in zip(part, names)))
        # the columns share one pass and are written: a row per column and value
        levels = stage(values.groupingSets([[F.col(v)] for v in names], *names).agg(F.grouping_id(*names).alias("of")), "levels")
        for i, (c, v) in enumerate(zip(part, names)):
            of = (1 << len(part)) - 1 - (1 << (len(part) - 1 - i))  # a bit for each column not grouped by
            rows = levels.where((F.col("of") == of) & F.col(v).isNotNull()).select(F.col(v).alias("v")).limit(max_levels + 1).collect()
            if len(rows) > max_levels:
                raise ValueError(f"too many levels to encode: {c} has more than {max_levels}; use one_hot_vector")
            out[c] = sorted(r["v"] for r in rows)
    return out


def level_codes(df: DataFrame, col: str) -> DataFrame:
    """(level, code): the distinct non-null values in order, numbered from 0 without a driver list."""
    levels = df.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct()
    return global_row_index(levels, ["level"], out="code").select("level", F.col("code").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """Attach the code of ``col``; null, and levels that the fit did not see, get null."""
    return df.join(codes.select(F.col("level").alias("__level"), F.col("code").alias(out)),
                   F.col(col) == F.col("__level"), "left").drop("__level")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct levels -> 0..n-1 (alphabetical, like a label encoder); null stays
    null. Returns (frame, table of level and code)."""
    codes = level_codes(df, col)
    return apply_codes(df, codes, col, out or f"{col}_code"), codes


def label_decode(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """E1 inverse: code -> label."""
    return df.join(codes.select(F.col("level").alias(out), F.col("code").alias("__of_level")),
                   F.col(col).cast("int") == F.col("__of_level"), "left").drop("__of_level")


def one_hot_vector(df: DataFrame, codes: DataFrame, col: str, out: str, drop_first: bool = True) -> DataFrame:
    """E2 for any number of levels: one sparse vector column instead of a column per level."""
    size = codes.agg(F.count(F.lit(1))).first()[0] - int(drop_first)
    index = F.col("__at") - int(drop_first)
    hot = apply_codes(df, codes, col, "__at").withColumn("__at", F.coalesce(index, F.lit(-1)).cast("double"))
    # OneHotEncoder leaves an index beyond the last category, or an invalid one, all zero
    model = OneHotEncoder(inputCol="__at", outputCol=out, dropLast=True, handleInvalid="keep")
    fitted = model.fit(df.sparkSession.createDataFrame([(float(max(size - 1, 0)),)], "__at double"))
    return fitted.transform(hot.withColumn("__at", F.when(F.col("__at") >= 0, F.col("__at")).otherwise(F.lit(float(size))))) \
        .drop("__at")


@dataclass
class OneHotWide:
    """Wide 0/1 columns ``<col>_<level>``, fitted on one frame, applied to any frame.
    The alphabetically first level is dropped; unseen levels and nulls give all zeros."""
    cols: Sequence[str]
    drop_first: bool = True
    levels: Mapping[str, list] = field(default_factory=dict)
    max_levels: int = MAX_LEVELS

    def fit(self, df: DataFrame) -> "OneHotWide":
        self.levels = level_lists(df, self.cols, self.max_levels)
        return self

    def output_columns(self) -> list[str]:
        return [f"{c}_{lv}" for c in self.cols for lv in self._kept(c)]

    def _kept(self, c: str) -> list:
        lv = self.levels[c]
        return lv[1:] if self.drop_first else lv

    def transform(self, df: DataFrame, keep_input: bool = False) -> DataFrame:
        new = {f"{c}_{lv}": F.coalesce(F.col(c) == F.lit(lv), F.lit(False)).cast("int")
               for c in self.cols for lv in self._kept(c)}
        out = df.withColumns(new)
        return out if keep_input else out.drop(*self.cols)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Dense feature vector; nulls are an error (impute first)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
