"""Sources and sinks (S1-S6): lazy scans and partitioned writes.

Parquet is the default interchange format (typed, column-pruned, predicate push-down). CSV is kept
as a source/sink for raw exports, always with an explicit schema outside exploration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabwright.functions.columns import nan_to_null


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               **options) -> DataFrame:
    """Lazy scan of a table. CSV gets ``header=True`` unless told otherwise; without a
    schema CSV columns are inferred (exploration only: inference costs an extra pass)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
        if schema is None:
            options.setdefault("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", schema: StructType | str | None = None,
                   **options) -> DataFrame:
    """Delimited text with a non-comma separator; a UTF-8 BOM in the header is dropped by
    Spark's CSV reader, so the first column name comes out clean."""
    return read_table(spark, path, fmt="csv", schema=schema, sep=sep, **options)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, **options) -> None:
    """Write with header (CSV) and no index column. NaN is turned into null first so that no
    engine-specific NaN text lands in files."""
    out = nan_to_null(df)
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)


def materialize_stage(df: DataFrame, path: str) -> DataFrame:
    """Stage boundary. Write parquet to a shared path and read it back; the reread plan
    starts from files, so lineage is cut and a lost executor recomputes nothing upstream."""
    write_table(df, path, fmt="parquet", mode="overwrite")
    return df.sparkSession.read.parquet(path)


def write_splits(df: DataFrame, path: str, scheme_col: str = "scheme", split_col: str = "split",
                 fmt: str = "parquet") -> None:
    """One table for all feature/label splits, partitioned by scheme and split, in place of
    a pair of files per split."""
    write_table(df, path, fmt=fmt, partition_by=[scheme_col, split_col])


def read_split(spark: SparkSession, path: str, scheme: str, split: str, scheme_col: str = "scheme",
               split_col: str = "split") -> DataFrame:
    """Read one split back; the partition filter prunes directories at planning time."""
    return (spark.read.parquet(path)
            .where((F.col(scheme_col) == scheme) & (F.col(split_col) == split)))
