"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, on the columns of documents.

Rows are told apart by doc_id and a hash of the text, so null and repeated ids are handled. Rows that
agree in both are copies: each stage treats them alike, and ngram_jaccard leaves one of them. Other
columns than those of documents do not pass, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import jaccard, lines, repetition, secrets
from tabwright.llm import packing as packing_op
from tabwright.llm.common import stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def same_row(other: DataFrame) -> Column:
    """Condition that joins the columns of documents with rows of (row_id, row_text)."""
    return F.col("doc_id").cast("long").eqNullSafe(other["row_id"]) & (F.xxhash64("text") == other["row_text"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return repetition.keep_quality(docs.select(*COLUMNS), 8, 20, 30, 40).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of 40 words or more; those left without a word go."""
    cut = lines.dedup_lines(docs.select(*COLUMNS), min_words=40)
    return cut.where((F.col("lines_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")) \
        .withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 80 % of five-word shingles: that of smallest doc_id, null being
    last, then of smallest text hash, then of smallest other columns."""
    docs = docs.select(*COLUMNS)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    named = jaccard.row_roots(docs, 5, 80).where("root is not null")
    # one row of each (doc_id, text) and how many rows it stands for
    rows = named.groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(key).alias("first"))
    marked = stage_table(rows.join(first, "root").select(
        F.col("doc_id").alias("row_id"), F.col("row").alias("row_text"), "n", (key == F.col("first")).alias("kept"))
        .where("n > 1 or not kept"), "jaccard-marked")
    repeated = marked.where("kept")
    once = docs.join(marked, same_row(marked), "left_anti").select(*COLUMNS)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.join(repeated, same_row(repeated), "left_semi") \
        .groupBy("doc_id", F.xxhash64("text").alias("row_text")).agg(F.min(F.struct(*others, "text")).alias("least")) \
        .select("doc_id", "least.*").select(*COLUMNS)
    return once.unionByName(one)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by a mark."""
    learned = secrets.learn(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = secrets.bind(secrets.base_spans(text), lambda base: secrets.all_spans(text, base, learned))
    return docs.select(*COLUMNS).withColumn("spans", spans).withColumn("hit", F.size("spans") > 0) \
        .withColumn("text", F.when(F.col("hit"), secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(F.col("hit"), F.length("text")).otherwise(F.col("n_chars"))) \
        .select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and offset."""
    return packing_op.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0, with_ids=False)
