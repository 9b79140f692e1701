"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import stages
from tabwright.llm.common import stage_table, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.packing),
]

# Winnowing, connected components and tokenizing have no SQL form; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
