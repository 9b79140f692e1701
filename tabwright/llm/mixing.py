"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by a hash of doc_id), passed through
again until the source has had its target. A document's virtual finish time is the number of the
source's words up to its end divided by the source's target, so at any virtual time all sources
have been served in the proportion of their targets. The documents are sorted by that time over all
sources and taken until the budget is used up; the document that a source is in when its target is
reached is taken in part, so each source gets its target to the word.

Running totals need no task that holds a source: rows are range-partitioned by the whole order, the
partition's number is written with them, and a table of one row per partition gives what lies before.
A source that holds most rows is spread over many partitions. Only DataFrame functions are used.

Cases: a null text has no words and is never taken; a null source is a source, the last one; rows
with a null or repeated doc_id, and repeated rows, are told apart by text hash and a written row
number; sources without words have target 0; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import stage_table

WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str, name: str) -> DataFrame:
    """Add ``out``, the total of ``value`` up to the row in the total order ``order``; one exchange."""
    ranged = stage_table(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    # one row per range partition, so the single window over them is bounded by the partition count
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.sum(value).alias("own")) \
        .select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(bases), "part").withColumn(out, F.col("base") + F.sum(value).over(inside)).drop("part", "base")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, key, text_hash, uid), written once so that row numbers stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return stage_table(docs.select(
        doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}"))).alias("key"),
        F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("uid")), "mix-sizes")


def source_order() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]  # code points, null last


def cyclic_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add ``rank`` (from 1, by code point, null last) and ``weight``: ``weights`` in turn by rank."""
    ranked = running_total(sources.withColumn("one", F.lit(1)), source_order(), "one", "rank", "mix-ranks").drop("one")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))


def with_targets(sources: DataFrame, budget: int, most: int) -> DataFrame:
    """Add ``target`` to (source_size, weight): shares of ``budget`` by weight, at most ``most`` times
    the source's size; what lies above goes to the other sources by weight until no share does.

    A pass over the sources sums the capped ones; each pass caps more of them or is the last."""
    cap = F.col("source_size") * most
    left, weight = budget, sources.agg(F.sum("weight")).first()[0]
    while weight:
        above = F.col("weight") * F.lit(left) / F.lit(weight) > cap
        row = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
                          F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if (budget - row.capped, row.weight) == (left, weight):
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(weight)))
        left, weight = budget - row.capped, row.weight
    return sources.withColumn("target", cap.cast("double"))


def fair_mix(docs: DataFrame, weights: Sequence[int], budget: int | None = None, most: int = 3,
             seed: int = 777) -> tuple[DataFrame, DataFrame]:
    """The mix, and all rows of ``docs`` with their source's figures.

    The mix has a row per document and pass: (uid, doc_id, source, pass, words, finish, position),
    where ``position`` counts the mix's words before it. ``docs`` come as (uid, doc_id, size, source,
    source_size, target). ``budget`` is the words of all documents where None."""
    rows = sized(docs, seed)
    shuffled = [*source_order(), F.col("key"), F.col("doc_id"), F.col("text_hash"), F.col("uid")]
    queued = running_total(rows, shuffled, "size", "upto", "mix-queues")
    sources = stage_table(queued.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(F.col("upto") - F.col("size")).alias("ahead")), "mix-sources")
    if budget is None:
        budget = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = stage_table(with_targets(cyclic_weights(sources, weights), budget, most), "mix-targets") \
        .withColumnRenamed("source", "of_source")
    all_rows = queued.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    end = F.floor("target")  # whole words
    start = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size") - F.col("ahead")
    passes = F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")) - 1)
    served = all_rows.where((F.col("size") > 0) & (end > 0)).withColumn("pass", F.explode(passes)) \
        .withColumn("words", F.least("size", end - start)).where("words > 0") \
        .withColumn("finish", (start + F.col("words")) / F.col("target")) \
        .select("uid", "doc_id", "source", "rank", "pass", "words", "finish")
    total = running_total(served, [F.col("finish"), F.col("rank"), F.col("pass"), F.col("uid")], "words", "upto", "mix-order")
    mix = total.withColumn("position", F.col("upto") - F.col("words")).where(F.col("position") < budget) \
        .withColumn("words", F.least("words", F.lit(budget) - F.col("position"))) \
        .select("uid", "doc_id", "source", "pass", "words", "finish", "position")
    return mix, all_rows.select("uid", "doc_id", "size", "source", "source_size", "target")


def taken_words(docs: DataFrame, weights: Sequence[int], budget: int | None = None, most: int = 3, seed: int = 777) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row: the words that the mix takes of it."""
    mix, rows = fair_mix(docs, weights, budget, most, seed)
    taken = mix.groupBy("uid").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
