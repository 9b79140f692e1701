"""Ranked lexical search without random access (NRA) over impact-sorted lists.

The documents are cut into shards of bounded text. One pass tokenizes them and writes, for each
shard, the postings of the searched terms and the document lengths; the counts over all documents
(documents, terms, documents of each term) come from that table. A second pass reads each shard:
every term's list is sorted by impact and read from its top in growing steps. After each step a
document's score lies between the sum of the impacts seen (lower) and that sum plus, for each list
in which it has not come up, the last impact read (upper). A list read below the least impact that a
document of this length can have cannot hold it any more, so its share of the interval falls to
zero. Reading ends when every document whose upper bound reaches the k-th lower bound has an
interval of one point: membership, ties and scores are then final. A task carries its k best scores
from shard to shard as the bar for the next, and the tasks' answers are merged by a top k in two levels.

No term, document or item is a shuffle key before that merge, so a word that every document holds
costs no task more than another.

Cases: a null or empty text, and one without a term, is in no list and not counted in N; repeated
document rows are documents of their own, and equal scores go by ascending doc_id, null last; every
row of the items is answered for itself, one without a known term by no rows; empty tables yield no
rows; other columns are ignored. One shard holds one whole text at least, however long.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import (LOWER, encode, ids_and_nulls, list_of, pack_ints, stage_table, text_buffers,
                                  text_slices, unpack_ints, words)

# bytes of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` terms: ASCII letters and digits, all wider characters
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SHARD_BYTES = 8 << 20
ITEM_BYTES = 2 << 20
FIRST_READ = 32
SALTS = 64


def terms(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of each text, A-Z lower-cased, and the offsets of each text's."""
    data, offs = text_buffers(col)
    return words(LOWER[data], offs, BETWEEN)


def write_postings(docs: DataFrame, vocab: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(n_docs, n_terms, found, found_docs, docs, postings), a row per shard: its documents and terms
    with repeats, the terms of ``vocab`` found (their numbers) and in how many documents, and packed:
    ids, nulls and lengths of the documents that hold one; of each found term the documents and counts."""
    def run(batches):
        known = pa.array(vocab, pa.string())
        for part in text_slices(batches, shard_bytes):
            col, offs = terms(part.column("text"))
            codes, distinct = encode(col)
            number = pc.index_in(distinct, known)
            number = number.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(offs)
            doc = np.repeat(np.arange(part.num_rows), lengths)
            term = number[codes] if len(codes) else np.zeros(0, np.int64)
            hit = term >= 0
            pair, tf = np.unique(term[hit] * part.num_rows + doc[hit], return_counts=True)
            term, doc = np.divmod(pair, max(part.num_rows, 1))
            held, place = np.unique(doc, return_inverse=True)
            found, df = np.unique(term, return_counts=True)
            ids, nulls = ids_and_nulls(part)
            yield pa.record_batch(
                [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                 list_of(pa.array(found, pa.int64())), list_of(pa.array(df, pa.int64())),
                 pa.array([pack_ints(ids[held], nulls[held], lengths[held])], pa.binary()),
                 pa.array([pack_ints(place, tf)], pa.binary())],
                names=["n_docs", "n_terms", "found", "found_docs", "docs", "postings"])
    schema = "n_docs long, n_terms long, found array<long>, found_docs array<long>, docs binary, postings binary"
    return stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                       .mapInArrow(run, schema), "postings")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray, k1_tenths: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + k1_tenths * m)


def read_lists(lists: list[tuple[np.ndarray, np.ndarray, int]], least: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores that may be among the best ``k`` and reach ``bar``, with final scores.

    ``lists``: (documents, impacts from the highest down, factor of the impact) for each term;
    ``least``: for each document the least impact that it can have in a list that holds it.
    """
    n = len(least)
    lower = np.zeros(n)  # whole numbers far below 2^53
    depth, step = 0, FIRST_READ
    while True:
        for docs, impacts, factor in lists:
            lower += np.bincount(docs[depth:depth + step], impacts[depth:depth + step] * float(factor), n)
        depth, step = depth + step, depth + step  # each step doubles the depth
        # what a list may still hold: the last impact read, or nothing at its end
        last = np.array([impacts[depth - 1] if depth < len(impacts) else 0 for _, impacts, _ in lists])
        share = last * np.array([factor for *_, factor in lists], float)
        order = np.argsort(last, kind="stable")
        above = np.append(np.cumsum(share[order][::-1])[::-1], 0.0)
        rest = above[np.searchsorted(last[order], least)]
        # less the lists in which the document has come up
        for (docs, _, _), top, s in zip(lists, last, share):
            if s:
                seen = docs[:depth]
                rest[seen] -= np.where(least[seen] <= top, s, 0.0)
        best = np.partition(lower, n - k)[n - k] if n > k else 0
        alive = np.flatnonzero(lower + rest >= max(best, bar, 1))
        if not rest[alive].any():
            return alive, lower[alive].astype(np.int64)


def search_shards(postings: DataFrame, items: list[tuple], weights: dict[int, int], n_docs: int, n_terms: int,
                  k: int, k1_tenths: int, b_pct: int) -> DataFrame:
    """(item, doc_id, score): of each task the ``k`` best documents of each item (row number, {term: repeats})."""
    wanted = [(row, [(t, times * weights[t]) for t, times in own.items() if weights.get(t, 0) > 0]) for row, own in items]

    def run(batches):
        best = {row: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for row, _ in wanted}
        for batch in batches:
            for found, df, docs, blob in zip(*(batch.column(c).to_pylist() for c in ("found", "found_docs", "docs", "postings"))):
                ids, nulls, lengths = unpack_ints(docs)
                place, tf = unpack_ints(blob)
                m = 100 - b_pct + (b_pct * lengths * n_docs) // n_terms
                value, least = impact(tf, m[place], k1_tenths), impact(np.int64(1), m, k1_tenths)
                ends = np.cumsum(df).astype(np.int64)
                order = np.lexsort((-value, np.repeat(np.arange(len(df)), df)))
                place, value = place[order], value[order]
                at = {t: slice(int(e - d), int(e)) for t, d, e in zip(found, df, ends)}
                for row, own in wanted:
                    lists = [(place[at[t]], value[at[t]], factor) for t, factor in own if t in at]
                    score, doc, null = best[row]
                    bar = int(score[-1]) if len(score) == k else 1
                    if not lists or sum(int(v[0]) * f for _, v, f in lists) < bar:
                        continue
                    alive, got = read_lists(lists, least, k, bar)
                    score, doc, null = (np.append(score, got), np.append(doc, ids[alive]), np.append(null, nulls[alive].astype(bool)))
                    first = np.lexsort((doc, null, -score))[:k]
                    best[row] = score[first], doc[first], null[first]
        for row, (score, doc, null) in best.items():
            if len(score):
                yield pa.record_batch([pa.array([row] * len(score), pa.int64()), pa.array(doc, pa.int64(), mask=null),
                                       pa.array(score, pa.int64())], names=["item", "doc_id", "score"])
    return postings.select("found", "found_docs", "docs", "postings").mapInArrow(run, "item long, doc_id long, score long")


def best_of_items(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their ``rank``: first of each salt, then of the item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))) \
        .where(F.col("rank") <= k).drop("salt", "place")


def search(docs: DataFrame, items: DataFrame, k: int = 20, k1_tenths: int = 12, b_pct: int = 25,
           item_bytes: int = ITEM_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, with scores above 0.

    Items are answered in blocks of about ``item_bytes`` of text, each by its own two passes, so what
    a task and the driver hold of them is bounded however many there are.
    """
    items = stage_table(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                     F.monotonically_increasing_id().alias("item")), "search-items")
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    answers = [_search_block(docs, items.where(block == b), k, k1_tenths, b_pct, shard_bytes) for b in range(blocks)]
    return reduce(DataFrame.unionByName, answers).join(items.select("item", "item_id"), "item") \
        .select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: DataFrame, k: int, k1_tenths: int, b_pct: int, shard_bytes: int) -> DataFrame:
    rows = items.select("item", "text").collect()  # one block: about `item_bytes`
    col, offs = terms(pa.array([r.text for r in rows], pa.string()))
    codes, vocab = encode(col)
    wanted = [(r.item, dict(zip(*(x.tolist() for x in np.unique(codes[a:b], return_counts=True)))))
              for r, a, b in zip(rows, offs[:-1], offs[1:])]
    postings = write_postings(docs, vocab.to_pylist(), shard_bytes)
    total = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
                         F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).first()
    # at most one row for each term of the block
    df = postings.select(F.explode(F.arrays_zip("found", "found_docs")).alias("x")) \
        .groupBy(F.col("x.found").alias("term")).agg(F.sum("x.found_docs").alias("df")).collect()
    weights = {r.term: weight(total.n_docs, r.df) for r in df}
    return best_of_items(search_shards(postings, wanted, weights, total.n_docs, total.n_terms, k, k1_tenths, b_pct), k)
