"""Line dedup by winnowing over line hashes.

A window is a shortest run of lines with at least ``min_words`` words, taken forward from each line
with words and backward from each line with words. Its fingerprint is the smallest line hash in
it, so equal windows select equal fingerprints and every repeated run of ``min_words`` words holds
a shared one. Fingerprints are counted; only windows whose fingerprint was selected at two or more
places are compared, by a 128-bit hash of their lines, with the first window of the same lines in
the order (doc_id, row, line). Later windows go. A run longer than a window is covered by its
windows, forward ones from its start and backward ones from its end, which extends a match both
ways: a line is deleted exactly when it lies in a run of consecutive lines, of ``min_words`` words
or more and with words in its first and last line, that equals a run starting earlier. No pairs of occurrences are formed.

Cases: a null text stays null and an empty one empty; blank lines belong to runs but start none;
rows that agree in doc_id and text are one document, whose lines are kept; other columns pass
through unchanged whatever their names, but for ``lines_deleted`` and ``words_deleted``, which are the
operator's own and are replaced. A slice holds one whole text at least, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import SPACE, encode, stage_table, string_array, text_buffers, text_slices, unused

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def line_table(data: np.ndarray, offs: np.ndarray):
    """Line codes and values, words per line, and the offsets of each document's lines."""
    brk = data == 10
    starts = np.zeros(len(data) + 1, bool)
    starts[1:] = brk
    starts[offs[:-1]] = True
    starts[len(data)] = False
    # a text that ends in \n has an empty last line; it holds no word and is in no window
    first = np.flatnonzero(starts)
    loffs = np.searchsorted(first, offs)
    kept = np.append(0, np.cumsum(~brk, dtype=np.int64))
    codes, values = encode(string_array(data[~brk], np.append(kept[first], kept[-1])))
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offs[:-1][np.diff(offs) > 0]
    begins[inner] = solid[inner]
    words = np.append(0, np.cumsum(begins, dtype=np.int64))
    n_words = np.diff(np.append(words[first], words[-1]))
    return codes, values, n_words, loffs


def windows_of(codes, values, n_words, loffs, min_words: int):
    """(first line, last line, anchor line, hashes) of every window; lines are counted over the slice."""
    n = len(codes)
    hashes = [xxhash.xxh3_128_intdigest(v) for v in values.cast(pa.binary()).to_pylist()]
    hi = np.array([h >> 64 for h in hashes], np.uint64)[codes]
    lo = np.array([h & 0xFFFFFFFFFFFFFFFF for h in hashes], np.uint64)[codes]
    total = np.append(0, np.cumsum(n_words))
    doc = np.repeat(np.arange(len(loffs) - 1), np.diff(loffs))
    own = np.flatnonzero(n_words > 0)
    last = np.searchsorted(total, total[own] + min_words) - 1
    ok = last < loffs[doc[own] + 1]
    s1, e1 = own[ok], last[ok]
    back = np.searchsorted(total, total[own + 1] - min_words, side="right") - 1
    ok = back >= loffs[doc[own]]
    pairs = np.unique(np.concatenate([np.stack([s1, e1], 1), np.stack([back[ok], own[ok]], 1)]), axis=0)
    s, e = pairs[:, 0], pairs[:, 1]
    if len(s) == 0:
        return s, e, s, s.astype(np.uint64), s.astype(np.uint64), hi
    order = np.argsort(np.where(n_words > 0, hi, np.uint64(0xFFFFFFFFFFFFFFFF)), kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = n
    anchor = order[np.minimum.reduceat(rank, np.stack([s, e + 1], 1).ravel())[::2]]
    with np.errstate(over="ignore"):
        power = np.append(np.uint64(1), np.cumprod(np.full(n, STEP)))
        inverse = np.append(np.uint64(1), np.cumprod(np.full(n, BACK)))
        span = (e - s + 1).astype(np.uint64)
        w = []
        for h in (hi, lo):
            sums = np.append(np.uint64(0), np.cumsum(h * power[:-1]))
            w.append((sums[e + 1] - sums[s]) * inverse[s] + span * STEP)
    return s, e, anchor, w[0], w[1], hi


def line_windows(docs: DataFrame, min_words: int, slice_bytes: int = 4 << 20) -> DataFrame:
    def run(batches):
        for part in text_slices(batches, slice_bytes):
            codes, values, n_words, loffs = line_table(*text_buffers(part.column("text")))
            s, e, anchor, w1, w2, hi = windows_of(codes, values, n_words, loffs, min_words)
            doc = np.searchsorted(loffs, s, side="right") - 1
            chosen = np.zeros(len(s), bool)
            chosen[np.unique(anchor, return_index=True)[1]] = True
            at = pa.array(doc)
            yield pa.record_batch([
                part.column("doc_id").take(at), part.column("row").take(at),
                pa.array(hi[anchor].view(np.int64)), pa.array(chosen),
                pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)),
                pa.array((s - loffs[doc]).astype(np.int32)), pa.array((e - loffs[doc]).astype(np.int32))],
                names=["doc_id", "row", "anchor", "chosen", "w1", "w2", "s", "e"])
    return docs.mapInArrow(run, "doc_id long, row long, anchor long, chosen boolean, w1 long, w2 long, s int, e int")


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, spans): windows of lines that occur earlier; ``row`` is a hash of the text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
                        F.col("text").cast("string").alias("text"))
    windows = stage_table(line_windows(keyed, min_words), "line-windows")
    shared = windows.where("chosen").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # a repeated row's own copy: both have the same (doc_id, row, s) and neither is later
    found = windows.join(shared, "anchor", "left_semi").select("w1", "w2", "doc_id", "row", "s", "e")
    place = F.struct("doc_id", "row", "s")
    first = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")) \
        .where("first < last").select("w1", "w2", "first")
    later = found.join(first, ["w1", "w2"]).where(place > F.col("first"))
    # a document has at most two windows per line
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, and ``lines_deleted``, ``words_deleted``."""
    docs = docs.drop("lines_deleted", "words_deleted")
    doc_id, row, cut = unused(docs, "run_doc_id", "run_row", "run_spans")
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias(doc_id), F.col("row").alias(row), F.col("spans").alias(cut))
    joined = docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id))
                       & (F.xxhash64("text") == F.col(row)), "left").drop(doc_id, row)
    schema = joined.drop(cut).schema.add("lines_deleted", "long").add("words_deleted", "long")

    def run(batches):
        for batch in batches:
            spans = batch.column(cut)
            texts = batch.column("text")
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            lines_cut, words_cut = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(hit):
                new = texts.to_pylist()
                for i, own in zip(hit.tolist(), spans.take(pa.array(hit)).to_pylist()):
                    lines = new[i].split("\n")
                    step = np.zeros(len(lines) + 1, np.int64)
                    for x in own:
                        step[x["s"]] += 1
                        step[x["e"] + 1] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    lines_cut[i] = gone.sum()
                    words_cut[i] = sum(len(x.encode().split()) for x, g in zip(lines, gone) if g)
                    new[i] = "\n".join(x for x, g in zip(lines, gone) if not g)
                texts = pa.array(new, texts.type)
            names = [x for x in batch.schema.names if x != cut]
            yield pa.record_batch([texts if x == "text" else batch.column(x) for x in names]
                                  + [pa.array(lines_cut), pa.array(words_cut)],
                                  names=[*names, "lines_deleted", "words_deleted"])
    return joined.mapInArrow(run, schema)
