"""Quality rules by suffix arrays: repeated word sequences inside each document.

Each task numbers the words of a slice of documents, sorts the suffixes of every document by
prefix doubling (a document's suffixes are ranked among themselves only) and reads the longest
common prefixes of neighbouring suffixes off the stored rank levels. The longest match that starts
at a word is the larger of its two neighbouring prefixes; matches of at least ``min_words`` words
are the occurrences of maximal repeated substrings, and their spans are united by position.

Cases: a null text has no words and fails; empty texts likewise; repeated rows are judged each;
other columns are ignored. A slice holds one whole text at least, with a rank array for each doubling
of its longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import SPACE, encode, string_array, text_buffers, text_slices, unused, words

SYMBOLS = "#*$%&|<>"


def longest_matches(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest sequence from it that starts elsewhere in its document."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    stop = np.repeat(offs[1:], np.diff(offs))
    key = (doc << 32) | codes.astype(np.int64)
    order = np.argsort(key, kind="stable")
    levels, step = [], 1
    rank = np.empty(n, np.int64)

    def regroup(order, key):
        """Rank = first place of the group, so later levels only refine; and who is in a group of two or more."""
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        return head, np.repeat(size > 1, size)

    head, many = regroup(order, key[order])
    rank[order] = head
    place = np.flatnonzero(many)  # places in the suffix order that are not yet settled
    while True:
        levels.append(rank.astype(np.int32))
        if len(place) == 0:
            break
        at = order[place]
        ahead = at + step
        inside = ahead < stop[at]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[place] = at  # groups lie on consecutive places and keep them
        head, many = regroup(at, key)
        rank = rank.copy()
        rank[at] = place[head]
        place = place[many]
        step *= 2
    # prefixes of neighbours, from the widest level down
    left, right = order[:-1], order[1:]
    same = doc[left] == doc[right]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(same & (levels[0][left] == levels[0][right]))
    for k in range(len(levels) - 1, -1, -1):
        a, b = left[live] + lcp[live], right[live] + lcp[live]
        ok = (a < stop[left[live]]) & (b < stop[right[live]])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        lcp[live[ok]] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[left] = lcp
    longest[right] = np.maximum(longest[right], lcp)
    return longest


def covered_words(longest: np.ndarray, offs: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a match of ``min_words`` or more (matches end inside their document)."""
    n = len(longest)
    reach = np.where(longest >= min_words, np.arange(n) + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]


def measure(text: pa.Array, min_words: int) -> list[np.ndarray]:
    """MEASURES of each text."""
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True

    def sums(values, offs):
        ends = np.append(0, np.cumsum(values, dtype=np.int64))
        return ends[offs[1:]] - ends[offs[:-1]]

    n = len(text)
    data, offs = text_buffers(text)
    word, woffs = words(data, offs)
    codes, _ = encode(word)
    longest = longest_matches(codes, woffs)
    repeat = covered_words(longest, woffs, min_words)
    peak = np.zeros(n, np.int64)
    full = np.flatnonzero(np.diff(woffs))
    if len(full):
        peak[full] = np.maximum.reduceat(longest, woffs[:-1][full])
    # a code point has one byte that is not a continuation byte
    chars = sums((~SPACE[data]) & ((data & 0xC0) != 0x80), offs)
    # lines start at texts and after each \n; a line counts if it has a word
    brk = data == 10
    starts = np.zeros(len(data) + 1, bool)
    starts[1:] = brk
    starts[offs[:-1]] = True
    starts[len(data)] = False
    first = np.flatnonzero(starts)
    dup = np.zeros(n, np.int64)
    if len(first):
        ends = np.append(first[1:], len(data)).astype(np.int64)
        solid = np.append(0, np.cumsum(~SPACE[data], dtype=np.int64))
        has = solid[ends] > solid[first]
        # lines are compared without their \n, which the last line of a text may lack
        kept = np.append(0, np.cumsum(~brk, dtype=np.int64))
        codes, _ = encode(string_array(data[~brk], np.append(kept[first], kept[-1])))
        doc = np.searchsorted(offs, first, side="right") - 1
        doc, codes = doc[has], codes[has].astype(np.int64)
        once = np.unique((doc << 32) | codes) >> 32
        dup = np.bincount(doc, minlength=n) - np.bincount(once, minlength=n)
    return [np.diff(woffs), chars, sums(symbol[data], offs), dup, sums(repeat, woffs), peak]


def repetition_report(docs: DataFrame, min_words: int = 8, slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id and MEASURES) per document."""
    def run(batches):
        for part in text_slices(batches, slice_bytes):
            yield pa.record_batch([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in measure(part.column("text"), min_words))],
                                  names=["doc_id", *MEASURES])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def verdict(names: dict[str, str], min_doc_words: int, max_covered_pct: int, max_longest: int) -> tuple[Column, Column]:
    """(base_failed, kept): covered share of the words, and the longest repeat in words."""
    n, repeat, longest = (F.col(names[m]) for m in ("n_words", "n_repeat_words", "longest_repeat"))
    failed = (n < min_doc_words) | (100 * repeat > max_covered_pct * n)
    return failed, ~failed & (longest <= max_longest)


def judge(report: DataFrame, min_doc_words: int = 20, max_covered_pct: int = 30, max_longest: int = 40) -> DataFrame:
    """Add base_failed and kept to a report."""
    failed, kept = verdict({m: m for m in MEASURES}, min_doc_words, max_covered_pct, max_longest)
    return report.withColumn("base_failed", failed).withColumn("kept", kept)


def keep_quality(docs: DataFrame, min_words: int = 8, min_doc_words: int = 20, max_covered_pct: int = 30,
                 max_longest: int = 40, slice_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are, in one pass."""
    names = unused(docs, *MEASURES)

    def run(batches):
        for part in text_slices(batches, slice_bytes):
            found = measure(part.column("text"), min_words)
            yield pa.record_batch([*part.columns, *(pa.array(v, pa.int64()) for v in found)],
                                  names=[*part.schema.names, *names])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])
    _, kept = verdict(dict(zip(MEASURES, names)), min_doc_words, max_covered_pct, max_longest)
    return docs.mapInArrow(run, schema).where(kept).select(*docs.columns)
