"""Periodic runs by recompression: a run-length grammar whose LCE queries extend grid candidates.

A run of period p and at least ``exponent`` periods holds whole aligned blocks of p words that equal
the next p words. So for each p the blocks of the harmonic grid (block numbers 0, 2, 4, ...; about
n ln n / 2 in all) are the candidates; those whose words at a few places agree with the next
block's are kept. Over the texts with a candidate the grammar is built: each level replaces every
maximal block of one symbol by a symbol of its own (symbol and length), then each pair of a left
and a right symbol by a symbol of its own. Symbols get names by sorting, so equal names mean equal words.
A longest common extension climbs the levels while the two places agree symbol by symbol, and goes
down again where they first differ: about four steps a level, to the left as to the right. The
extensions give each candidate's run exactly; a run's smallest period is the least with that stretch.

Texts are handled whole by one task each, many at once; nothing is shuffled. A task holds the words
of a slice of texts (one whole text at least, however long) and about four times as many symbols.

Cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are
handled each; other columns are kept as they are; empty tables yield no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import encode, string_array, text_buffers, text_slices, words

SLICE_BYTES = 4 << 20
# candidates tested at once
GRID_ROWS = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Level:
    """Symbols of one level, where each is in the next level, and the edges of their parents.

    ``block`` levels merge equal neighbours, the others pairs; ``parent`` is the place in the next
    level, ``first`` and ``last`` the places here of a parent's outer children."""

    def __init__(self, symbols: np.ndarray, block: bool, starts: np.ndarray):
        self.symbols, self.block, self.first = symbols, block, starts
        begins = np.zeros(len(symbols), np.int64)
        begins[starts] = 1
        self.parent = np.cumsum(begins) - 1
        self.last = np.append(starts[1:], len(symbols)) - 1


def grammar(symbols: np.ndarray, fences: np.ndarray) -> list[Level]:
    """Levels over texts that are parted and enclosed by fences: symbols that occur once and stay.

    ``symbols`` are non-negative; the fences are negative and distinct. Ends when only fences and
    one symbol between each two are left."""
    levels, block = [], True
    rng = np.random.default_rng(len(symbols))
    while len(symbols) >= 2 * len(fences):
        before, here = symbols[:-1], symbols[1:]
        if block:
            merged = before == here
        else:
            sides = rng.integers(0, 2, int(symbols.max()) + 1, dtype=np.int8)
            side = np.where(symbols >= 0, sides[np.maximum(symbols, 0)], -1)
            merged = (side[:-1] == 0) & (side[1:] == 1)
        starts = np.flatnonzero(np.append(True, ~merged))
        level = Level(symbols, block, starts)
        head = symbols[starts]
        if block:
            tail = np.diff(np.append(starts, len(symbols)))
        else:
            tail = np.where(level.last > starts, symbols[level.last] + 1, 0)
        # names by sorting of (first symbol, length or second symbol); fences keep theirs
        inner = head >= 0
        name = head.copy()
        if inner.any():
            width = int(tail.max()) + 1
            name[inner] = np.unique(head[inner] * width + tail[inner], return_inverse=True)[1].ravel()
        levels.append(level)
        symbols, block = name, not block
    levels.append(Level(symbols, True, np.arange(len(symbols))))
    return levels


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many symbols from the places ``a`` and ``b`` (two of one text, not equal) on agree, to the
    right (``way`` 1) or to the left (-1). A fence ends every extension."""
    count = np.zeros(len(a), np.int64)
    if not len(a):
        return count
    begin = a.copy()
    a, b = a.copy(), b.copy()
    met = np.full(len(a), -1)  # level at which the two places were found to differ
    climbing = np.arange(len(a))
    for h, level in enumerate(levels):
        near, far = (level.first, level.last) if way > 0 else (level.last, level.first)
        x, y = a[climbing], b[climbing]
        same = level.symbols[x] == level.symbols[y]
        met[climbing[~same]] = h
        climbing, x, y = climbing[same], x[same], y[same]
        if not len(climbing):
            break
        up, vp = level.parent[x], level.parent[y]
        inside = (near[up] != x) | (near[vp] != y)  # not both at the near edge of their parents
        if level.block:
            # words left of the two blocks; unequal ones differ right behind the shorter
            left, right = np.abs(far[up] - x) + 1, np.abs(far[vp] - y) + 1
            step = np.where(inside, np.minimum(left, right), 0)
            apart = inside & (left != right)
        else:
            step, apart = inside.astype(np.int64), np.zeros(len(x), bool)
        x, y = x + way * step, y + way * step
        # behind a step the next symbols may differ already
        apart |= level.symbols[x] != level.symbols[y]
        a[climbing], b[climbing] = x, y
        met[climbing[apart]] = h
        climbing, x, y = climbing[~apart], x[~apart], y[~apart]
        a[climbing], b[climbing] = level.parent[x], level.parent[y]
    if len(climbing):
        raise AssertionError("two places of one text differ at the top of its grammar")
    # down again: at each level the equal children are passed, one block or one symbol at most
    for h in range(len(levels) - 1, 0, -1):
        low = np.flatnonzero(met >= h)
        if not len(low):
            continue
        level = levels[h - 1]
        near, far = (level.first, level.last) if way > 0 else (level.last, level.first)
        up, vp = a[low], b[low]
        x, y = near[up], near[vp]
        same = level.symbols[x] == level.symbols[y]
        if level.block:
            step = np.minimum(np.abs(far[up] - x), np.abs(far[vp] - y)) + 1
        else:
            step = np.ones(len(x), np.int64)
        step = np.where(same, step, 0)
        a[low], b[low] = x + way * step, y + way * step
    return np.abs(a - begin)


def grid(lengths: np.ndarray, least: int, exponent: int):
    """(text, block start, period) of the harmonic grid, in batches of about GRID_ROWS."""
    most = np.where(lengths >= least, lengths // exponent, 0)
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # even blocks [2kp, 2kp + p) that are followed by p more words
    blocks = np.maximum((lengths[text] - 2 * period) // (2 * period) + 1, 0)
    ends = np.cumsum(blocks)
    begin = 0
    while begin < len(text):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + GRID_ROWS, side="right")))
        n = blocks[begin:end]
        row = np.repeat(np.arange(begin, end), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield text[row], 2 * k * period[row], period[row]
        begin = end


def find_runs(codes: np.ndarray, offs: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of at least ``exponent`` (4 or more) periods and
    ``least`` words, by text, start and period."""
    lengths = np.diff(offs)
    found = []
    for text, at, p in grid(lengths, least, exponent):
        x = offs[text] + at
        for eighths in (0, 7, 4, 2, 6):  # places inside the block
            place = x + p * eighths // 8
            hit = codes[place] == codes[place + p]
            text, x, p = text[hit], x[hit], p[hit]
        found.append((text, x, p))
    text, x, p = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    if not len(text):
        return text, text, text, text
    # the grammar of the texts that hold a candidate, a fence before each and one behind the last
    held, number = np.unique(text, return_inverse=True)
    inner = lengths[held]
    base = np.cumsum(inner + 1) - inner  # first word of each text behind its fence
    symbols = np.empty(int((inner + 1).sum()) + 1, np.int64)
    fences = np.append(base - 1, len(symbols) - 1)
    solid = np.ones(len(symbols), bool)
    solid[fences] = False
    symbols[solid] = codes[np.repeat(offs[held] - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())]
    symbols[fences] = -1 - np.arange(len(fences))
    levels = grammar(symbols, fences)
    place = base[number] + x - offs[text]
    right = extension(levels, place, place + p, 1)
    whole = right >= p
    number, place, p, right = number[whole], place[whole], p[whole], right[whole]
    left = extension(levels, place - 1, place + p - 1, -1)
    start, length = place - left, left + p + right
    long_enough = (length >= least) & (length >= exponent * p)
    number, start, length, p = number[long_enough], start[long_enough], length[long_enough], p[long_enough]
    # multiples of the smallest period give the same stretch
    order = np.lexsort((p, length, start))
    number, start, length, p = number[order], start[order], length[order], p[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[:len(p)]
    number, start, length, p = number[new], start[new], length[new], p[new]
    order = np.lexsort((p, start))
    number, start, length, p = number[order], start[order], length[order], p[order]
    return held[number], start - base[number], length, p


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4, runs: str = "runs",
                  collapsed: str = "collapsed", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add ``runs`` (start and length in words, period; by start, then period) and ``collapsed``, the
    words outside every run's later periods joined by a space, to ``docs``; ``text`` is left out."""
    kept = [c for c in docs.columns if c != text]
    body = "body" + "_" * max(len(c) for c in [*docs.columns, ""])  # no column of this name
    schema = docs.select(*kept).selectExpr("*", f"cast(null as {RUNS}) as `{runs}`", f"cast(null as string) as `{collapsed}`").schema

    def run(batches):
        fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for part in text_slices(batches, slice_bytes, body):
            col, offs = words(*text_buffers(part.column(body)))
            codes, _ = encode(col)
            codes = codes.astype(np.int64)
            doc, start, length, period = find_runs(codes, offs, least, exponent)
            # words after a run's first period go
            edge = np.zeros(len(codes) + 1, np.int64)
            np.add.at(edge, offs[doc] + start + period, 1)
            np.add.at(edge, offs[doc] + start + length, -1)
            stay = np.cumsum(edge[:-1]) == 0
            out = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], fields=list(fields)))
            yield pa.record_batch([*(part.column(c) for c in kept), out, joined(col, stay, offs)], names=[*kept, runs, collapsed])
    return docs.select(*kept, F.col(text).cast("string").alias(body)).mapInArrow(run, schema)


def joined(col: pa.Array, stay: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The staying words of each text, one space between them."""
    data, woffs = text_buffers(col)
    lens = np.diff(woffs)
    mine = np.append(0, np.cumsum(stay))[offs]  # staying words before each text
    keep = np.repeat(stay, lens)
    sizes = lens[stay]
    # one space before each staying word that is not its text's first
    spaced = np.ones(len(sizes), np.int64)
    spaced[mine[:-1][np.diff(mine) > 0]] = 0
    ends = np.cumsum(sizes + spaced)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    begins = ends - sizes
    out[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = data[keep]
    return string_array(out, np.append(0, ends)[mine])
