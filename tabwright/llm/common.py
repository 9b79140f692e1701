"""Shared helpers: reading tables, writing stage tables, and splitting Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import stage

# ASCII white space \x09-\x0D and \x20: the separators of `[^\x20\x09-\x0D]+` words
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# kinds of a byte for cutting pre-tokens; K_WIDE belongs to characters beyond ASCII
K_SPACE, K_LETTER, K_DIGIT, K_OTHER, K_WIDE = range(5)
KIND = np.full(256, K_OTHER, np.uint8)
KIND[SPACE] = K_SPACE
KIND[28:32] = K_WIDE  # read as white space by some pattern engines: no cut beside them
KIND[[*range(65, 91), *range(97, 123)]] = K_LETTER
KIND[48:58] = K_DIGIT
KIND[128:] = K_WIDE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the application's folder below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage reliably: lost executors lose nothing, and the Python work above is not run
    again by each later reader. The folder goes when the driver process ends.
    """
    return stage(df, name)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it in either case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_slices(batches, max_bytes: int, text: str = "text"):
    """Cut record batches into slices of at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = text_buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offs, offs[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null text counts as empty."""
    col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off_buf, data_buf = col.buffers()
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(off_buf, dtype=width)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def string_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A string column over contiguous pieces of ``data``."""
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)),
                                       pa.py_buffer(np.ascontiguousarray(data)))


def encode(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes in order of first appearance, and the distinct values."""
    d = col.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def words(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of bytes that are not ``between`` (`[^\\x20\\x09-\\x0D]+` words by default),
    and the offsets of each document's."""
    solid = ~between[data]
    first = solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        inner = offs[:-1][np.diff(offs) > 0]
        first[inner] = solid[inner]
    kept = data[solid]
    # word starts counted in the text without white space
    place = np.flatnonzero(first[solid])
    woffs = np.append(place, len(kept))
    starts = np.flatnonzero(first)
    return string_array(kept, woffs), np.searchsorted(starts, offs)


def units(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut texts at places where the pre-token pattern always ends a match.

    These are: before a white-space run that follows a solid character, and between two ASCII
    characters of different kind (letter, digit, other), except after an apostrophe, which may
    begin a contraction. A cut is never made next to a wider character, whose kind is not looked up.
    """
    if len(data) == 0:
        return string_array(data, np.zeros(1, np.int64)), np.zeros(len(offs), np.int64)
    kind = KIND[data]
    cut = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    cut[1:] = (before != here) & (before != K_SPACE) & (before != K_WIDE) & (here != K_WIDE) & (data[:-1] != 39)
    # a white-space run may also follow a wide character that is no white space itself
    wide = np.flatnonzero((before == K_WIDE) & (here == K_SPACE))
    cut[wide[~_wide_space(data, wide)] + 1] = True
    inner = offs[:-1][np.diff(offs) > 0]
    cut[inner] = True
    starts = np.flatnonzero(cut)
    return string_array(data, np.append(starts, len(data))), np.searchsorted(starts, offs)


def _wide_space(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the wide characters that end at ``last`` may be white space (C2 85, C2 A0, E1-E3 xx xx)."""
    one, two = data[np.maximum(last - 1, 0)], data[np.maximum(last - 2, 0)]
    return ((one == 0xC2) & ((data[last] == 0x85) | (data[last] == 0xA0))) | ((two >= 0xE1) & (two <= 0xE3) & (one >= 0x80))


def gather(values: np.ndarray, offs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenate values[offs[c]:offs[c+1]] over ``codes``."""
    lens = np.diff(offs)[codes]
    if len(lens) == 0 or lens.sum() == 0:
        return values[:0]
    ends = np.cumsum(lens)
    at = np.arange(ends[-1]) + np.repeat(offs[:-1][codes] - (ends - lens), lens)
    return values[at]


def pack_ints(*arrays: np.ndarray) -> bytes:
    """Compressed arrays of non-negative integers, stored byte plane by byte plane."""
    out = []
    for a in arrays:
        a = np.asarray(a, np.uint64)
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [np.array([width, len(a)], np.int64).tobytes(), np.ascontiguousarray(planes).tobytes()]
    return zstandard.compress(b"".join(out), 3)


def unpack_ints(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        width, n = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n).T
        out.append(a.view(np.uint64).ravel().astype(np.int64) if n else np.zeros(0, np.int64))
        at += 16 + width * n
    return out


def common_first(codes: np.ndarray, vocab: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Renumber codes so that frequent values have small ones, which pack better."""
    order = np.argsort(-np.bincount(codes, minlength=len(vocab)), kind="stable")
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    return rank[codes], vocab.take(pa.array(order))


def chunk_name(part: pa.RecordBatch) -> int:
    """A name of a chunk of rows by its ids and texts: each evaluation of the same rows agrees on it."""
    data, offs = text_buffers(part.column("text"))
    h = xxhash.xxh3_64(np.ascontiguousarray(data).tobytes())
    h.update(offs.tobytes())
    h.update(part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
    return h.intdigest() - (1 << 63)


def pack_words(vocab: list[bytes]) -> bytes:
    """Compressed words; none holds byte FF, which no UTF-8 text has."""
    return zstandard.compress(b"\xff".join(vocab), 3)


def unpack_words(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b"\xff")


def word_buckets(vocab: list[bytes], buckets: int):
    """(bucket, places) of a chunk's distinct words: each word belongs to the bucket of its hash."""
    if not vocab:
        return
    bucket = np.array([xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order)).tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        yield int(bucket[order[a]]), order[a:b]


def bucket_count(docs: DataFrame, bucket_bytes: int) -> int:
    """One bucket for so many bytes of text: a bucket's words stay as many however large the table."""
    return 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes


def ids_and_nulls(part: pa.RecordBatch) -> list[np.ndarray]:
    """doc_id as non-negative integers, and which are null."""
    ids = part.column("doc_id")
    return [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
            ids.is_null().to_numpy(zero_copy_only=False)]


def ids_array(ids: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.array(ids.astype(np.int64), pa.int64(), mask=nulls.astype(bool))


def list_of(values: pa.Array) -> pa.Array:
    """One row that holds all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
