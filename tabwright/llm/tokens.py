"""Byte-level BPE by a global shuffle of distinct words.

A task cuts its documents into units (pre-tokens, or runs of them that no cut is sure to divide),
numbers the distinct units of a chunk of documents and keeps every document as the list of these
numbers by position. Only the distinct units of each chunk are shuffled, packed by a hash of the unit; the
task of a hash bucket encodes each distinct unit of all chunks once (its pattern matches
separately) and joins the ids to every chunk that asked, where they are put in place by position. Decoding looks up ids in the token-byte table,
whose size is that of the vocabulary.

Cases: a null text counts as empty and has no ids; repeated rows stay; other columns are ignored. A
chunk holds one whole text at least, however long.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import (bucket_count, chunk_name, common_first, encode, gather, ids_and_nulls, ids_array,
                                  pack_ints, pack_words, text_buffers, text_slices, units, unpack_ints, unpack_words,
                                  word_buckets)

CHUNK_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def coded(part: pa.RecordBatch):
    """Distinct units of a chunk, the code of each unit in place, and the documents' offsets."""
    col, offs = units(*text_buffers(part.column("text")))
    return *common_first(*encode(col)), offs


def chunk_words(docs: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """(to_chunk, bucket, places, words): the distinct units of each chunk, packed by bucket."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            vocab = coded(part)[1].cast(pa.binary()).to_pylist()
            chunk = chunk_name(part)
            rows = [(bucket, pack_ints(np.diff(at, prepend=0)), pack_words([vocab[i] for i in at.tolist()]))
                    for bucket, at in word_buckets(vocab, buckets)]
            for a in range(0, len(rows), 4096):
                some = list(zip(*rows[a:a + 4096]))
                yield pa.record_batch([pa.array([chunk] * len(some[0]), pa.int64()), pa.array(some[0], pa.int64()),
                                       pa.array(some[1], pa.binary()), pa.array(some[2], pa.binary())],
                                      names=["to_chunk", "bucket", "places", "words"])
    return docs.mapInArrow(run, "to_chunk long, bucket long, places binary, words binary")


def chunk_places(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, payload): the documents of each chunk as numbers of its units, by position."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, _, offs = coded(part)
            yield pa.record_batch([pa.array([chunk_name(part)], pa.int64()),
                                   pa.array([pack_ints(*ids_and_nulls(part), offs, codes)], pa.binary())],
                                  names=["chunk", "payload"])
    return docs.mapInArrow(run, "chunk long, payload binary")


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_bytes: int = CHUNK_BYTES,
               bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text), a table or another frame that gives
    the same partitions when read again: chunks are named by content, and one whose words were
    not all answered is an error."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = chunk_words(docs, bucket_count(docs, bucket_bytes), chunk_bytes)

    def answer(group):
        """Encode each distinct unit of the bucket once, and join the ids to every chunk that asked."""
        import tiktoken
        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        known: dict[bytes, bytes] = {}
        out = []
        for blob in group.column("words").to_pylist():
            ids = []
            for w in unpack_words(blob):
                if w not in known:
                    known[w] = np.array(bpe.encode_ordinary(w.decode()), np.uint32).tobytes()
                ids.append(known[w])
            out.append(pack_ints([len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), np.uint32)))
        return pa.table({"to_chunk": group.column("to_chunk"), "places": group.column("places"), "ids": pa.array(out, pa.binary())})

    replies = asked.groupBy("bucket").applyInArrow(answer, "to_chunk long, places binary, ids binary")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def place(left, right):
        # equal chunks share a name, and then each unit is answered once for each of them
        pos = [np.cumsum(unpack_ints(x)[0]) for x in right.column("places").to_pylist()]
        pos, order = np.unique(np.concatenate(pos) if pos else np.zeros(0, np.int64), return_index=True)
        got = [unpack_ints(x) for x in right.column("ids").to_pylist()]
        lens = np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.int64)
        loffs = np.append(0, np.cumsum(lens))
        flat = np.concatenate([x[1] for x in got]).astype(np.int32) if got else np.zeros(0, np.int32)
        flat, loffs = gather(flat, loffs, order), np.append(0, np.cumsum(lens[order]))
        rows = []
        for blob in left.column("payload").to_pylist():
            ids, nulls, offs, codes = unpack_ints(blob)
            if len(codes) and (len(pos) <= codes.max() or pos[-1] != len(pos) - 1):
                raise RuntimeError("a chunk's words were not all answered: the input changed between two reads")
            for a in range(0, len(ids), 512):
                b = min(a + 512, len(ids))
                own = codes[offs[a]:offs[b]]
                ends = np.append(0, np.cumsum(np.diff(loffs)[own]))
                lens = ends[offs[a:b + 1] - offs[a]]
                rows.append(pa.record_batch([
                    ids_array(ids[a:b], nulls[a:b]),
                    pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(gather(flat, loffs, own), pa.int32()))],
                    names=["doc_id", "ids"]).cast(schema))
        return pa.Table.from_batches(rows, schema)

    return chunk_places(docs, chunk_bytes).groupBy("chunk").cogroup(replies.groupBy("to_chunk")) \
        .applyInArrow(place, "doc_id long, ids array<int>")


def bpe_decode(ids: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of ``ids`` by the token-byte table.

    The table has one row per token, so its size is the vocabulary's and never the data's.
    """
    size = max(ranks.values()) + 1
    by_id: list[bytes] = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    toffs = np.append(0, np.cumsum([len(t) for t in by_id])).astype(np.int64)
    joined = np.frombuffer(b"".join(by_id), np.uint8)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
                own = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.append(0, np.cumsum(np.diff(toffs)[own]))
                doc = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
                data = gather(joined, toffs, own)
                decoded = pa.BinaryArray.from_buffers(
                    pa.binary(), batch.num_rows,
                    [None, pa.py_buffer(ends[doc].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), decoded],
                                      names=["doc_id", "ids", "decoded"])
    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
