"""Shortest-pack-first packing over the length histogram.

Documents are tokenized and cut into pieces of at most ``width`` ids. The histogram of piece
lengths (at most ``width`` counts) is packed on the driver: lengths are placed longest first into
the open pattern with the most room left, whole groups of equal patterns at a time. Patterns
are joined back to the pieces by length and rank; ranks come from per-slice counts, so a length
that holds most pieces is still numbered in parallel.

Cases: a null text counts as empty and yields the closing id alone; a special string in a text is its
one id; repeated rows are packed each; other columns are ignored; an empty table yields no rows. A
slice holds one whole text at least, however long.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import encode, gather, stage_table, text_buffers, text_slices, units

# rows of one length that one group ranks
SLICE_ROWS = 500
# ids of units seen before by this Python worker, by tokenizer file; emptied at CACHE_UNITS
_SEEN: dict[str, dict[str, bytes]] = {}
CACHE_UNITS = 400_000
# slices of a length that one group of the two-level prefix holds
SLICE_GROUP = 1000
# Fixed value: the pattern that byte-level tokenizers split by
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(tokenizer: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids, and special strings to ids, of a tokenizers file with a byte-level BPE whose
    ids follow the order of its merges; any other file is an error."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    # byte-level vocabularies write each byte as a printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pre = spec.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not (pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges")
                      or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)))
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    if not plain or [model["vocab"][m] for m in merges] != sorted(model["vocab"][m] for m in merges):
        raise ValueError(f"{tokenizer} is no plain byte-level BPE with ids in the order of its merges")
    return ranks, special


def unit_ids(vocab: list[str], bpe, seen: dict[str, bytes]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each unit."""
    new = [w for w in vocab if w not in seen]
    if len(seen) + len(new) > CACHE_UNITS:
        seen.clear()
        new = vocab
    for w in new:
        seen[w] = array("I", bpe.encode_ordinary(w)).tobytes()
    return [seen[w] for w in vocab]


def slice_ids(part: pa.RecordBatch, bpe, special: dict[str, int], seen: dict[str, bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text of a slice, closed by ``end_id``, and their offsets."""
    data, bytes_at = text_buffers(part.column("text"))
    col, offs = units(data, bytes_at)
    codes, vocab = encode(col)
    blobs = unit_ids(vocab.to_pylist(), bpe, seen)
    # texts that hold a special string are encoded whole, as a vocabulary entry each
    whole = bytes(data) if special else b""
    held = {int(np.searchsorted(bytes_at, m.start(), side="right")) - 1
            for m in re.finditer("|".join(map(re.escape, special)).encode(), whole)} if special else set()
    ends = offs[1:]
    inner = codes
    if held:
        text = part.column("text")
        replaced = np.array(sorted(held))
        gone = np.repeat(np.isin(np.arange(part.num_rows), replaced), np.diff(offs))
        kept = np.append(0, np.cumsum(~gone))
        at = kept[offs[replaced]]
        inner = np.insert(codes[~gone], at, len(blobs) + np.arange(len(replaced)))
        ends = kept[ends] + np.searchsorted(replaced, np.arange(part.num_rows), side="right")
        blobs = blobs + [array("I", bpe.encode(text[i].as_py(), allowed_special="all")).tobytes() for i in replaced.tolist()]
    inner = np.insert(inner, ends, len(blobs))
    ends = ends + np.arange(1, part.num_rows + 1)
    blobs = blobs + [array("I", [end_id]).tobytes()]
    flat = np.frombuffer(b"".join(blobs), "<u4")
    voffs = np.append(0, np.cumsum([len(x) // 4 for x in blobs])).astype(np.int64)
    counts = np.append(0, np.cumsum(np.diff(voffs)[inner]))
    return gather(flat, voffs, inner), counts[np.append(0, ends)]


def token_pieces(docs: DataFrame, tokenizer: str, width: int, end_id: int = 0, with_ids: bool = True,
                 slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): ids of each text, then ``end_id``.

    ``ids`` are little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text,
    add_special_tokens=False)`` gives them: a special string in a text is its one id. A task encodes
    each distinct unit of a slice of documents once, by the vocabulary as ranks, and gathers the
    slice's ids by position.
    """
    ranks, special = byte_ranks(tokenizer)

    def run(batches):
        import tiktoken
        bpe = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        for part in text_slices(batches, slice_bytes):
            flat, offs = slice_ids(part, bpe, special, _SEEN.setdefault(tokenizer, {}), end_id)
            lens = np.diff(offs)
            pieces = -(-lens // width)
            doc = np.repeat(np.arange(part.num_rows), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
            length = np.minimum(width, lens[doc] - start)
            place = offs[doc] + start
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * place).tolist(), (4 * (place + length)).tolist())]
            columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(lens[doc], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                edges = (4 * np.append(place, len(flat))).astype(np.int32)
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(raw)]))
                names.append("ids")
            yield pa.record_batch(columns, names=names)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, count) that hold the histogram; the work depends on ``width`` only."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(width - 1, length - 1, -1) if open_by_room.get(r)), None)
            if room is None:
                fit = max(1, width // length)
                # new patterns of one piece each; shorter lengths fill them later
                if length * 2 <= width and left >= fit:
                    put = ((length,) * fit, left // fit)
                    left -= put[1] * fit
                else:
                    put = ((length,), left)
                    left = 0
                open_by_room.setdefault(width - length * len(put[0]), []).append(put)
                continue
            pattern, count = open_by_room[room].pop()
            used = min(left, count)
            if count > used:
                open_by_room[room].append((pattern, count - used))
            open_by_room.setdefault(room - length, []).append((pattern + (length,), used))
            left -= used
    merged: dict[tuple[int, ...], int] = {}
    for patterns in open_by_room.values():
        for pattern, count in patterns:
            merged[pattern] = merged.get(pattern, 0) + count
    return sorted(merged.items())


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, last_rank, first_sequence, offset, step): where the ranks of a length go."""
    out, next_rank, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            out.append((length, rank, rank + count - 1, sequence, offset, 1))
            next_rank[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, width: int, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (with a ``length`` of 1 to ``width``).

    Sequences hold at most ``width``; offsets are gapless from 0. ``pieces`` should be a written
    table: it is read for the histogram and again for the ranks.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `width` rows
    slots = spark.createDataFrame(
        pattern_slots(shortest_pack_first({r.length: r.n for r in counts}, width)) or [],
        "slot_length long, first_rank long, last_rank long, first_sequence long, slot_offset long, step long")
    # each length has slices by its own count, so a frequent length is ranked by many tasks
    slices = spark.createDataFrame([(r.length, 1 + r.n // SLICE_ROWS) for r in counts] or [], "length long, slices long")
    cut = pieces.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64(*keys), F.col("slices")))
    # the ranks before each (length, slice), in two levels: no window holds all slices of a length
    block = F.floor(F.col("slice") / SLICE_GROUP)
    counted = cut.groupBy("length", "slice").agg(F.count("*").alias("n")).withColumn("block", block)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("length", "block").agg(F.sum("n").alias("n")) \
        .withColumn("block_base", F.coalesce(F.sum("n").over(before("length").orderBy("block")), F.lit(0))).drop("n")
    sizes = counted.withColumn("inner_base", F.coalesce(F.sum("n").over(before("length", "block").orderBy("slice")), F.lit(0))) \
        .join(blocks, ["length", "block"]) \
        .select("length", "slice", (F.col("block_base") + F.col("inner_base")).alias("rank_base"))
    ranked = cut.withColumn("rank_in", F.row_number().over(Window.partitionBy("length", "slice").orderBy(*keys)) - 1) \
        .join(sizes, ["length", "slice"]).withColumn("rank", F.col("rank_base") + F.col("rank_in"))
    # the slot table has at most `width` x pattern rows, whatever the data's size
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length"))
                         & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    return placed.select(*pieces.columns,
                         (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
                         F.col("slot_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0,
                   with_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text)."""
    return pack(stage_table(token_pieces(docs, tokenizer, width, end_id, with_ids), "pieces"), width)
