"""N-gram Jaccard self-join with set-relation skipping.

A document's set holds 64-bit hashes of its distinct shingles. Equal sets are one class, named by
a 128-bit hash. The exact join has four steps:

1. Document frequencies. Tasks send the distinct shingle hashes of a chunk of documents, cut to a
   width that grows with the input and packed as sorted differences, to buckets; each bucket
   answers every chunk with the frequencies. A cut can only raise a frequency, so a set with under
   80 % of shingles seen twice links with nothing and leaves.
2. Index lists. The remaining sets are ordered rarest shingle first and listed by the shingles of
   their prefixes, positions beyond which no linked pair can first meet. The lists are cut into blocks
   by set size, and a set is entered only in the blocks that its position can reach; blocks without
   a possible pair are skipped. Every linked pair meets in a block.
3. Leaders. Each block's sets are compared with its leader, the set with the fewest shingles of its
   own, and links are joined into components.
4. Skipping. The sets of a leader's lists are dealt into cells by their distance from it, already
   computed. As Jaccard distance is a metric, two sets whose distances differ by more than the
   threshold cannot link, so the answer of a set is derived from its leader's: pairs of cells too
   far apart are skipped as blocks, as are cells inside the leader's component. The other pairs of
   cells are compared whole, and only links between components are returned.

Cases: null, empty and blank texts have empty sets that link with nothing; fewer than ``width``
words make one shingle of the whole sequence; rows with equal texts share a component; repeated
rows are returned each; other columns are ignored. A chunk holds one whole text at least, however long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import (LOWER, chunk_name, common_first, encode, gather, pack_ints, stage_table, text_buffers,
                                  text_slices, unpack_ints, words)
from tabwright.llm.graph import components
from tabwright.llm.vectors import forest

CHUNK_BYTES = 8 << 20
CELL_SETS = 512
FAR_STEP = 0.05
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(hashes: np.ndarray, codes: np.ndarray, offs: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each document, concatenated, and their offsets."""
    n_docs = len(offs) - 1
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offs)
    rolled = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            # position k of the shingle; a document of fewer words uses all it has
            part = np.zeros(len(h), np.uint64)
            part[:len(h) - k] = h[k:]
            inside = np.arange(len(h)) + k < np.repeat(offs[1:], n)
            rolled = mixed(rolled * MIX + np.where(inside, part, np.uint64(0)) + np.uint64(k + 1))
    place = np.arange(len(h)) - np.repeat(offs[:-1], n)
    own = (place == 0) | (place + width <= np.repeat(n, n))
    doc = np.repeat(np.arange(n_docs), n)[own]
    h = rolled[own]
    by = np.argsort(h)
    doc, h = doc[by], h[by]
    by = np.argsort(doc.astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")
    doc, h = doc[by], h[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def set_names(h: np.ndarray, offs: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def word_hashes(vocab: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64)


def coded(part: pa.RecordBatch):
    """Code of each word in place, distinct words, and the documents' offsets."""
    data, offs = text_buffers(part.column("text"))
    word, offs = words(LOWER[data], offs)
    codes, vocab = common_first(*encode(word))
    return codes, vocab.cast(pa.binary()).to_pylist(), offs


def distinct_sets(vocab: list[bytes], codes: np.ndarray, woffs: np.ndarray, width: int):
    """Distinct non-empty sets of a chunk: names, hashes, offsets."""
    h, offs = shingle_sets(word_hashes(vocab), codes, woffs, width)
    names = set_names(h, offs)
    first = {}
    for i, x in enumerate(names):
        if x is not None:
            first.setdefault(x, i)
    keep = np.array(list(first.values()), np.int64)
    return list(first), gather(h, offs, keep), np.append(0, np.cumsum(np.diff(offs)[keep])).astype(np.int64)


def cut_hashes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct leading bits of all hashes, and the number of sets that hold each."""
    return np.unique(h >> np.uint64(64 - bits), return_counts=True)


def documents_of(docs: DataFrame, width: int, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_id, row, n, sid) of every document."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, vocab, woffs = coded(part)
            h, offs = shingle_sets(word_hashes(vocab), codes, woffs, width)
            yield pa.record_batch([pa.array([chunk_name(part)] * part.num_rows, pa.int64()), part.column("doc_id"),
                                   part.column("row"), pa.array(np.diff(offs), pa.int64()), pa.array(set_names(h, offs), pa.binary())],
                                  names=["chunk", "doc_id", "row", "n", "sid"])
    return docs.mapInArrow(run, "chunk long, doc_id long, row long, n long, sid binary")


def chunk_places(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, payload, vocab): the documents of each chunk as numbers of its words, and the words."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, vocab, woffs = coded(part)
            # words hold no white space
            yield pa.record_batch([pa.array([chunk_name(part)], pa.int64()), pa.array([pack_ints(woffs, codes)], pa.binary()),
                                   pa.array([zstandard.compress(b" ".join(vocab), 3)], pa.binary())],
                                  names=["chunk", "payload", "vocab"])
    return docs.mapInArrow(run, "chunk long, payload binary, vocab binary")


def frequencies(docs: DataFrame, width: int, bits: int, bucket_bits: int, chunk_bytes: int) -> DataFrame:
    """(to_chunk, bucket, levels): for each chunk's cut hashes of a bucket in order, min(frequency, 255)."""
    low = np.uint64(bits - bucket_bits)

    def ask(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, vocab, woffs = coded(part)
            _, h, _ = distinct_sets(vocab, codes, woffs, width)
            cut, n = cut_hashes(h, bits)
            bucket = (cut >> low).astype(np.int64)
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(cut)) if len(cut) else np.zeros(1, np.int64)
            rest = cut & ((np.uint64(1) << low) - np.uint64(1))
            rows = [(int(bucket[a]), pack_ints(np.diff(rest[a:b], prepend=np.uint64(0)), n[a:b]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            chunk = chunk_name(part)
            for a in range(0, len(rows), 4096):
                some = rows[a:a + 4096]
                yield pa.record_batch([pa.array([chunk] * len(some), pa.int64()), pa.array([r[0] for r in some], pa.int64()),
                                       pa.array([r[1] for r in some], pa.binary())], names=["to_chunk", "bucket", "asked"])

    def answer(group):
        chunk, bucket = group.column("to_chunk"), group.column("bucket")[0]
        asked = [unpack_ints(x) for x in group.column("asked").to_pylist()]
        values = [np.cumsum(a[0]) for a in asked]
        every = np.concatenate(values)
        distinct, place = np.unique(every, return_inverse=True)
        total = np.minimum(np.bincount(place, weights=np.concatenate([a[1] for a in asked])), 255).astype(np.uint8)
        ends = np.append(0, np.cumsum([len(v) for v in values]))
        levels = [zstandard.compress(total[place[a:b]].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"to_chunk": chunk.combine_chunks(), "bucket": pa.array([bucket.as_py()] * len(asked), pa.int64()),
                         "levels": pa.array(levels, pa.binary())})

    return docs.mapInArrow(ask, "to_chunk long, bucket long, asked binary") \
        .groupBy("bucket").applyInArrow(answer, "to_chunk long, bucket long, levels binary")


def linkable_sets(docs: DataFrame, rows: DataFrame, width: int, bits: int, bucket_bits: int, pct: int,
                  chunk_bytes: int) -> DataFrame:
    """(sid, n, items, prefix): sets that may link; ``items`` sorted hashes, ``prefix`` rarest first."""
    owned = rows.where("sid is not null").groupBy("sid").agg(F.min("chunk").alias("to_chunk"))
    replies = frequencies(docs, width, bits, bucket_bits, chunk_bytes).unionByName(
        owned.select("to_chunk", F.lit(-1).cast("long").alias("bucket"), F.col("sid").alias("levels")))
    schema = pa.schema([("sid", pa.binary()), ("n", pa.int64()), ("items", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def place(left, right):
        reply = right.combine_chunks().sort_by("bucket")
        bucket = reply.column("bucket").to_numpy()
        blobs = reply.column("levels").to_pylist()
        mine = {x for x, b in zip(blobs, bucket.tolist()) if b < 0}
        # equal chunks share a name, and then each bucket has answered once for each of them
        answers = {b: x for x, b in zip(blobs, bucket.tolist()) if b >= 0}
        levels = np.frombuffer(b"".join(zstandard.decompress(x) for x in answers.values()), np.uint8)
        out = [[], [], [], []]
        for blob, vocab in zip(left.column("payload").to_pylist(), left.column("vocab").to_pylist()):
            woffs, codes = unpack_ints(blob)
            names, h, offs = distinct_sets(zstandard.decompress(vocab).split(b" "), codes, woffs, width)
            if not names:
                continue
            cut, _ = cut_hashes(h, bits)
            if len(levels) != len(cut):
                raise RuntimeError("a chunk's shingles were not all answered: the input changed between two reads")
            level = levels[np.searchsorted(cut, h >> np.uint64(64 - bits))]
            twice = np.append(0, np.cumsum(level > 1))
            n = np.diff(offs)
            may = np.flatnonzero(100 * (twice[offs[1:]] - twice[offs[:-1]]) >= pct * n)
            for i in may.tolist():
                if names[i] not in mine:
                    continue
                own, rare = h[offs[i]:offs[i + 1]], level[offs[i]:offs[i + 1]]
                k = len(own) - -(-pct * len(own) // 100) + 1
                head = np.lexsort((own, rare))[:k]
                out[0].append(names[i])
                out[1].append(len(own))
                out[2].append(own.tobytes())
                # places in the order count single shingles too, which no other set has
                single = int((rare[head] == 1).sum())
                out[3].append(np.append(np.int64(single), own[head[single:]].view(np.int64)))
        return pa.table([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return chunk_places(docs, chunk_bytes).groupBy("chunk").cogroup(replies.groupBy("to_chunk")) \
        .applyInArrow(place, "sid binary, n long, items binary, prefix array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``common`` to (a, b, ...): shingles in both sets."""
    def run(batches):
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                      for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())]
            yield pa.record_batch([batch.column(x) for x in ("a", "b", "na", "nb")] + [pa.array(common, pa.int64())],
                                  names=["a", "b", "na", "nb", "common"])
    to = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("items").alias(f"x{c}"))
    return pairs.join(to("a"), "a").join(to("b"), "b").mapInArrow(run, "a binary, b binary, na long, nb long, common long")


def linked(pct: int):
    return 100 * F.col("common") >= pct * (F.col("na") + F.col("nb") - F.col("common"))


def index_blocks(sets: DataFrame, pct: int) -> DataFrame:
    """(item, block, sid, leader): the index lists, cut into blocks that can hold links.

    Block k of a list holds the sets of size class k (a class is a factor of 100 / pct wide, so linked
    sets are of the same class or of neighbouring ones) and, as visitors, those of class k - 1 whose
    position lets them reach it: two sets that first meet at positions p and q have at most
    min(n - p, m - q) shingles in common and need pct / (100 + pct) of n + m, so a set at position p
    links with sets of at most (n - p) * (100 + pct) / pct - n shingles there. Every linked pair is in
    the block of its larger set in the list where it first meets; the other blocks are skipped, and
    so are those with fewer than two sets or visitors only."""
    class_of = lambda n: F.floor(F.ln(F.greatest(n, F.lit(1)).cast("double")) / math.log(100 / pct)).cast("int")
    single = F.element_at("prefix", 1)
    index = sets.select("sid", "n", single.alias("single"), F.posexplode(F.slice("prefix", 2, F.greatest(F.size("prefix") - 1, F.lit(0)))).alias("i", "item"))
    most = F.floor((F.col("n") - F.col("single") - F.col("i")) * (100 + pct) / pct) - F.col("n")
    own = class_of(F.col("n"))
    blocks = F.when(class_of(most) > own, F.array(own, own + 1)).otherwise(F.array(own))
    entries = stage_table(index.select("sid", "single", "item", own.alias("class"), F.explode(blocks).alias("block")), "jaccard-index")
    # the leader has the fewest shingles of its own: the source of a group of copies rather than a copy
    lists = entries.groupBy("item", "block").agg(F.min(F.struct("single", "sid")).alias("leader"), F.count(F.lit(1)).alias("sets"),
                                                 F.max("class").alias("top")) \
        .where((F.col("sets") > 1) & (F.col("top") == F.col("block"))).select("item", "block", F.col("leader.sid").alias("leader"))
    return entries.select("item", "block", "sid").join(lists, ["item", "block"])


def set_components(sets: DataFrame, pct: int) -> DataFrame:
    """(node, root) of all linked sets."""
    lists = stage_table(index_blocks(sets, pct), "jaccard-lists")
    stars = lists.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct()
    compared = stage_table(overlaps(stars, sets), "jaccard-stars")
    links = compared.where(linked(pct)).select("a", "b")
    roots = stage_table(components(links), "jaccard-roots")
    more = open_links(compared, roots, sets, pct)
    return components(links.unionByName(more))


def open_links(compared: DataFrame, roots: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """(a, b): links between components that a leader's sets still have among themselves.

    The sets of a leader are dealt into cells by their distance from it, FAR_STEP wide and of about
    CELL_SETS sets. Two cells are compared if their distances leave room for a link and one of them
    holds a set outside the leader's component; a task returns the smallest component that each
    component is linked to, never the pairs.
    """
    def root_of(c: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    far = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    members = compared.select("a", "b", F.floor(far / FAR_STEP).cast("int").alias("ring")) \
        .join(root_of("a"), "a", "left").join(root_of("b"), "b", "left") \
        .select("a", "b", "ring", F.coalesce("root_b", "b").alias("root"),
                (F.coalesce("root_b", "b") != F.coalesce("root_a", "a")).alias("outside"))
    members = stage_table(members, "jaccard-members")
    rings = members.groupBy("a", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("outside").alias("outside")) \
        .withColumn("parts", (1 + F.col("n") / CELL_SETS).cast("int"))
    cells = rings.select("a", "ring", "outside", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x, y = (cells.select("a", *(F.col(c).alias(f"{p}_{c}") for c in ("ring", "part", "outside"))) for p in "xy")
    reach = math.ceil((1 - pct / 100) / FAR_STEP + 1e-9) + 1
    pairs = x.join(y, "a").where(
        (F.struct("x_ring", "x_part") <= F.struct("y_ring", "y_part")) & (F.col("y_ring") - F.col("x_ring") < reach)
        & (F.col("x_outside") | F.col("y_outside"))).withColumn("pair", F.xxhash64("a", "x_ring", "x_part", "y_ring", "y_part"))
    # both cells of a pair: one row if they are the same
    sides = pairs.select("a", "pair", F.explode(F.array_distinct(F.array(
        F.struct(F.col("x_ring").alias("ring"), F.col("x_part").alias("part")),
        F.struct(F.col("y_ring").alias("ring"), F.col("y_part").alias("part"))))).alias("cell")).select("a", "pair", "cell.*")
    dealt = members.join(rings.select("a", "ring", "parts"), ["a", "ring"]) \
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")) \
        .join(sides, ["a", "ring", "part"]).select("pair", "ring", "part", "root", "outside", F.col("b").alias("sid")) \
        .join(sets.select("sid", "n", "items"), "sid")

    def compare(group):
        cell = group.column("ring").to_numpy() * (1 << 20) + group.column("part").to_numpy()
        outside = np.array(group.column("outside").to_pylist(), bool)
        names, root = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)
        n = group.column("n").to_numpy()
        items = np.frombuffer(b"".join(group.column("items").to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        _, column, times = np.unique(items, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        one = np.flatnonzero(cell == cell.min())
        two = np.flatnonzero(cell == cell.max())
        common = np.zeros((len(one), len(two)), np.float32)
        width = int(column.max()) + 1 if len(column) else 0
        for c in range(0, width, 4096):
            here = (column >= c) & (column < c + 4096)
            has = np.zeros((len(n), min(4096, width - c)), np.float32)
            has[owner[here], column[here] - c] = 1
            common += has[one] @ has[two].T
        common = common.astype(np.int64)
        link = (100 * common >= pct * (n[one][:, None] + n[two][None, :] - common)) \
            & (outside[one][:, None] | outside[two][None, :]) & (root[one][:, None] != root[two][None, :])
        p, q = np.nonzero(link)
        least = forest(root[one][p], root[two][q], len(names))
        moved = np.flatnonzero(least != np.arange(len(names)))
        return pa.table({"a": pa.array(names[least[moved]].tolist(), pa.binary()), "b": pa.array(names[moved].tolist(), pa.binary())})

    return dealt.groupBy("pair").applyInArrow(compare, "a binary, b binary")


def jaccard_components(docs: DataFrame, width: int = 5, pct: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) for every row of ``docs``; ``row`` is xxhash64 of the text."""
    named = row_roots(docs, width, pct, chunk_bytes)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def row_roots(docs: DataFrame, width: int = 5, pct: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, row, n, root) for every row of ``docs``, written: rows of one root are one component,
    and rows with an empty set have none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
                       F.col("text").cast("string").alias("text"))
    rows = stage_table(documents_of(docs, width, chunk_bytes), "jaccard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    # five bits more than the shingles need, so few frequencies are raised; buckets of about a million
    bits = max(16, math.ceil(math.log2(total + 1)) + 5)
    bucket_bits = max(4, bits - 25)
    sets = stage_table(linkable_sets(docs, rows, width, bits, bucket_bits, pct, chunk_bytes), "jaccard-sets")
    roots = set_components(sets, pct)
    named = rows.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left") \
        .withColumn("root", F.coalesce("root", "sid"))
    return stage_table(named.select("doc_id", "row", "n", "root"), "jaccard-named")
