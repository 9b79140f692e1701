"""Embedding near-dedup by collision-counting projections.

Every distinct vector is normalised and projected on many random directions. Two vectors at
distance d collide in a projection when their values differ by at most ``reach``; over Gaussian
directions the number of collisions is binomial, with a chance that is known for the distance at
the threshold and larger below it. ``calibrated`` picks the smallest count that such a pair
reaches with the wanted recall; pairs with that many collisions are verified by the double
precision cosine.

Counting works on sorted projections. The first projection cuts the vectors into blocks of
consecutive values, and blocks whose gap exceeds what linked pairs can show (``z_first`` standard
deviations, part of the recall) are never paired. In a pair of blocks each projection of the
second block is sorted, and a bit set is kept for the vectors up to every STRIDE-th place; the
window centred on a query is the difference of two such sets, widened outward to whole strides,
and a carry-save adder counts the windows of all projections for 64 vectors at a time.

Equal vectors are one class. Tasks return counts and a spanning forest of the links they verify,
so output grows with the vectors, not with the pairs.

At 0.95 the window of an evenly spread 64-dimensional table holds a large part of all vectors, so
counting costs grow with the square of the distinct vectors there (about 1 ns a pair); tables with
cluster structure pair fewer blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different length never link. Every row is returned once: classes of equal vectors are named
by a written row number, so a vec_id may be null or repeat, with the same vector or another; a null
vec_id comes last in a component, whose component_id is null only if all its ids are. An empty table
yields no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import stage_table
from tabwright.llm.graph import components

STRIDE = 64


def phi(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def calibrated(projections: int, reach: float, distance: float, recall: float) -> int:
    """Largest count that a pair at ``distance`` reaches with probability ``recall``."""
    p = 2 * phi(reach / distance) - 1
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def normalised(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def window_candidates(queries: np.ndarray, rows: np.ndarray, reach: float, least: int):
    """Pairs (query, row) that collide in ``least`` projections or more, from projected values."""
    n, m = rows.shape
    words = -(-n // 64)
    marks = -(-n // STRIDE) + 1
    upto = np.zeros((m, marks, words), np.uint64)
    low = np.empty((m, len(queries)), np.int64)
    high = np.empty((m, len(queries)), np.int64)
    for j in range(m):
        order = np.argsort(rows[:, j], kind="stable")
        values = rows[order, j]
        bit = np.zeros((marks - 1, words * 64), np.uint8)
        bit[np.arange(n) // STRIDE, order] = 1
        own = np.packbits(bit.reshape(marks - 1, words, 64), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
        upto[j, 1:] = np.bitwise_xor.accumulate(own, axis=0)
        low[j] = np.searchsorted(values, queries[:, j] - reach, side="left") // STRIDE
        high[j] = -(-np.searchsorted(values, queries[:, j] + reach, side="right") // STRIDE)
    bits = max(1, (m).bit_length())
    bias = (1 << bits) - least
    found_q, found_r = [], []
    step = max(1, (1 << 15) // words)
    for a in range(0, len(queries), step):
        b = min(a + step, len(queries))
        total = [None] * bits
        pending = [[] for _ in range(bits + 1)]
        for j in range(m):
            pending[0].append(upto[j, high[j, a:b]] ^ upto[j, low[j, a:b]])
            k = 0
            while k < bits and len(pending[k]) == 3:
                x, y, z = pending[k]
                half = x ^ y
                pending[k] = [half ^ z]
                pending[k + 1].append((x & y) | (half & z))
                k += 1
        zero = np.zeros((b - a, words), np.uint64)
        carry = []
        for k in range(bits):
            x = pending[k] + carry
            carry = []
            while len(x) > 1:
                p, q, r = x[0], x[1], x[2] if len(x) > 2 else zero
                half = p ^ q
                carry.append((p & q) | (half & r))
                x = [half ^ r, *x[3:]]
            total[k] = x[0] if x else zero
        # count >= least exactly when count + 2^bits - least carries out
        over = zero
        for k in range(bits):
            over = (total[k] | over) if (bias >> k) & 1 else (total[k] & over)
        if bias >> bits:
            over = ~zero
        q, w = np.nonzero(over)
        if len(q):
            flags = np.unpackbits(np.ascontiguousarray(over[q, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, c = np.nonzero(flags)
            r = w[i] * 64 + c
            ok = r < n
            found_q.append(q[i][ok] + a)
            found_r.append(r[ok])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_r)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component under the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return root


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep) of every row, rep null for vectors that cannot link; and (rep, vec, copies, first_id)."""
    vec = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    good = vec.isNotNull() & (F.size(vec) > 0) & (top > 0) & \
        ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, vec).alias("vec"))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = stage_table(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    members = rows.join(reps.select("vec", "rep"), "vec", "left").select("vec_id", "rep")
    return stage_table(members, "vector-members"), reps


def near_links(reps: DataFrame, cosine: float, projections: int, reach: float, recall: float, block_rows: int,
               z_first: float, seed: int) -> DataFrame:
    """(rep, n_links, least): per pair of blocks, links weighted by copies and the smallest linked node."""
    distance = math.sqrt(2 - 2 * cosine)
    least = calibrated(projections, reach, distance, recall)
    gap = z_first * distance

    def project(batches):
        for batch in batches:
            for vecs, ids, copies in _by_length(batch):
                unit = normalised(vecs)
                first = (unit @ directions(vecs.shape[1], projections, seed))[:, 0]
                yield pa.record_batch([ids, copies, pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(first),
                                       pa.array([vecs.shape[1]] * len(unit), pa.int32())],
                                      names=["rep", "copies", "unit", "first", "dim"])

    placed = stage_table(reps.select("rep", "copies", "vec").mapInArrow(
        project, "rep long, copies long, unit binary, first double, dim int"), "vector-projections")
    # blocks of about block_rows consecutive values of the first projection, by one cut value per block
    total = placed.count()
    n_blocks = max(1, -(-total // block_rows))
    cuts = sorted(set(placed.agg(F.percentile_approx("first", [i / n_blocks for i in range(1, n_blocks)],
                                                     10 * n_blocks)).first()[0])) if n_blocks > 1 else []
    sized = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="first", outputCol="block").transform(placed) \
        if cuts else placed.withColumn("block", F.lit(0.0))
    # ties can pile up in a block, so blocks are split again by hash to at most about block_rows
    bounds = stage_table(sized.groupBy("dim", "block").agg(
        F.min("first").alias("low"), F.max("first").alias("high"), F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
        .withColumn("number", F.monotonically_increasing_id()), "vector-blocks")
    paired = stage_table(block_pairs(bounds, gap), "vector-pairs")
    grouped = sized.join(bounds.select("dim", "block", "parts"), ["dim", "block"]) \
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")) \
        .join(paired, ["dim", "block", "part"]).select("x", "y", "side", "rep", "copies", "unit", "dim")

    def count(group):
        dim = group.column("dim")[0].as_py()
        side = group.column("side").to_numpy()
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(side), dim)
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        same = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        values = unit @ directions(dim, projections, seed)
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links = np.zeros(len(side), np.int64)
        root = np.arange(len(side))
        ea, eb = [], []
        for a in range(0, len(left), 2048):
            q, r = window_candidates(values[left[a:a + 2048]], values[right], reach, least) if len(right) else (left[:0], left[:0])
            q, r = left[a:a + 2048][q], right[r]
            if same:
                q, r = q[q < r], r[q < r]
            ok = np.zeros(len(q), bool)
            for c in range(0, len(q), 100_000):
                ok[c:c + 100_000] = np.einsum("ij,ij->i", unit[q[c:c + 100_000]], unit[r[c:c + 100_000]]) >= cosine
            q, r = q[ok], r[ok]
            np.add.at(links, q, copies[r])
            np.add.at(links, r, copies[q])
            new = root[q] != root[r]
            if new.any():
                ea, eb = q[new], r[new]
                merged = forest(root[ea], root[eb], len(side))
                root = merged[root]
        hit = np.flatnonzero(links > 0)
        return pa.table({"rep": pa.array(rep[hit]), "n_links": pa.array(links[hit]), "least": pa.array(rep[root[hit]])})

    return grouped.groupBy("x", "y").applyInArrow(count, "rep long, n_links long, least long")


def block_pairs(bounds: DataFrame, gap: float) -> DataFrame:
    """(dim, block, part, x, y, side): for each pair (x, y) of block parts whose values come within
    ``gap``, a row for x (side 0) and, if it is another, for y (side 1).

    A range join by cells of ``gap``: a block lies in the cells of its values and is looked for in those
    up to ``gap`` further on; each pair is kept in the first cell that both share."""
    parts = bounds.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")) \
        .withColumn("name", F.struct("low", "number", "part"))
    cell = lambda c: F.floor(c / F.lit(gap))
    own = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    near = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") + gap))))
    x = near.select("dim", "cell", *(F.col(c).alias(f"x_{c}") for c in ("low", "high", "block", "part", "name")))
    y = own.select("dim", "cell", *(F.col(c).alias(f"y_{c}") for c in ("low", "high", "block", "part", "name")))
    pairs = x.join(y, ["dim", "cell"]).where(
        (F.col("x_name") <= F.col("y_name")) & (F.col("y_low") - F.col("x_high") <= gap)
        & (F.col("cell") == F.greatest(cell(F.col("x_low")), cell(F.col("y_low")))))
    number = lambda c: F.xxhash64(f"{c}.number", f"{c}.part")
    sides = F.array(F.struct(F.col("x_block").alias("block"), F.col("x_part").alias("part"), F.lit(0).alias("side")),
                    F.struct(F.col("y_block").alias("block"), F.col("y_part").alias("part"), F.lit(1).alias("side")))
    return pairs.select("dim", number("x_name").alias("x"), number("y_name").alias("y"),
                        F.explode(F.when(F.col("x_name") < F.col("y_name"), sides).otherwise(F.slice(sides, 1, 1))).alias("s")) \
        .select("dim", "s.block", "s.part", "x", "y", "s.side")


def _by_length(batch):
    """Vectors of a batch by their length, as matrices."""
    vec = batch.column("vec")
    n = vec.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(n):
        at = pa.array(np.flatnonzero(n == size))
        yield (vec.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size),
               batch.column("rep").take(at), batch.column("copies").take(at))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, projections: int = 24, reach: float = 0.55,
                    recall: float = 0.9999, block_rows: int = 8192, z_first: float = 4.5, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding)."""
    members, reps = distinct_vectors(embeddings)
    found = stage_table(near_links(reps, cosine, projections, reach, recall, block_rows, z_first, seed), "vector-links")
    links = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    roots = components(found.select(node("rep").alias("a"), node("least").alias("b"))) \
        .select(F.col("node.id").alias("rep"), F.col("root.id").alias("root"))
    classes = reps.select("rep", "copies", "first_id").join(links, "rep", "left").join(roots, "rep", "left") \
        .withColumn("root", F.coalesce("root", "rep"))
    classes = stage_table(classes, "vector-roots")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "root").select("rep", "component_id",
                                                 (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = members.join(classes, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
