"""Sharding by histogram sort: equal bytes per shard from counted key boundaries.

Rows are ordered by a hash of the text, then doc_id, then a row number, so equal texts lie
together. The first pass counts rows and bytes below PROBES even boundaries of the hash; each later
pass puts new boundaries only into the intervals that still matter: those that hold a shard
splitter and more bytes than the tolerance, and those far heavier than an even interval. An interval
of a single hash (a large group of equal texts) is split by doc_id, then by row number. The driver
sees boundary counts only, however many rows there are: a pass adds at most PASS_STEPS (or two per
shard) for the splitters and as many for the tasks' sake, these at most LEAVES in all. Rows move
once: each interval is one group, sorted inside, and the counts give the slot at which it begins.

Cases: a null text has no bytes and crc 0, and a null doc_id sorts first; repeated rows are told
apart by the row number; empty tables yield no rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import stage_table

PROBES = 4096
PASS_STEPS = 4 * PROBES
LEAVES = 16 * PROBES
TOP = (1 << 63) - 1  # 2^63 / PROBES is 2^51
KEYS = ("key", "id", "uid")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, id, uid), written once so that row numbers stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-TOP - 1)).alias("id"), F.monotonically_increasing_id().alias("uid"))
    return stage_table(rows, "shard-sizes")


def shard_by_bytes(docs: DataFrame, shards: int, tolerance: float = 0.001, task_share: float = 4 / PROBES,
                   least_rows: int = 512, group_share: float = 0.05) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of equal bytes, to ``tolerance`` of a shard or
    one row. Rows of equal texts share a shard if they have at most ``group_share`` of its bytes. An
    interval with more than ``task_share`` of all rows or bytes is split for the tasks' sake, the
    heaviest first while LEAVES has room for a pass, unless it has at most ``least_rows`` rows."""
    rows = sized(docs)
    spark = docs.sparkSession
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total.bytes / shards
    at, leaves, whole = intervals(rows, total.n, total.bytes, shards, tolerance, task_share, least_rows, group_share)
    out, below, shard, slot = [], 0, 0, 0
    unit = lambda path: next((path[:i] for i in range(len(path) + 1) if path[:i] in whole), path)
    for _, paths in groupby(sorted(leaves), key=unit):
        paths = list(paths)
        size = sum(leaves[path][1] for path in paths)
        mine = min(shards - 1, int((below + size / 2) / target))
        if mine != shard:
            shard, slot = mine, 0
        for path in paths:
            out.append((_name(path), shard, slot))
            slot += leaves[path][0]
        below += size
    # as many rows as intervals, whose number the module's bound holds
    place = spark.createDataFrame(out, "path string, shard int, first long")
    inside = Window.partitionBy("path").orderBy(*KEYS)
    return at.join(F.broadcast(place), "path") \
        .withColumn("slot", F.col("first") + F.row_number().over(inside) - 1) \
        .select("doc_id", "size", "text_crc32", "shard", "slot")


def intervals(rows: DataFrame, n_all: int, bytes_all: int, shards: int, tolerance: float, task_share: float,
              least_rows: int, group_share: float) -> tuple[DataFrame, dict[tuple, tuple[int, int]], set[tuple]]:
    """Rows with the ``path`` of their interval, (rows, bytes) of each path, and the paths of groups of
    equal texts that stay in one shard."""
    spark = rows.sparkSession
    target = bytes_all / shards
    # leaves: path -> (rows, bytes); a node is refined by its key from `low` in steps of `width`
    leaves: dict[tuple, tuple[int, int]] = {}
    own = {}
    nodes = [((), 0, 0, TOP, PROBES)]  # path, key number, low, high, steps
    whole: set[tuple] = set()
    at = rows.withColumn("path", F.lpad(F.shiftrightunsigned("key", 51).cast("int"), 4, "0")).withColumn("fresh", F.lit(True))
    while nodes:
        if leaves:
            plan = [(_name(path), level, Decimal(low), Decimal(_width(low, high, steps))) for path, level, low, high, steps in nodes]
            # at most PASS_STEPS / 2 + shards intervals are refined at once
            probe = spark.createDataFrame(plan, "path string, level int, low decimal(20,0), width decimal(20,0)")
            value = F.expr("case level when 0 then key when 1 then id else uid end").cast("decimal(20,0)")
            step = F.floor((value - F.col("low")) / F.col("width")).cast("int")
            at = at.join(F.broadcast(probe), "path", "left").withColumn("fresh", F.col("level").isNotNull()) \
                .withColumn("path", F.when(F.col("fresh"), F.concat_ws(".", "path", F.lpad(step, 4, "0"))).otherwise(F.col("path"))) \
                .drop("level", "low", "width")
        stats = at.where("fresh").groupBy("path").agg(
            F.count("*").alias("n"), F.sum("size").alias("bytes"), *(f(k).alias(f"{f.__name__}_{k}") for k in KEYS
                                                                     for f in (F.min, F.max))).collect()
        at = at.drop("fresh")
        for path, *_ in nodes:
            leaves.pop(path, None)
            own.pop(path, None)
        for r in stats:
            path = tuple(r.path.split("."))
            leaves[path] = (r.n, r.bytes)
            own[path] = r
        split, eased, below = [], [], 0
        for path in sorted(leaves):
            n, size = leaves[path]
            splitter = int(below / target) + 1
            cuts = splitter < shards and splitter * target < below + size
            share = max(size / bytes_all, n / n_all)
            r = own[path]
            if r.min_key == r.max_key and size <= group_share * target \
                    and not any(path[:i] in whole for i in range(len(path))):
                whole.add(path)
            kept = any(path[:i] in whole for i in range(len(path) + 1))
            if n > 1 and cuts and not kept and size > tolerance * target:
                split.append((path, PROBES))
            elif n > least_rows and share > task_share:
                eased.append((share, path, max(16, 2 * n // max(least_rows, 1))))
            below += size
        room = PASS_STEPS if len(leaves) <= LEAVES - PASS_STEPS else 0
        eased = [(path, steps) for _, path, steps in sorted(eased, reverse=True)[:room // 2]]
        nodes = []
        for some, budget in ((split, PASS_STEPS), (eased, room)):
            for path, steps in some:
                r = own[path]
                level = next((i for i, k in enumerate(KEYS) if r[f"min_{k}"] < r[f"max_{k}"]), None)
                if level is not None:
                    k = KEYS[level]
                    nodes.append((path, level, r[f"min_{k}"], r[f"max_{k}"], max(2, min(PROBES, steps, budget // len(some)))))
    return at, leaves, whole


def _width(low: int, high: int, steps: int) -> int:
    return -(-(high - low + 1) // steps)


def _name(path: tuple) -> str:
    return ".".join(path)
