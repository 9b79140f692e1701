"""Exact order statistics by narrowing, without sorting or moving the table.

The key at a 0-based position of a total order is found by counting. One pass counts the rows of
every group and sketches their leading order values (``percentile_approx``); each later pass counts
the rows between edges set around every wanted position, for all positions of all groups at once,
and sketches the stretches between them; the last pass lists the keys of the short stretches that
hold the positions. A pass shortens a stretch about GRID times, so five million rows take three passes and a billion
four, however many positions are wanted; the third writes the rows of the wanted stretches, and later ones
read only those. What reaches the driver is a sketch per stretch and at most about ``limit`` keys. Wide or lossy orders stay exact: a value that fills a stretch is narrowed by
the next order value, and a stretch whose values say no more by a few whole keys at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.ordering import exact_quantiles
from tabwright.session import stage

PROBES = 31
LIMIT = 20_000
GRID = 256
ACCURACY = 4000
FEW = 8  # once the wanted stretches hold so small a part of the rows, later passes read them alone
INF = float("inf")


def order_key(order: Sequence[str | Column]) -> Column:
    """Ascending sort key with nulls last; end it with a unique id to make the order total."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.struct(*[F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"k{i}") for i, c in enumerate(cols)])


def _literal(row, dtype) -> Column:
    return F.struct(*[F.struct(F.lit(part["n"]).alias("n"), F.lit(part["v"]).cast(f.dataType["v"].dataType).alias("v")).alias(f.name)
                      for part, f in zip(row, dtype.fields)])


def _scales(c: Column, dtype: T.DataType) -> tuple[list[Column], bool]:
    """Doubles that never decrease with the value, compared one after the other, with a missing value
    last; and whether equal doubles mean equal values."""
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        c = F.unix_date(c) if isinstance(dtype, T.DateType) else F.unix_micros(c)
        dtype = T.LongType()
    if isinstance(dtype, T.TimestampNTZType):
        c, dtype = c.cast("string"), T.StringType()
    exact = True
    if isinstance(dtype, T.IntegralType):
        x = c.cast("long")
        parts = [x, F.shiftright(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))]  # a double holds 53 bits
    elif isinstance(dtype, T.BooleanType):
        parts = [c.cast("int")]
    elif isinstance(dtype, T.FractionalType):
        x = c.cast("double")
        parts = [F.when(~F.isnan(x), x), F.when(c.isNotNull(), F.isnan(x).cast("int"))]
        exact = not isinstance(dtype, T.DecimalType)
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        raw = F.encode(c, "UTF-8") if isinstance(dtype, T.StringType) else c
        parts = [F.conv(F.rpad(F.hex(F.substring(raw, 1 + 6 * i, 6)), 12, "0"), 16, 10) for i in range(3)]
        exact = False
    else:
        parts, exact = [], False
    return [F.coalesce(p.cast("double"), F.lit(INF)) for p in parts], exact


def _all_scales(kind: T.StructType) -> list[Column]:
    """Scales of the order values up to the first that doubles do not tell apart."""
    out: list[Column] = []
    for f in kind.fields:
        parts, exact = _scales(F.col(f"k.{f.name}.v"), f.dataType["v"].dataType)
        out += parts
        if not exact:
            break
    return out or [F.lit(0.0)]


class _Stretch:
    """Rows of a group between two edges (scales, whether after the rows that equal them)."""

    def __init__(self, low: tuple, high: tuple, below: int, rows: int, sketch: Sequence[float] | None):
        self.low, self.high, self.below, self.rows, self.sketch = low, high, below, rows, sketch or []
        self.level = _level(low, high)
        self.positions: list[int] = []

    def edges(self) -> set[tuple]:
        """Edges before and after the sketched values around the wanted positions."""
        prefix, rest = self.low[0][:self.level], len(self.low[0]) - self.level - 1
        out = set()
        for p in self.positions:
            at = math.floor((p - self.below) / self.rows * GRID)
            for v in self.sketch[max(0, at - 1):at + 3]:
                out |= {((*prefix, v, *(-INF,) * rest), 0), ((*prefix, v, *(INF,) * rest), 1)}
        return out


def _level(low: tuple, high: tuple) -> int:
    """The order value that tells rows between two edges apart; their number if none does."""
    return next((i for i, (x, y) in enumerate(zip(low[0], high[0])) if x != y), len(low[0]))


def _between(edges: list[tuple], depth: int) -> list[tuple[tuple, tuple]]:
    """The edges on both sides of each slot."""
    ends = [((-INF,) * depth, 0), *edges, ((INF,) * depth, 1)]
    return list(zip(ends[:-1], ends[1:]))


def _with_slots(rows: DataFrame, edges: dict, depth: int) -> DataFrame:
    """Add ``slot``, the number of the group's edges before the row, and ``level``. The table of edges
    has a few for each wanted position."""
    table = [(g, [(a[0], a, after) for a, after in own], [_level(*x) for x in _between(own, depth)]) for g, own in edges.items()]
    edge = T.StructType([T.StructField("first", T.DoubleType()), T.StructField("a", T.ArrayType(T.DoubleType())),
                         T.StructField("after", T.IntegerType())])
    table = rows.sparkSession.createDataFrame(table, T.StructType([
        T.StructField("of", rows.schema["g"].dataType), T.StructField("edges", T.ArrayType(edge)),
        T.StructField("levels", T.ArrayType(T.IntegerType()))]))
    # the first scale decides for nearly all rows; whole arrays cost far more to compare
    passed = F.filter("edges", lambda e: (F.col("first") > e["first"]) | (
        (F.col("first") == e["first"]) & ((F.col("ds") > e.a) | ((F.col("ds") == e.a) & (e.after == 0)))))
    return rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("of"))).withColumn("first", F.get("ds", F.lit(0))) \
        .withColumn("slot", F.size(passed)).withColumn("level", F.get("levels", F.col("slot"))).drop("of", "edges", "levels", "first")


def _slots_of(stretches: dict, depth: int) -> tuple[dict, dict]:
    """The edges of each group's stretches, and the stretch of each (group, slot) that is one."""
    edges = {g: sorted({e for x in own for e in (x.low, x.high)}) for g, own in stretches.items() if own}
    slots = {g: {pair: i for i, pair in enumerate(_between(own, depth))} for g, own in edges.items()}
    return edges, {(g, slots[g][x.low, x.high]): x for g, own in stretches.items() for x in own}


def _inside(rows: DataFrame, stretches: dict, depth: int) -> DataFrame:
    """The rows in one of the stretches, with the ``slot`` of ``_slots_of``."""
    edges, here = _slots_of(stretches, depth)
    wanted: dict = {}
    for g, slot in here:
        wanted.setdefault(slot, []).append(g)
    picked = reduce(lambda a, b: a | b, [(F.col("slot") == slot) & reduce(lambda a, b: a | b, [F.col("g").eqNullSafe(F.lit(g)) for g in gs])
                                        for slot, gs in wanted.items()])
    return _with_slots(rows.select("g", "k", "ds"), edges, depth).where(picked).select("g", "k", "ds", "slot")


def cut_keys(df: DataFrame, order: Sequence[str | Column], wanted: Callable[[dict], dict], by: str | None = None,
             limit: int = LIMIT) -> tuple[dict, bool]:
    """Keys at positions of the order inside each ``by`` group: ({(group, position): literal of the
    order key}, whether some position stands between two equal keys).

    ``wanted`` gets {group: rows}, groups by their smallest key, and gives {group: positions}; without
    ``by`` the one group is 0. ``df`` is read about three times, whatever its size, and should be a written table
    of the key columns: a pass that sketches, one that counts, one that lists the wanted stretches or writes them.
    """
    rows = df.select((F.lit(0) if by is None else F.col(by)).alias("g"), order_key(order).alias("k"))
    kind = rows.schema["k"].dataType
    scales = _all_scales(kind)
    depth = len(scales)
    rows = rows.select("g", "k", F.array(*scales).alias("ds"))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def counted(slots: DataFrame, *by: str) -> list:
        value = F.get("ds", F.col("level"))  # null where no level is left
        return slots.groupBy("g", *by).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"),
                                           F.percentile_approx(value, grid, F.lit(ACCURACY)).alias("sketch")).collect()

    groups = counted(rows.withColumn("level", F.lit(0)), "level")
    if len(groups) > 1:  # Spark puts the few smallest keys in order, as it ordered the rows
        firsts = rows.sparkSession.createDataFrame([(i, r["least"]) for i, r in enumerate(groups)],
                                                   T.StructType([T.StructField("i", T.IntegerType()), T.StructField("k", kind)]))
        groups = [groups[r["i"]] for r in firsts.orderBy("k").collect()]
    asked = wanted({r["g"]: r["n"] for r in groups})
    (low, high), = _between([], depth)
    open_: dict = {}
    for r in groups:
        whole = _Stretch(low, high, 0, r["n"], r["sketch"])
        whole.positions = sorted({p for p in asked.get(r["g"], ()) if 0 <= p < r["n"]})
        open_[r["g"]] = [whole] if whole.positions else []
    share = max(1, limit // max(1, sum(len(x.positions) for own in open_.values() for x in own)))
    done: dict = {g: [] for g in open_}
    total = sum(r["n"] for r in groups)
    while True:
        edges = {}
        for g, own in open_.items():
            done[g] += [x for x in own if x.rows <= share or x.level >= depth]
            open_[g] = [x for x in own if x.rows > share and x.level < depth]
            edges[g] = sorted({e for x in open_[g] for e in (x.low, x.high, *x.edges())})
        edges = {g: own for g, own in edges.items() if own}
        if not edges:
            break
        held = sum(x.rows for part in (open_, done) for own in part.values() for x in own)
        if held * FEW <= total:  # the wanted stretches alone are written, for all later passes
            rows = stage(_inside(rows, {g: own + open_.get(g, []) for g, own in done.items()}, depth), "rank-rows")
            total = held
        stats: dict = {}
        for r in counted(_with_slots(rows, edges, depth), "slot"):
            stats.setdefault(r["g"], {})[r["slot"]] = r
        narrowed: dict = {g: [] for g in edges}
        for g, own in edges.items():
            slots = _between(own, depth)
            for whole in open_[g]:
                left, below = list(whole.positions), whole.below
                for slot, (low, high) in enumerate(slots):
                    r = stats[g].get(slot) if whole.low <= low and high <= whole.high else None
                    if r is not None:
                        x = _Stretch(low, high, below, r["n"], r["sketch"])
                        x.positions = [p for p in left if below <= p < below + r["n"]]
                        narrowed[g] += [x] if x.positions else []
                        below += r["n"]
        open_ = narrowed
    out: dict = {}
    ties = False
    for g, p, key, tied in _listed(rows, done, kind, share, depth):
        out[g, p] = _literal(key, kind)
        ties = ties or tied
    return out, ties


def _listed(rows: DataFrame, done: dict, kind, share: int, depth: int):
    """(group, position, key, whether the key before is equal): short stretches by their keys in one
    pass, long ones, whose scales all agree, by a few keys at a time."""
    short = {g: [x for x in own if x.rows <= share] for g, own in done.items()}
    here = _slots_of(short, depth)[1]
    if here:
        keys: dict = {}
        # sorted in one task: `limit` keys about, and no second pass to find ranges
        for r in _inside(rows, short, depth).repartition(1).sortWithinPartitions("k").collect():
            keys.setdefault((r["g"], r["slot"]), []).append(r["k"])
        for (g, slot), x in here.items():
            own = keys[g, slot]
            for p in x.positions:
                i = p - x.below
                yield g, p, own[i], i > 0 and own[i] == own[i - 1]
    for g, own in done.items():
        for x in own:
            if x.rows > share:
                same = rows.where(F.col("g").eqNullSafe(F.lit(g)) & (F.col("ds") == F.array(*map(F.lit, x.low[0]))))
                for p, (key, tied) in _narrowed(same.select("k"), [p - x.below for p in x.positions], kind, share).items():
                    yield g, p + x.below, key, tied


def _narrowed(keyed: DataFrame, positions: Sequence[int], dtype, limit: int) -> dict:
    """{position: (key, tied)} of rows whose scales agree: counts up to a few probe keys, until the
    interval's keys are few enough to list or all equal."""
    k = F.col("k")
    # position -> (low, high, rows up to low, rows in the interval); None is open
    open_ = {p: (None, None, 0, None) for p in positions}
    found: dict = {}

    def inside(low, high):
        cond = F.lit(True)
        if low is not None:
            cond = cond & (k > _literal(low, dtype))
        if high is not None:
            cond = cond & (k <= _literal(high, dtype))
        return cond

    while open_:
        spans = {}
        for p, (low, high, below, size) in open_.items():
            spans.setdefault((low, high, below, size), []).append(p)
        open_ = {}
        for (low, high, below, size), wanted in spans.items():
            here = keyed.where(inside(low, high))
            if size is not None and size <= limit:
                keys = [r["k"] for r in here.orderBy("k").collect()]
                found.update({p: (keys[p - below], p > below and keys[p - below] == keys[p - below - 1]) for p in wanted})
                continue
            probes = sorted({r["k"] for r in here.orderBy(F.xxhash64("k"), "k").limit(PROBES).collect()})
            counts = here.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(k <= _literal(x, dtype)).alias(f"c{i}")
                                                              for i, x in enumerate(probes))).first()
            edges = [(low, below), *((x, below + counts[f"c{i}"]) for i, x in enumerate(probes)), (high, below + counts["n"])]
            for p in wanted:
                i = next(i for i in range(1, len(edges)) if p < edges[i][1])
                open_[p] = (edges[i - 1][0], edges[i][0], edges[i - 1][1], edges[i][1] - edges[i - 1][1])
                if edges[i - 1][0] == low and edges[i][0] == high and edges[i][1] - edges[i - 1][1] == size:
                    # all keys equal: the order is not total here
                    found[p] = (probes[0], p > below)
                    del open_[p]
    return found


def keys_at(df: DataFrame, order: Sequence[str | Column], positions: Sequence[int], limit: int = LIMIT) -> dict[int, Column]:
    """Literal of the order key at each position (0 <= position < rows)."""
    found, _ = cut_keys(df, order, lambda sizes: {0: positions}, limit=limit)
    return {p: key for (_, p), key in found.items()}


def part_of(order: Sequence[str | Column], starts: Sequence[int], n: int, cuts: dict[int, Column]) -> Column:
    """Number of the part that a row is in, when ``n`` rows are cut into parts that begin at the
    ascending positions ``starts`` (the first is 0; equal starts are empty parts)."""
    part = F.lit(0)
    for s in starts[1:]:
        if s < n:
            part = part + (order_key(order) >= cuts[s]).cast("int")
    return part


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], limit: int = LIMIT) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between closest ranks, missing values left out) of numeric columns, on the
    driver: one short list per column. All columns share each pass over their written values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")).select("s.*")
    names = [f"q{i}" for i in range(len(qs))]
    found = {r["c"]: [r[n] for n in names] for r in exact_quantiles(long, "v", qs, by=["c"], names=names, limit=limit).collect()}
    return {c: found.get(c, [None] * len(qs)) for c in cols}
