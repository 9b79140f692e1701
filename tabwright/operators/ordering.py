"""Order-dependent building blocks that stay distributed and skew-proof.

* ``global_row_index`` — 0-based position in a total order, without a partition-less window:
  range-partition + sort within partitions, checkpoint (so both passes see the same partitions),
  one count per partition to a bounded table, prefix offsets, ``offset + row-in-partition``.
* ``group_row_index`` — position inside a group and the group size. A hot group (a third of all
  rows) is spread over many range partitions instead of landing in one window task.
* ``exact_quantiles`` — linear-interpolated quantiles (pandas / ``quantile_cont`` rule) of all groups by
  narrowing a table of intervals; no sort, and nothing holds a whole group in memory.
* ``neighbours`` — sequence number and the previous values of each row inside its group: local windows
  on range partitions, completed by what the partitions before hold at their ends.
* ``running_agg`` — running max/min/sum inside a group over a total order: local running values
  per range partition, then a carry-in from earlier partitions of the same group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import materialize, stage

_LOW33 = (1 << 33) - 1


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_row_index(df: DataFrame, order: Sequence[str | Column], out: str = "row_idx",
                     num_partitions: int | None = None) -> DataFrame:
    """Attach a 0-based ``out`` index in the total order ``order`` (make it total: id last)."""
    cols = _order_cols(order)
    ranged = df.repartitionByRange(_num_partitions(df, num_partitions), *cols).sortWithinPartitions(*cols)
    ranged = materialize(ranged)
    tagged = ranged.select("*", F.spark_partition_id().alias("__pid"),
                           F.monotonically_increasing_id().alias("__mid"))
    # One count per partition (bounded by the partition count) reaches the driver; the prefix
    # offsets go back into the plan as a literal array indexed by partition id.
    counts = dict(tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).collect())
    n_parts = ranged.rdd.getNumPartitions()
    offsets, acc = [], 0
    for p in range(n_parts):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__pid") + 1)
    return (tagged.withColumn(out, off + F.col("__mid").bitwiseAND(F.lit(_LOW33)))
            .drop("__mid"))


def _null_safe_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        raise ValueError("join keys required")
    ren = {k: f"__g_{k}" for k in keys}
    s = small.withColumnsRenamed(ren)
    cond = None
    for k in keys:
        c = big[k].eqNullSafe(s[ren[k]])
        cond = c if cond is None else cond & c
    return big.join(s, cond, "inner").drop(*ren.values())


def group_row_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
                    out: str = "row_in_group", size_col: str | None = "group_size",
                    num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its ``by`` group (ordered by ``order``) and the group
    size. Null group keys form their own group (callers null out what they need)."""
    idx = global_row_index(df, [*by, *order], out="__gidx", num_partitions=num_partitions)
    aggs = [F.min("__gidx").alias("__start")]
    if size_col:
        aggs.append(F.count(F.lit(1)).alias(size_col))
    if by:
        starts = idx.groupBy(*by).agg(*aggs)
        joined = _null_safe_join(idx, starts, by)
    else:
        # One-row table of scalars: a literal, not a join.
        row = idx.agg(*aggs).first()
        joined = idx.withColumn("__start", F.lit(row["__start"]))
        if size_col:
            joined = joined.withColumn(size_col, F.lit(row[size_col]).cast("long"))
    return (joined.withColumn(out, F.col("__gidx") - F.col("__start"))
            .drop("__gidx", "__start", "__pid"))


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int,
                    salt_col: str | Column, salt_buckets: int = 256, out: str = "rank") -> DataFrame:
    """Exact ``k`` first rows per group in ``order`` without one task per group: rows are first
    ranked inside (group, salt bucket) and cut at ``k`` (a hot group is spread over
    ``salt_buckets`` tasks), then the at most ``salt_buckets * k`` survivors of each group are
    ranked again. The global k first rows of a group are among the k first of their bucket, so
    the result is exact."""
    salt = (F.col(salt_col) if isinstance(salt_col, str) else salt_col)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*by, "__salt").orderBy(*_order_cols(order))
    first = salted.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k).drop("__r1", "__salt")
    w2 = Window.partitionBy(*by).orderBy(*_order_cols(order))
    return first.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, limit: int = 20_000, bins: int = 1024,
                    written: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation between closest ranks; nulls ignored.
    Returns one row per group: ``by`` columns plus one column per quantile.

    The (group, value) pairs are written once, unless ``df`` is a ``written`` table already. A table of intervals, a few per group, is narrowed in
    Spark: a pass counts the rows of all open intervals of all groups in ``bins`` equal steps, and
    the step that holds a wanted rank, tightened to its least and greatest value, is the next
    interval. A group with at most ``limit`` rows needs no pass, and a hot group's rows are counted
    where they are. Intervals of one value end there, the short ones by a sorted list."""
    names = list(names) if names is not None else [f"q{int(round(q * 100)):02d}" for q in qs]
    keys = [f"g{i}" for i in range(len(by) or 1)]
    groups = [F.col(c) for c in by] or [F.lit(0)]
    vals = df.select(*(c.alias(k) for c, k in zip(groups, keys)), F.col(value).cast("double").alias("v")) \
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    vals = vals if written else stage(vals, "quantile-values")
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    wanted = F.array_sort(F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))
    sizes = stage(vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-groups")
    state = sizes.select(*keys, F.lit(0).cast("long").alias("below"), "lo", "hi", "n", wanted.alias("ranks"))
    open_ = (F.col("n") > limit) & (F.col("lo") < F.col("hi"))
    ended = []
    while True:
        ended.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        inside = _null_safe_join(vals, state, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves, so that bounds of any size do not overflow
        step = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / ((F.col("hi") / 2 - F.col("lo") / 2) / bins)), F.lit(bins - 1))
        steps = inside.groupBy(*keys, "below", step.alias("step")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("ranks").alias("ranks"))
        before = Window.partitionBy(*keys, "below").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # `bins` rows
        start = F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0))
        held = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
        state = stage(steps.withColumn("start", start).withColumn("ranks", held).where(F.size("ranks") > 0)
                      .select(*keys, F.col("start").alias("below"), "lo", "hi", "n", "ranks"), "quantile-intervals")
    ended = reduce(DataFrame.unionByName, ended)
    rank = F.explode("ranks").alias("rank")
    one = ended.where("lo = hi").select(*keys, rank, F.col("lo").alias("v"))
    short = ended.where("lo < hi")
    lists = _null_safe_join(vals, short, keys).where(F.col("v").between(F.col("lo"), F.col("hi"))) \
        .groupBy(*keys, "below").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("ranks").alias("ranks"))
    listed = lists.select(*keys, "below", "vs", rank).select(*keys, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    found = _null_safe_join(one.unionByName(listed), sizes.select(*keys, "n"), keys)
    aggs = []
    for x, nm in zip(at, names):
        lo = F.max(F.when(F.col("rank") == F.floor(x), F.col("v")))
        hi = F.max(F.when(F.col("rank") == F.ceil(x), F.col("v")))
        aggs.append((lo + (hi - lo) * F.max(x - F.floor(x))).alias(nm))
    out = found.groupBy(*keys).agg(*aggs)
    if not by:
        return found.agg(*aggs)
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), *names)


def neighbours(df: DataFrame, key: str, order: Sequence[str | Column], value: str | None = None, lags: int = 0,
               seq: str = "seq", num_partitions: int | None = None) -> tuple[DataFrame, list[str]]:
    """Add ``seq``, the 1-based ordinal inside ``key`` in ``order``, and the ``lags`` previous values of
    ``value`` (columns whose names are returned, the nearest first). Null keys are a group.

    Rows are range-partitioned by (key, order) and written with their partition's number, so a hot
    key lies in many partitions. Windows work inside (partition, key). Only keys that two partitions
    share need more: a table of at most two keys per partition carries the rows before each
    partition and its last ``lags`` values, and is joined to the rows of those keys."""
    own = {f"__o{i}": c for i, c in enumerate(order) if not isinstance(c, str)}  # orders by expression are written too
    sort = [c if isinstance(c, str) else f"__o{i}" for i, c in enumerate(order)]
    ordered = [F.col(c).asc_nulls_last() for c in (key, *sort)]
    ranged = stage(df.withColumns(own).repartitionByRange(_num_partitions(df, num_partitions), *ordered)
                   .withColumn("__pid", F.spark_partition_id()), "ranged")
    local = Window.partitionBy("__pid", key).orderBy(*ordered[1:])
    names = [f"__lag{j}" for j in range(1, lags + 1)]
    rows = ranged.withColumn("__n", F.row_number().over(local)) \
        .withColumns({nm: F.lag(value, j).over(local) for j, nm in enumerate(names, 1)})
    carry = _carried(ranged, key, sort, value, lags)
    joined = rows.join(F.broadcast(carry), (F.col("__pid") == F.col("__cpid")) & F.col(key).eqNullSafe(F.col("__ckey")), "left")
    # the j-th value before a row is its partition's own, or the carried one that many places further
    full = {nm: F.when(F.col("__n") > j, F.col(nm)).otherwise(F.get("__values", (F.lit(j) - F.col("__n")).cast("int")))
            for j, nm in enumerate(names, 1)}
    out = joined.withColumns({seq: (F.col("__n") + F.coalesce("__rows", F.lit(0))).cast("int"), **full})
    return out.drop("__n", "__pid", "__cpid", "__ckey", "__rows", "__values", *own), names


def _carried(ranged: DataFrame, key: str, sort: Sequence[str], value: str | None, lags: int) -> DataFrame:
    """(__cpid, __ckey, __rows, __values) for each key that an earlier partition holds too: its rows
    there, and the last values, the nearest first. At most two rows per partition."""
    kept = ranged.select(F.col("__pid").alias("__cpid"), F.col(key).alias("__ckey"), *sort, *([F.col(value).alias("__v")] if lags else []))
    whole = F.struct(F.col("__ckey").isNull().alias("last"), "__ckey")  # nulls last, as the ranges are
    ends = kept.groupBy("__cpid").agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
    shared = ends.select("__cpid", F.explode(F.array_distinct(F.array("a", "b"))).alias("k")) \
        .groupBy("k").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("k.__ckey").alias("__skey"))
    own = kept.join(F.broadcast(shared), F.col("__ckey").eqNullSafe(F.col("__skey"))).drop("__skey")
    counts = own.groupBy("__cpid", "__ckey").agg(F.count(F.lit(1)).alias("__own"))
    before = Window.partitionBy("__ckey").orderBy("__cpid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = counts.withColumn("__rows", F.coalesce(F.sum("__own").over(before), F.lit(0))).drop("__own")
    if not lags:
        return totals.withColumn("__values", F.lit(None).cast("array<string>"))
    last = Window.partitionBy("__cpid", "__ckey").orderBy(*(F.col(c).desc_nulls_first() for c in sort))
    tails = own.select("__cpid", "__ckey", "__v", F.row_number().over(last).alias("__r")).where(F.col("__r") <= lags)
    # nearest first: partitions from the last to the first, in each the last row first
    of_key = tails.groupBy("__ckey").agg(F.collect_list(F.struct((-F.col("__cpid")).alias("p"), F.col("__r").alias("r"), F.col("__v").alias("v"))).alias("__all"))
    of_key = of_key.select(F.col("__ckey").alias("__tkey"), F.array_sort("__all", lambda x, y: F.when(x.p != y.p, F.when(x.p < y.p, -1).otherwise(1))
                                                                      .otherwise(x.r - y.r)).alias("__all"))
    earlier = F.filter("__all", lambda x: -x.p < F.col("__cpid"))
    return totals.join(of_key, F.col("__ckey").eqNullSafe(F.col("__tkey"))) \
        .select("__cpid", "__ckey", "__rows", F.transform(F.slice(earlier, 1, lags), lambda x: x.v).alias("__values"))


def running_agg(df: DataFrame, order: Sequence[str | Column], value: str, fn: str = "max",
                by: Sequence[str] = (), out: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Running ``fn`` (max/min/sum) of ``value`` over ``order`` inside ``by`` groups, frame
    ``unbounded preceding .. current row``."""
    out = out or f"running_{fn}"
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[fn]
    comb = {"max": F.greatest, "min": F.least, "sum": lambda a, b: a + b}[fn]
    idx = global_row_index(df, [*by, *order], out="__gidx", num_partitions=num_partitions)
    part = ["__pid", *by]
    w_local = Window.partitionBy(*part).orderBy("__gidx").rowsBetween(Window.unboundedPreceding, 0)
    local = idx.withColumn("__local", agg(value).over(w_local))
    # One row per (partition, group): a hot group has at most one row per partition.
    totals = idx.groupBy(*part).agg(agg(value).alias("__tot"))
    if by:
        w_carry = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumn("__carry", agg("__tot").over(w_carry)).drop("__tot")
        joined = _null_safe_join(local, carry, part)
    else:
        # one total per partition (bounded): carry-ins computed on the driver, back as a literal
        tot = dict((r["__pid"], r["__tot"]) for r in totals.collect())
        carries, acc = [], None
        pyagg = {"max": max, "min": min, "sum": lambda a, b: a + b}[fn]
        for p in range(max(tot) + 1 if tot else 0):
            carries.append(acc)
            if tot.get(p) is not None:
                acc = tot[p] if acc is None else pyagg(acc, tot[p])
        arr = F.array(*[F.lit(c) for c in carries]) if carries else F.array()
        joined = local.withColumn("__carry", F.element_at(arr.cast(f"array<{dict(idx.dtypes)[value]}>"),
                                                          F.col("__pid") + 1))
    if fn == "sum":
        # null only while no value has been seen: a partition may begin with nulls
        res = F.when(F.col("__local").isNotNull() | F.col("__carry").isNotNull(),
                     F.coalesce(F.col("__local"), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0)))
    else:
        res = F.coalesce(comb(F.col("__local"), F.col("__carry")), F.col("__local"), F.col("__carry"))
    return joined.withColumn(out, res).drop("__local", "__carry", "__pid", "__gidx")
