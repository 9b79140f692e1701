"""Exact, reproducible splits and folds.

Randomness is a hash, not ``rand()``: rows are ordered by ``md5('<id>|<seed>')`` (identical text in
Spark and SQL engines) with the id as tie-breaker, then cut at the keys that stand at exact
positions. The key columns are written once; all cuts are found together in a few counting passes
over them (``ranks.cut_keys``, no sort), so a split or fold is a projection of the input.
Results do not depend on partitioning, re-execution or executor loss. An id that repeats at a cut
does not tell rows apart: the table is then written with a row number that breaks the ties, and
sizes stay exact.
Sizes follow the library rules the workload relied on: a hold-out of fraction f takes
``ceil(f * n)`` rows; K folds have ``n // K + 1`` rows for the first ``n % K`` folds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.ranks import cut_keys, order_key, part_of
from tabwright.session import stage


def hash_order(id_col: str, seed: int) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def holdout_sizes(n: int, holdout: float = 0.4, test_of_holdout: float = 0.5) -> tuple[int, int, int]:
    n_hold = math.ceil(holdout * n)
    n_test = math.ceil(test_of_holdout * n_hold)
    return n - n_hold, n_hold - n_test, n_test


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written with a row number, for ids that repeat."""
    row = "__row"
    while row in df.columns:
        row += "_"
    return stage(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _written_keys(df: DataFrame, order: Sequence[str | Column], *others: Column) -> tuple[DataFrame, list[str]]:
    """The order columns as o0, o1, ... (and ``others``), written once."""
    names = [f"o{i}" for i in range(len(order))]
    return stage(df.select(*(c.alias(n) for c, n in zip(_columns(order), names)), *others), "order-keys"), names


def _cut(df: DataFrame, order: Sequence[str | Column], starts: Callable[[int], Sequence[int]]) -> DataFrame:
    """Add ``__part``, the number of each row's part; the parts of n rows begin at ``starts(n)``."""
    keys, names = _written_keys(df, order)
    sizes: dict = {}
    found, tied = cut_keys(keys, names, lambda rows: sizes.update(rows) or {g: starts(n)[1:] for g, n in rows.items()})
    if tied:
        numbered, row = _numbered(df)
        return _cut(numbered, [*order, row], starts).drop(row)
    n = sizes.get(0, 0)
    return df.withColumn("__part", part_of(order, starts(n), n, {p: key for (_, p), key in found.items()}))


def random_split_exact(df: DataFrame, id_col: str, seed: int = 777, holdout: float = 0.4,
                       test_of_holdout: float = 0.5, out: str = "split") -> DataFrame:
    """Exact-size random train/val/test (60/20/20 by default) as a ``split`` column: a
    projection that compares the row's hash with the keys at the two cuts."""
    def starts(n: int) -> list[int]:
        n_train, n_val, _ = holdout_sizes(n, holdout, test_of_holdout)
        return [0, n_train, n_train + n_val]
    part = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), F.col("__part") + 1)
    return _cut(df, [hash_order(id_col, seed), id_col], starts).withColumn(out, part).drop("__part")


def ordered_split(df: DataFrame, order: Sequence[str | Column], id_col: str, frac: float = 0.6,
                  seed: int = 777, test_of_rest: float = 0.5, out: str = "split") -> DataFrame:
    """First ``int(frac * n)`` rows in the ascending ``order`` (negate a number to descend) are
    train; the rest is split at random (hash order) into validation and test, the test part taking
    ``ceil(test_of_rest * rest)``."""
    def cuts(df: DataFrame, ties: Sequence[str]) -> tuple[Column, Column, bool]:
        """Whether a row is late, and in the test part; both orders are cut on the same written keys."""
        keys, names = _written_keys(df, [*order, id_col, *ties])
        sizes: dict = {}
        found, tied = cut_keys(keys, names, lambda rows: sizes.update(rows) or {g: [int(frac * n)] for g, n in rows.items()})
        n = sizes.get(0, 0)
        at = {p: key for (_, p), key in found.items()}
        late = lambda cols: part_of(cols, [0, int(frac * n)], n, at) > 0
        n_rest = n - int(frac * n)
        first = n_rest - math.ceil(test_of_rest * n_rest)
        in_keys = names[len(order):]
        found, tied_rest = cut_keys(keys.where(late(names)), [hash_order(in_keys[0], seed), *in_keys], lambda rows: {g: [first] for g in rows})
        at_rest = {p: key for (_, p), key in found.items()}
        test = part_of([hash_order(id_col, seed), id_col, *ties], [0, first], n_rest, at_rest) > 0
        return late([*order, id_col, *ties]), test, tied or tied_rest

    late, test, tied = cuts(df, [])
    ties = []
    if tied:
        df, row = _numbered(df)
        ties = [row]
        late, test, _ = cuts(df, ties)
    return df.withColumn(out, F.when(~late, "train").when(~test, "val").otherwise("test")).drop(*ties)


def fold_starts(n: int, k: int) -> list[int]:
    """First position of each of ``k`` contiguous folds of ``n`` rows."""
    q, r = divmod(n, k)
    return [i * q + min(i, r) for i in range(k)]


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 777, out: str = "fold") -> DataFrame:
    """T4: shuffled K-fold assignment (as a column, one projection)."""
    cut = _cut(df, [hash_order(id_col, seed), id_col], lambda n: fold_starts(n, k))
    return cut.withColumn(out, F.col("__part").cast("int")).drop("__part")


def stratified_allocation(class_counts: Sequence[tuple], k: int) -> dict:
    """Rows of each class per fold for unshuffled stratified K-fold: the label vector, grouped by
    class in the given class order (that of first appearance), is dealt round-robin into K folds;
    class c gets the count of its positions in each residue class. Returns {class: [rows in fold
    0..k-1]}."""
    def upto(m: int, i: int) -> int:
        return max(0, -(-(m - i) // k))
    out, start = {}, 0
    for c, cnt in class_counts:
        out[c] = [upto(start + cnt, i) - upto(start, i) for i in range(k)]
        start += cnt
    return out


def stratified_folds(df: DataFrame, label: str, order: Sequence[str | Column], k: int = 5,
                     out: str = "fold", max_classes: int = 1000) -> DataFrame:
    """T5: stratified, contiguous folds that keep the ascending ``order`` (a total one) inside each
    class. Classes are dealt in the order of their first row; a row without a label has no fold.
    More than ``max_classes`` classes are an error: such a column is no class label."""
    keys, names = _written_keys(df.where(F.col(label).isNotNull()), order, F.col(label).alias("class"))
    if keys.select("class").distinct().limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    parts: dict = {}

    def starts(rows: dict) -> dict:
        for c, sizes in stratified_allocation(list(rows.items()), k).items():
            parts[c] = ([sum(sizes[:i]) for i in range(k)], sum(sizes))
        return {c: own[1:] for c, (own, _) in parts.items()}

    found, tied = cut_keys(keys, names, starts, by="class")
    if tied:
        numbered, row = _numbered(df)
        return stratified_folds(numbered, label, [*order, row], k, out, max_classes).drop(row)
    fold = F.lit(None).cast("int")
    for c, (own, n) in parts.items():
        at = {p: key for (g, p), key in found.items() if g == c}
        fold = F.when(F.col(label) == F.lit(c), part_of(order, own, n, at)).otherwise(fold)
    return df.withColumn(out, fold.cast("int"))


def split_sizes(df: DataFrame, cols: Sequence[str] = ("scheme", "split")) -> DataFrame:
    """Rows per split."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def best_row(df: DataFrame, score: str, tie: str, maximize: bool = True) -> DataFrame:
    """The best row, earliest ``tie`` on equal scores (a top-1 per partition, then merge)."""
    s = F.col(score).desc_nulls_last() if maximize else F.col(score).asc_nulls_last()
    return df.orderBy(s, F.col(tie).asc()).limit(1)


def head_n(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (``head()`` on an ordered frame)."""
    return df.orderBy(*order).limit(n)
