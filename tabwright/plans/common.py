"""Shared helpers for the catalog: output rounding that is bit-identical in Spark and the SQL
oracle, and type normalisation of outputs.

Rounding is NumPy's rule, half-even on the binary value: ``rint(x * 10^n) / 10^n``. Spark's
``round``/``bround`` round the shortest decimal text instead, which disagrees on exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int = 4) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.rint(col.cast("double") * F.lit(s)) / F.lit(s)


def r4(c: Column | str) -> Column:
    return rnd(c, 4)


def RND(expr: str, digits: int = 4) -> str:
    s = f"{float(10 ** digits)}"
    return f"(round_even(CAST({expr} AS DOUBLE) * {s}, 0) / {s})"


def R4(expr: str) -> str:
    return RND(expr, 4)
