"""Column predicates and guarded arithmetic used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPSILON = 2.220446049250313e-16  # of a double


def covered(v: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(v: Column) -> Column:
    """Six decimals, for results that are compared across engines."""
    return F.round(v.cast("double"), 6)


def bins_below(edges: Column, x: Column) -> Column:
    """Number of edges strictly below x: the left-sided insertion place."""
    return F.size(F.filter(edges, lambda e: e < x))


def rounded(c: Column, digits: int) -> Column:
    """F.round of doubles, by way of decimals only where a tie is near, a value is large or not finite."""
    q = c * 10.0**digits
    plain = (F.abs(q) < 1e10) & (F.abs(q - F.rint(q)) < 0.4999)
    return F.when(plain, F.rint(q) / 10.0**digits + 0.0).otherwise(F.round(c, digits))
