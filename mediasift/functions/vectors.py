"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-8) -> Column:
    """Divided by its length; as it is if that's below the floor."""
    n = norm(a)
    return F.when(n < floor, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """0 if either has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na < floor) | (nb < floor), 0.0).otherwise(dot(a, b) / (na * nb))


def l2_score(cos: Column) -> Column:
    """1 / (1 + distance of unit vectors with this cosine)."""
    return 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cos)))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def usable(v: Column, dim: int) -> Column:
    """`dim` numbers, none null, NaN or infinite, not all zero; null counts as unusable."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4e38))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
