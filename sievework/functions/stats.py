"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def wilson(hits, n, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share; (0, 0) for no trials."""
    k, n = col(hits).cast("double"), col(n).cast("double")
    p, zz = k / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def dice(both, a, b) -> Column:
    return 2 * col(both) / (col(a) + col(b))


def per_million(n, total) -> Column:
    return 1e6 * col(n) / F.greatest(col(total), F.lit(1))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def hash_share(c, seed: str = "") -> Column:
    """A number in [0, 1) that depends on c and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), col(c).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
