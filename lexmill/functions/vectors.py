"""Vector expressions; elements are summed as doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b) + epsilon), F.lit(0.0))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once, however often ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let(F.struct(_d(v).alias("v"), norm(v).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))


def hash_embed(text: Column, dimension: int = 384) -> Column:
    """Deterministic unit vector: bytes of the text's SHA-256, cycled, scaled to -1..1."""
    byte = lambda h, i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1
    values = let(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(h, i)))
    raw = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.get(v, i % 32)))
    return l2_normalize(raw)


def checked(v: Column, dimension: int) -> Column:
    """The vector, or an error if its dimension is another."""
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "), F.size(v))))
