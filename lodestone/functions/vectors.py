"""Vector expressions over ``array<float>`` columns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    # The length is a lambda's argument, so it isn't computed again for every element.
    scaled = lambda length: F.when(length > 0, F.transform(_doubles(v), lambda x: x / length)).otherwise(_doubles(v))
    return F.transform(F.array(norm(v)), scaled)[0]


def rounded(x: Column, digits: int) -> Column:
    """``x`` to some places, half a place away from zero; the sign stays, also of a zero."""
    scale = F.lit(10.0**digits)
    near = lambda y: F.round(y * scale, 0) / scale
    return F.when(x < 0, -near(-x)).when(x > 0, near(x)).otherwise(x)


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def similarity_to_distance(similarity: Column) -> Column:
    """Distance of unit vectors with this inner product."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - similarity)))


def valid(v: Column, dimension: int | None = None, largest: int = 4096) -> Column:
    """Not empty, not longer than ``largest``, and of ``dimension`` if given."""
    size = F.coalesce(F.size(v), F.lit(0))
    return (size > 0) & (size <= largest) & ((size == dimension) if dimension else F.lit(True))


def usable(v: Column, width: int) -> Column:
    """Whether a vector has ``width`` finite numbers, not all of them zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == width) & ~odd & F.exists(v, lambda x: x != 0)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Smaller is nearer in every metric; vectors of unequal length are float's largest value apart."""
    value = {"l2": lambda: F.sqrt(squared_distance(a, b)), "inner_product": lambda: -dot(a, b), "cosine": lambda: 1 - dot(a, b)}[metric]()
    return F.when(F.size(a) != F.size(b), F.lit(3.4028234663852886e38)).otherwise(value)
