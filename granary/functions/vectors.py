"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col

FLOOR = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    size = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: x.cast("double") / F.greatest(size, F.lit(FLOOR)))


def softmax(v: Column | str) -> Column:
    top = F.array_max(col(v))
    powers = F.transform(col(v), lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def argmax(v: Column | str) -> Column:
    """Zero-based place of the first largest value."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def wide(v: Column | str, names: list[str]) -> list[Column]:
    """One column per component, for flat files."""
    return [col(v)[i].alias(n) for i, n in enumerate(names)]
