"""Expressions on ARRAY<DOUBLE> vectors, kept on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width an array expression is written out per element, so that it
# stays inside whole-stage codegen; wider vectors use higher-order functions.
UNROLL_WIDTH = 64


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def squared_norm(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda s, v: s + v * v)


def norm(x: Column | str) -> Column:
    return F.sqrt(squared_norm(x))


def squared_distance(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )


def all_finite(x: Column | str) -> Column:
    return F.forall(_col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def clip(x: Column | str, bound: float) -> Column:
    return F.transform(_col(x), lambda v: F.greatest(F.lit(-bound), F.least(F.lit(bound), v)))


def scale(x: Column | str, factor: Column) -> Column:
    return F.transform(_col(x), lambda v: v * factor)


def shift_scale(x: Column | str, centre: Sequence[float], spread: Sequence[float]) -> Column:
    """(x - centre) / spread, element by element."""
    x = _col(x)
    if len(centre) <= UNROLL_WIDTH:
        return F.array(*[(x[i] - float(c)) / float(s) for i, (c, s) in enumerate(zip(centre, spread))])
    c, s = literal_vector(centre), literal_vector(spread)
    return F.transform(x, lambda v, i: (v - F.get(c, i)) / F.get(s, i))


def multiply(x: Column | str, weights: Sequence[float]) -> Column:
    x = _col(x)
    if len(weights) <= UNROLL_WIDTH:
        return F.array(*[x[i] * float(w) for i, w in enumerate(weights)])
    w = literal_vector(weights)
    return F.transform(x, lambda v, i: v * F.get(w, i))


def take_components(x: Column | str, components: Sequence[int]) -> Column:
    """Keep the listed components, e.g. (0, 1) of a force vector."""
    x = _col(x)
    return F.array(*[F.get(x, F.lit(int(i))) for i in components])


def append_vector(x: Column | str, y: Column | str) -> Column:
    return F.concat(_col(x), _col(y))


def abs_max(x: Column | str) -> Column:
    """Largest finite or infinite magnitude, NaN ignored."""
    return F.array_max(F.filter(F.transform(_col(x), F.abs), lambda v: ~F.isnan(v)))
