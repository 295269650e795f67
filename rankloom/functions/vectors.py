"""Arithmetic on ``array<double>`` columns, all inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_NORM_EPS = 1e-5


def _zero() -> Column:
    return F.lit(0.0)


def total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda acc, x: acc + x * x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    Without it an expression used inside a lambda is evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def scale(v: Column, factor) -> Column:
    if not isinstance(factor, Column):
        return F.transform(v, lambda x: x * F.lit(float(factor)))
    pair = F.struct(v.alias("v"), factor.alias("f"))
    return bound(pair, lambda s: F.transform(s["v"], lambda x: x * s["f"]))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(v)
    divisor = F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0))
    pair = F.struct(v.alias("v"), divisor.alias("n"))
    return bound(pair, lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def layer_norm(v: Column, eps: float = LAYER_NORM_EPS) -> Column:
    """Centre a vector and divide by its population deviation."""

    def centred(s: Column) -> Column:
        return F.transform(s["v"], lambda x: x - s["m"])

    def divided(c: Column) -> Column:
        deviation = F.sqrt(dot(c, c) / F.size(c) + F.lit(eps))
        return scale(c, 1.0 / deviation)

    pair = F.struct(v.alias("v"), (total(v) / F.size(v)).alias("m"))
    return bound(bound(pair, centred), divided)


def weighted_columns(pairs: list[tuple[Column, Column]]) -> Column:
    """Sum of ``weight * vector`` over a fixed list of columns."""
    out = None
    for vector, weight in pairs:
        part = scale(vector, weight)
        out = part if out is None else add(out, part)
    return out


def sum_columns(vector: str, dim: int, weight: Column | None = None) -> list[Column]:
    """One ``sum`` per dimension, so vectors are reduced before any shuffle."""
    out = []
    for i in range(dim):
        x = F.get(F.col(vector), F.lit(i)).cast("double")
        out.append(F.sum(x * weight if weight is not None else x).alias(f"_d{i}"))
    return out


def gather_columns(dim: int) -> Column:
    """Rebuild the vector from the per-dimension columns of ``sum_columns``."""
    return F.array(*[F.col(f"_d{i}") for i in range(dim)])
