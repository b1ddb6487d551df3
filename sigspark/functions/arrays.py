"""Column builders over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    A lambda re-evaluates outer expressions for every element, which would turn a median inside a ``transform`` into
    quadratic work; binding it through a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def uniform_position(i: Column, n: Column | int, k: Column | int) -> Column:
    """Index of the i-th of ``k`` evenly spaced picks out of ``n``; the last one is always ``n - 1``.

    The arithmetic is in doubles on purpose: truncation after a floating-point product differs from integer division
    for some (n, k).
    """
    n = F.lit(n) if isinstance(n, int) else n
    k = F.lit(k) if isinstance(k, int) else k
    step = (n - 1).cast("double") / (k - 1).cast("double")
    return F.when(i >= k - 1, (n - 1).cast("long")).otherwise(F.floor(i.cast("double") * step))


def sum_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(a: Column) -> Column:
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda v: v / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def softmax(logits: Column) -> Column:
    shifted = let(F.array_max(logits), lambda m: F.transform(logits, lambda v: F.exp(v - m)))
    return let(shifted, lambda e: let(sum_of(e), lambda s: F.transform(e, lambda v: v / s)))


def argmax(x: Column) -> Column:
    """Position of the largest value, the lowest one on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
