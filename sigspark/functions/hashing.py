"""Seeded, engine-independent pseudo-random order and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *parts: str | Column) -> Column:
    """SHA-256 of the seed and the parts joined with a pipe; strings are literals, columns are values."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def hash_int(seed: int, *parts: str | Column) -> Column:
    """The first 32 bits of the digest as a non-negative integer."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long")


def hash_below(bound: Column, seed: int, *parts: str | Column) -> Column:
    """Pseudo-random integer in [0, bound)."""
    return hash_int(seed, *parts) % bound


def uniform(seed: int, *parts: str | Column) -> Column:
    """Pseudo-random double in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(4294967296.0)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 32-bit integers; every product stays below 2^63, so SQL engines with signed 64-bit integers agree."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x045D9F3B)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFF
    return x ^ (x >> 16)


def counter_uniforms(first: int, second: int, counters: np.ndarray) -> np.ndarray:
    """Pseudo-random doubles in (0, 1), one per counter, of the stream that two 32-bit keys name."""
    mixed = _mix(_mix((counters + first) & 0xFFFFFFFF) ^ second)
    return (mixed + 0.5) / 4294967296.0


def normals(size: Column, seed: int, *parts: str | Column) -> Column:
    """``size`` standard normal values of the stream named by seed and parts: Box-Muller over a counter-based generator."""
    text = digest(seed, *parts)
    keys = [F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9)]

    @F.pandas_udf("array<double>")
    def draw(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, a, b in batches:
            out = []
            for n, first, second in zip(sizes, a, b):
                u = counter_uniforms(int(first), int(second), np.arange(2 * int(n), dtype=np.int64)).reshape(-1, 2)
                out.append(np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1]))
            yield pd.Series(out, dtype=object)

    return draw(F.greatest(size, F.lit(0)), *keys)
