"""Signal restoration and normalisation.

Element-wise steps are built-in array functions. Medians, quantiles, forward fill and running medians run as Arrow
batches with NumPy: on reads of 100 000 samples the array-function form of the median scaling took 13 times as long, and
forward fill can only be written quadratically with array functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the two preprocessing profiles
MAD_SCALE = 1.4826
MINIMUM, MAXIMUM = 1.0, 220.0
SPIKE_WINDOW, SPIKE_THRESHOLD = 6000, 5.0
LINEAR_BOUND, TARGET_BOUND = 5.0, 6.0
MEDIAN_KERNEL = 5
QUANTILES = (0.01, 0.99)


CALIBRATION = ("lvdsmid", "unit", "k", "scale", "offset", "b")


def restore_signal() -> Column:
    """Physical values of the raw ``signal`` column; ``lvdsmid`` selects the first of two calibration variants.

    The first variant is (raw - lvdsmid) * unit, the second k * scale * (raw as unsigned 16 bit + offset) + b.
    """
    centred = F.transform("signal", lambda v: (v - F.col("lvdsmid")) * F.col("unit"))
    scaled = F.transform(
        "signal", lambda v: F.col("k") * F.col("scale") * (F.pmod(v, F.lit(65536)) + F.col("offset")) + F.col("b")
    )
    return F.when(F.col("lvdsmid").isNotNull(), centred).otherwise(scaled)


def smooth_clamp(x: Column, linear: float = LINEAR_BOUND, target: float = TARGET_BOUND) -> Column:
    """Identity up to ``linear``, then a tanh approach to ``target``, on both signs."""
    delta = target - linear
    if linear <= 0 or delta <= 0:
        return x
    tail = lambda v: F.lit(linear) + F.lit(delta) * F.tanh((F.abs(v) - linear) / delta)
    return F.transform(x, lambda v: F.when(F.abs(v) > linear, F.signum(v) * tail(v)).otherwise(v))


# NumPy helpers; each works on the samples of one read


def np_restore(
    raw: np.ndarray, lvdsmid: float, unit: float, k: float, scale: float, offset: float, b: float
) -> np.ndarray:
    """:func:`restore_signal` for one read; a missing calibration value is a NaN."""
    if not np.isnan(lvdsmid):
        return (raw - lvdsmid) * unit
    return k * scale * (raw.astype(np.int64) % 65536 + offset) + b


def np_repair(x: np.ndarray, low: float = MINIMUM, high: float = MAXIMUM) -> np.ndarray:
    """Out-of-range samples take the last sample before them that was in range; a bad first sample is clamped."""
    if x.size == 0:
        return x
    bad = (x < low) | (x > high)
    bad[0] = False
    source = np.where(bad, 0, np.arange(x.size))
    np.maximum.accumulate(source, out=source)
    clamped = x.copy()
    clamped[0] = high if x[0] > high else low if x[0] < low else x[0]
    return clamped[source]


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Middle (upper of the two for an even size) of every window; the signal is mirrored at both ends, again and again if
    it is shorter than the window.

    All windows descend together through the bits of the samples' ranks, from the highest: at each bit the samples are parted into
    those without and those with it, in order, so a window stays one range; a prefix count says how many of its samples have
    no such bit, hence on which side its middle lies.
    """
    if not x.size:
        return np.empty(0)
    left = size // 2
    values, rank = np.unique(np.pad(x, (left, size - 1 - left), mode="symmetric"), return_inverse=True)
    rank = rank.astype(np.int32)
    low = np.arange(x.size, dtype=np.int32)
    high = low + np.int32(size)
    below = np.full(x.size, left, dtype=np.int32)
    middle = np.zeros(x.size, dtype=np.int32)
    for bit in reversed(range(int(len(values) - 1).bit_length())):
        with_bit = (rank >> bit & 1).astype(bool)
        without = np.zeros(len(rank) + 1, dtype=np.int32)
        np.cumsum(~with_bit, out=without[1:])
        low_0, high_0 = without[low], without[high]
        inside = high_0 - low_0
        up = below >= inside
        below -= inside * up
        low = np.where(up, without[-1] + low - low_0, low_0)
        high = np.where(up, without[-1] + high - high_0, high_0)
        middle |= up.astype(np.int32) << bit
        rank = np.concatenate([rank[~with_bit], rank[with_bit]])
    return values[middle]


def np_despike(x: np.ndarray, window: int = SPIKE_WINDOW, threshold: float = SPIKE_THRESHOLD) -> np.ndarray:
    """Samples far from the running median take the cleaned sample before them."""
    if x.size == 0:
        return x
    middle = running_median(x, window)
    residual = np.abs(x - middle)
    spike = residual > threshold * max(MAD_SCALE * float(np.median(residual)), 1.0)
    base = x.copy()
    if spike[0]:
        base[0] = middle[0]
        spike[0] = False
    source = np.where(spike, 0, np.arange(x.size))
    return base[np.maximum.accumulate(source)]


def np_mad(x: np.ndarray) -> np.ndarray:
    """(x - median) / scaled median absolute deviation, without a clamp."""
    if x.size == 0:
        return x
    centred = x - np.median(x)
    return centred / max(MAD_SCALE * float(np.median(np.abs(centred))), 1.0)


def np_central_mad(x: np.ndarray) -> np.ndarray:
    """Median-centred values over the scaled median absolute residual of the central 98 %, which is not re-centred.

    Two different samples both lie outside their central 98 %; the scale is then the least one.
    """
    if x.size == 0:
        return x
    residual = x - np.median(x)
    low, high = np.quantile(residual, QUANTILES)
    central = np.abs(residual[(residual >= low) & (residual <= high)])
    return residual / max(MAD_SCALE * float(np.median(central)) if central.size else 0.0, 1.0)


def np_median5(x: np.ndarray) -> np.ndarray:
    """Running median of five samples with zeros beyond both ends."""
    if x.size == 0:
        return x
    half = MEDIAN_KERNEL // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, half), MEDIAN_KERNEL)
    return np.median(windows, axis=1)


def np_smooth_clamp(x: np.ndarray, linear: float = LINEAR_BOUND, target: float = TARGET_BOUND) -> np.ndarray:
    delta = target - linear
    bounded = np.sign(x) * (linear + delta * np.tanh((np.abs(x) - linear) / delta))
    return np.where(np.abs(x) > linear, bounded, x)


def np_sclamp(x: np.ndarray, window: int = SPIKE_WINDOW) -> np.ndarray:
    """Range repair, spike removal, central scaling, running median of five and smooth clamp."""
    return np_smooth_clamp(np_median5(np_central_mad(np_despike(np_repair(x), window))))


def per_read(function: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    """Apply a NumPy function to each array of an ``array<double>`` column, in Arrow batches; NULL stays NULL."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda a: None if a is None else function(np.asarray(a, dtype=np.float64)))

    return run(x)


def per_restored_read(function: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Restore the raw ``signal`` and apply a NumPy function in the same Arrow batch; a non-finite result is an error.

    Raw integers travel to Python instead of restored doubles, and the samples are touched by one step instead of two.
    """

    def one(raw: np.ndarray | None, *calibration: float) -> np.ndarray | None:
        if raw is None:
            return None
        out = function(np_restore(np.asarray(raw), *calibration))
        if not np.isfinite(out).all():
            raise ValueError("normalised signal contains non-finite values")
        return out

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for raw, *calibration in batches:
            rows = zip(raw, *[c.astype(float) for c in calibration])
            yield pd.Series([one(*row) for row in rows], dtype=object)

    return run("signal", *CALIBRATION)


def mad_normalize(x: Column) -> Column:
    return per_read(np_mad, x)


def central_mad(x: Column) -> Column:
    return per_read(np_central_mad, x)


def median5(x: Column) -> Column:
    return per_read(np_median5, x)


def repair_range(x: Column) -> Column:
    return per_read(np_repair, x)


def despike(x: Column, window: int = SPIKE_WINDOW, threshold: float = SPIKE_THRESHOLD) -> Column:
    return per_read(lambda a: np_despike(a, window, threshold), x)


def sclamp(x: Column, window: int = SPIKE_WINDOW) -> Column:
    return per_read(lambda a: np_sclamp(a, window), x)
