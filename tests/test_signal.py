from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import signal as sig
from sigspark.operators import chunks as ch
from sigspark.sources.signals import SIGNAL_SCHEMA


def apply(spark, column, arrays):
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(arrays)], "i int, x array<double>")
    return [np.array(r.y) for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def read(read_id="r", signal=(), lvdsmid=10.0, unit=0.5, k=None, scale=None, offset=None, b=None, file="f", index=0):
    return (read_id, file, index, list(signal) if signal is not None else None, lvdsmid, unit, k, scale, offset, b)


def random_signals(n=20, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(90, 60, rng.integers(1, 200)).round(2) for _ in range(n)]


def naive_fill(x, bad, first):
    out = x.copy()
    for i in np.flatnonzero(bad):
        out[i] = first if i == 0 else out[i - 1]
    return out


def test_mad_has_no_clamp(spark):
    [got] = apply(spark, sig.mad_normalize, [[0, 0, 1, 100]])
    expected = (np.array([0, 0, 1, 100]) - 0.5) / max(1.4826 * 0.5, 1.0)
    np.testing.assert_allclose(got, expected, rtol=1e-12)
    assert got.max() > 6


def test_empty_signals_stay_empty(spark):
    for column in (sig.mad_normalize, sig.central_mad, sig.median5, sig.repair_range, sig.despike, sig.smooth_clamp):
        assert [len(y) for y in apply(spark, column, [[]])] == [0]


def test_range_repair_matches_a_loop(spark):
    signals = random_signals()
    for x, got in zip(signals, apply(spark, sig.repair_range, signals)):
        first = 220.0 if x[0] > 220 else 1.0
        np.testing.assert_array_equal(got, naive_fill(x, (x < 1) | (x > 220), first))


def naive_running_median(x, size):
    left = size // 2
    padded = np.pad(x, (left, size - 1 - left), mode="symmetric")
    return np.array([np.sort(padded[i : i + size])[size // 2] for i in range(len(x))])


@pytest.mark.parametrize("size", [1, 2, 4, 5, 64, 501, 6000])
def test_running_median_matches_sorting_every_window(size):
    for x in random_signals(8, seed=size):
        np.testing.assert_array_equal(sig.running_median(x, size), naive_running_median(x, size))


def test_despike_matches_a_loop(spark):
    signals = [np.where(np.arange(len(x)) % 17 == 0, x + 900, x) for x in random_signals(seed=3)]
    for x, got in zip(signals, apply(spark, lambda c: sig.despike(c, 12, 3.0), signals)):
        middle = naive_running_median(x, 12)
        residual = np.abs(x - middle)
        bad = residual > 3.0 * max(1.4826 * np.median(residual), 1.0)
        np.testing.assert_allclose(got, naive_fill(x, bad, middle[0]))


def test_central_scaling_does_not_recentre(spark):
    for x, got in zip(random_signals(seed=4), apply(spark, sig.central_mad, random_signals(seed=4))):
        residual = x - np.median(x)
        low, high = np.quantile(residual, [0.01, 0.99])
        inside = residual[(residual >= low) & (residual <= high)]
        np.testing.assert_allclose(got, residual / max(1.4826 * np.median(np.abs(inside)), 1.0))


def test_median_of_five_pads_with_zeros(spark):
    [got] = apply(spark, sig.median5, [[5, 1, 4, 2, 3, 9]])
    np.testing.assert_array_equal(got, [1, 2, 3, 3, 3, 2])


def test_smooth_clamp_bounds(spark):
    [got] = apply(spark, sig.smooth_clamp, [[-100, -5, 0, 5, 5.5, 100]])
    np.testing.assert_allclose(got, [-6, -5, 0, 5, 5 + np.tanh(0.5), 6])


def test_composite_profile_stays_inside_the_target(spark):
    for y in apply(spark, lambda c: sig.sclamp(c, 31), random_signals(seed=5)):
        assert np.abs(y).max() <= 6


def test_restoration_variants(spark):
    rows = [read("a", [10, 20]), read("b", [-1, 3], None, None, 0.5, 2.0, 1.0, 0.25), read("c", [1], None, None)]
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA).withColumn("x", sig.restore_signal())
    got = {r.read_id: r.x for r in df.collect()}
    assert got == {"a": [0.0, 5.0], "b": [65536.25, 4.25], "c": [None]}
    both = df.withColumn("y", sig.per_restored_read(lambda x: x)).where("read_id <> 'c'").collect()
    assert all(r.x == r.y for r in both)


def test_long_read_gives_three_windows(spark):
    profile = ch.SignalProfile("mad", discard_first=5000, chunk_size=6000, overlap=3000)
    df = spark.createDataFrame([read(signal=range(17000))], SIGNAL_SCHEMA)
    rows = ch.chunk_signal(df, profile, "signal").orderBy("chunk_index").collect()
    assert [r.chunk[0] for r in rows] == [5000, 8000, 11000] and {len(r.chunk) for r in rows} == {6000}


def test_restoration_precedes_normalisation(spark):
    profile = ch.SignalProfile("mad", discard_first=5000, chunk_size=6000, overlap=3000)
    signal = np.random.default_rng(1).integers(0, 500, 12000)
    [row] = ch.build_chunks(spark.createDataFrame([read(signal=signal.tolist())], SIGNAL_SCHEMA), profile).collect()
    np.testing.assert_allclose(row.chunk, sig.np_mad((signal - 10.0) * 0.5)[5000:11000])


def test_short_and_broken_reads_have_a_status(spark):
    profile = ch.SignalProfile("mad", discard_first=3, chunk_size=4, overlap=2)
    rows = [read("ok", range(7)), read("short", range(6)), read("none", None), read("uncalibrated", range(9), None, None)]
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    [c] = ch.status_counts(df, profile).collect()
    assert (c.scanned, c.eligible, c.too_short, c.invalid) == (4, 1, 1, 2)
    assert ch.build_chunks(df, profile).count() == 1


def test_limit_counts_eligible_reads_only(spark):
    profile = ch.SignalProfile("mad", discard_first=0, chunk_size=4, overlap=2)
    rows = [read(f"r{i}", range(9 if i % 2 else 3), file=f"f{i // 4}", index=i % 4) for i in range(12)]
    got = ch.limit_eligible(spark.createDataFrame(rows, SIGNAL_SCHEMA), profile, 4).collect()
    assert [r.read_id for r in got] == ["r1", "r3", "r5", "r7"]


@pytest.mark.parametrize("limit", [1200, 2999, 3000, 9000])
def test_large_limits_take_whole_files_and_part_of_one(spark, limit):
    profile = ch.SignalProfile("mad", discard_first=0, chunk_size=4, overlap=2)
    # the first file holds a third of the reads
    rows = [read(f"r{i}", [1] * (9 if i % 3 else 2), file=f"f{max(0, i % 12 - 3)}", index=i) for i in range(4500)]
    got = ch.limit_eligible(spark.createDataFrame(rows, SIGNAL_SCHEMA), profile, limit).select("read_id").collect()
    eligible = sorted((r[1], r[2], r[0]) for r in rows if len(r[3]) == 9)
    assert sorted(r.read_id for r in got) == sorted(r for _, _, r in eligible[:limit])


def test_reads_that_cannot_become_finite_are_invalid(spark):
    profile = ch.SignalProfile("mad", discard_first=0, chunk_size=4, overlap=2)
    rows = [read("inf", range(6), unit=float("inf")), read("nan", range(6), float("nan")), read("ok", range(6))]
    df = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    [c] = ch.status_counts(df, profile).collect()
    assert (c.eligible, c.invalid) == (1, 2)
    assert {r.read_id for r in ch.build_chunks(df, profile).collect()} == {"ok"}


def test_overflow_to_infinity_is_an_error(spark):
    profile = ch.SignalProfile("mad", discard_first=0, chunk_size=4, overlap=2)
    df = spark.createDataFrame([read("r", [2**30] * 3 + [-(2**30)] * 3, unit=1e300)], SIGNAL_SCHEMA)
    with pytest.raises(Exception, match="non-finite"):
        ch.build_chunks(df, profile).collect()


def test_finite_audit_sees_nan_infinity_and_null(spark):
    rows = [("a", [1.0, float("nan")]), ("b", [float("-inf")]), ("c", [None, 2.0]), ("d", [0.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    assert {r.k: r.n_bad for r in ch.finite_audit(df, "v", ["k"]).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_profile_arguments_are_checked():
    with pytest.raises(ValueError, match="unsupported preprocessing profile"):
        ch.SignalProfile("other")
    with pytest.raises(ValueError, match="overlap"):
        ch.SignalProfile("mad", chunk_size=10, overlap=10)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 16, 64])
def test_uniform_pick_equals_linspace(spark, k):
    rows = spark.range(1, 1500).select(F.col("id").cast("int").alias("n"))
    for r in rows.select("n", ch.pick_indices(F.col("n"), k).alias("p")).collect():
        expected = np.arange(r.n) if r.n <= k else np.linspace(0, r.n - 1, num=k, dtype=np.int64)
        assert r.p == expected.tolist(), r.n


def test_training_pick_depends_on_the_epoch_only(spark):
    df = spark.range(400).selectExpr("concat('r', id div 40) AS read_id", "CAST(id % 40 AS INT) AS chunk_index")

    def draw(epoch, parts):
        rows = ch.pick_chunks_train(df.repartition(parts), 5, seed=1, epoch=epoch).collect()
        return sorted((r.read_id, r.chunk_index) for r in rows)

    assert draw(0, 3) == draw(0, 11) != draw(1, 3)
    assert len(draw(0, 3)) == 50


def test_augmentation(spark):
    rows = [(f"r{i}", 0, [1.0] * 2000) for i in range(40)]
    df = spark.createDataFrame(rows, "read_id string, chunk_index int, chunk array<double>")
    plain = ch.augment(df, seed=3, amplitude=0.2, offset=0.1).collect()
    values = np.array([r.chunk[0] for r in plain])
    assert np.all([len(set(r.chunk)) == 1 for r in plain]) and np.all(np.abs(values - 1) <= 0.3) and values.std() > 0.02
    noisy = np.array([r.chunk for r in ch.augment(df, seed=3, noise_std=0.5).collect()]) - 1
    assert abs(noisy.mean()) < 0.01 and abs(noisy.std() - 0.5) < 0.01
    masked = np.array([r.chunk for r in ch.augment(df, seed=3, mask_points=100, mask_probability=1.0).collect()])
    assert np.all((masked == 0).sum(axis=1) == 100)
    assert np.all(np.diff(masked, axis=1).astype(bool).sum(axis=1) <= 2)


def test_export_pointer_and_errors(spark):
    bench = spark.createDataFrame(
        [("train", 0, "a", "r0"), ("train", 1, "a", "r1"), ("val", 0, "a", "r2"), ("train", 0, "b", "r3")],
        "split string, split_order long, barcode string, read_id string",
    )
    raw = spark.createDataFrame([("r0", 5), ("r1", 2), ("r2", 9), ("r3", 1)], "read_id string, raw_n_chunks int")
    kw = {"max_chunks": 3, "splits": ("train", "val", "test"), "profile_id": "mad"}
    rows = ch.export_benchmark(bench, raw, **kw).collect()
    got = {r.read_id: (r.raw_chunk_start, r.raw_n_chunks, r.source_n_chunks) for r in rows}
    assert got == {"r0": (0, 3, 5), "r1": (3, 2, 2), "r2": (5, 3, 9), "r3": (0, 1, 1)}
    with pytest.raises(Exception, match="read has no raw chunks: r3"):
        ch.export_benchmark(bench, raw.where("read_id <> 'r3'"), **kw).collect()
    with pytest.raises(Exception, match="duplicate read_id in the raw manifest: r0"):
        ch.export_benchmark(bench, raw.union(raw.where("read_id = 'r0'")), **kw).collect()
