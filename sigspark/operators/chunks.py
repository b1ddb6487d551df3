"""From raw reads to normalised fixed-length windows, and the choice among stored windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions import signal as sig
from sigspark.functions.arrays import uniform_position
from sigspark.functions.hashing import digest, hash_below, normals, uniform
from sigspark.operators.prefix import MAP_SIDE_LIMIT, first_k, with_running_sums
from sigspark.session import cut_lineage

NORMALIZERS = ("mad", "sclamp")


@dataclass(frozen=True)
class SignalProfile:
    """How reads become windows; ``profile_id`` names the normalisation."""

    profile_id: str = "mad"
    discard_first: int = 5000
    chunk_size: int = 6000
    overlap: int = 3000
    max_chunks: int | None = None
    spike_window: int = sig.SPIKE_WINDOW

    def __post_init__(self) -> None:
        if self.profile_id not in NORMALIZERS:
            raise ValueError(f"unsupported preprocessing profile: {self.profile_id}")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be smaller than chunk_size")

    @property
    def stride(self) -> int:
        return self.chunk_size - self.overlap

    def normalized(self) -> Column:
        """Restored and normalised samples of the raw ``signal`` column."""
        window = self.spike_window
        return sig.per_restored_read(sig.np_mad if self.profile_id == "mad" else lambda x: sig.np_sclamp(x, window))


def n_windows(size: Column, profile: SignalProfile) -> Column:
    usable = size - (profile.discard_first + profile.chunk_size)
    count = F.floor(usable / F.lit(profile.stride)) + 1
    return F.when(usable >= 0, count).otherwise(0).cast("int")


def pick_indices(n: Column, k: int | None) -> Column:
    """Indices of at most ``k`` evenly spaced items out of ``n``; all of them when there are no more than ``k``."""
    every = F.sequence(F.lit(0), n - 1)
    if k is None:
        return F.when(n > 0, every)
    if k == 1:
        some = F.array(F.lit(0))
    else:
        some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: uniform_position(i, n, k).cast("int"))
    return F.when(n > k, some).when(n > 0, every)


def read_status(reads: DataFrame, profile: SignalProfile) -> DataFrame:
    """Add ``status``: invalid (no signal, or a calibration that is incomplete or not finite), too_short or eligible."""
    finite = lambda *names: reduce(and_, [_is_finite(F.col(n)) for n in names])
    calibrated = F.when(F.col("lvdsmid").isNotNull(), finite("lvdsmid", "unit")).otherwise(
        finite("k", "scale", "offset", "b")
    )
    status = (
        F.when(F.col("signal").isNull() | ~calibrated, "invalid")
        .when(F.size("signal") < profile.discard_first + profile.chunk_size, "too_short")
        .otherwise("eligible")
    )
    return reads.withColumn("status", status)


def status_counts(reads: DataFrame, profile: SignalProfile) -> DataFrame:
    """Scanned, eligible, too short and invalid reads per source file."""
    return count_by_status(read_status(reads, profile))


def count_by_status(rows: DataFrame) -> DataFrame:
    """:func:`status_counts` of rows that have their status."""
    is_ = lambda s: F.sum((F.col("status") == s).cast("long"))
    return rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("scanned"),
        is_("eligible").alias("eligible"),
        is_("too_short").alias("too_short"),
        is_("invalid").alias("invalid"),
    )


def limit_eligible(reads: DataFrame, profile: SignalProfile, max_reads: int) -> DataFrame:
    """The first ``max_reads`` eligible reads in (file, position) order; ineligible reads do not count.

    A large limit is resolved on counts per file: files before the limit pass whole, and only the reads of the one file
    in which it falls are ranked, so signals are not sorted.
    """
    rows = read_status(reads, profile).where("status = 'eligible'").drop("status")
    order = ["source_read_index", "read_id"]
    if max_reads <= MAP_SIDE_LIMIT:
        return rows.orderBy("source_file", *order).limit(max_reads)
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    files = cut_lineage(with_running_sums(counts, [], ["source_file"], {"upto": "n"}))
    whole = rows.join(files.where(F.col("upto") <= max_reads).select("source_file"), "source_file", "left_semi")
    before = F.col("upto") - F.col("n")
    edge = files.where((F.col("upto") > max_reads) & (before < max_reads)).select("source_file", before.alias("b")).first()
    if edge is None:
        return whole.select(*rows.columns)
    part = rows.where(F.col("source_file") == edge.source_file)
    part = first_k(part, ["source_file"], order, max_reads - edge.b, "nth").drop("nth")
    return whole.select(*rows.columns).unionByName(part)


def normalize_reads(reads: DataFrame, profile: SignalProfile) -> DataFrame:
    """Eligible reads with their normalised signal in ``x``."""
    rows = read_status(reads, profile).where("status = 'eligible'").drop("status")
    return rows.withColumn("x", profile.normalized())


def chunk_signal(reads: DataFrame, profile: SignalProfile, x: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """One row per window of ``x``, with the read, its file and the columns in ``keep``.

    Picks are made on indices first, so windows that are not used are never cut out.
    """
    n = n_windows(F.size(x), profile)
    start = lambda i: profile.discard_first + i * profile.stride
    picked = reads.select(
        "read_id", "source_file", *keep, x, n.alias("source_n_chunks"), F.posexplode(pick_indices(n, profile.max_chunks))
    )
    return picked.select(
        "read_id",
        "source_file",
        *keep,
        F.col("pos").alias("chunk_index"),
        F.col("col").alias("window_index"),
        "source_n_chunks",
        F.slice(x, start(F.col("col")) + 1, F.lit(profile.chunk_size)).alias("chunk"),
    )


def build_chunks(reads: DataFrame, profile: SignalProfile, keep: Sequence[str] = ()) -> DataFrame:
    """Restore, normalise and cut; a non-finite normalised value is an error at run time."""
    return chunk_signal(normalize_reads(reads, profile), profile, keep=keep)


def _is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def non_finite(values: Column) -> Column:
    """Whether an array holds a NaN, an infinity or a NULL (Arrow turns a NaN from Python into NULL)."""
    return F.exists(values, lambda v: ~_is_finite(v))


def finite_audit(rows: DataFrame, values: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose array has a NaN or an infinity, per key."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(non_finite(F.col(values)).cast("long")).alias("n_bad")
    )


def pick_chunks(chunks: DataFrame, k: int) -> DataFrame:
    """Evaluation pick from stored chunks that carry ``n_chunks``; a row filter, no shuffle."""
    return chunks.where(F.array_contains(pick_indices(F.col("n_chunks"), k), F.col("chunk_index")))


def pick_chunks_train(chunks: DataFrame, k: int, *, seed: int, epoch: int) -> DataFrame:
    """Training pick: ``k`` chunks per read in a seeded order that changes with the epoch."""
    at = digest(seed, F.lit(epoch), F.col("read_id"), F.col("chunk_index"))
    return first_k(chunks.withColumn("at", at), ["read_id"], ["at", "chunk_index"], k, "nth").drop("at", "nth")


def export_benchmark(
    benchmark: DataFrame, raw: DataFrame, *, max_chunks: int, splits: Sequence[str], profile_id: str
) -> DataFrame:
    """Benchmark rows with their chunk counts and running chunk pointer per class.

    The pointer follows (split in the given order, split_order). A read without raw chunks, or with two raw rows, is an
    error at run time.
    """
    source = raw.groupBy("read_id").agg(F.max("raw_n_chunks").alias("source_n_chunks"), F.count(F.lit(1)).alias("copies"))
    split_at = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    absent = F.concat(F.lit("read has no raw chunks: "), F.col("read_id"))
    twice = F.concat(F.lit("duplicate read_id in the raw manifest: "), F.col("read_id"))
    checked = (
        F.when(F.col("copies").isNull(), F.raise_error(absent).cast("int"))
        .when(F.col("copies") > 1, F.raise_error(twice).cast("int"))
        .otherwise(F.col("source_n_chunks"))
    )
    rows = (
        benchmark.join(source, "read_id", "left")
        .withColumn("source_n_chunks", checked)
        .drop("copies")
        .withColumn("raw_n_chunks", F.least("source_n_chunks", F.lit(max_chunks)))
        .withColumn("split_at", split_at)
    )
    placed = with_running_sums(rows, ["barcode"], ["split_at", "split_order", "read_id"], {"upto": "raw_n_chunks"})
    return placed.withColumn("raw_chunk_start", F.col("upto") - F.col("raw_n_chunks")).withColumn(
        "preprocessing_profile_id", F.lit(profile_id)
    ).drop("upto", "split_at")


def augment(
    chunks: DataFrame,
    *,
    seed: int,
    amplitude: float = 0.0,
    offset: float = 0.0,
    noise_std: float = 0.0,
    mask_points: int = 0,
    mask_probability: float = 0.0,
) -> DataFrame:
    """Scale and offset jitter, Gaussian noise and a random time mask, reproducible from seed, read and chunk."""
    who = (F.col("read_id"), F.col("chunk_index"))
    signed = lambda name: uniform(seed, name, *who) * 2 - 1
    drawn = chunks.withColumns(
        {
            "_scale": 1 + signed("scale") * amplitude,
            "_shift": signed("shift") * offset,
            "_masked": (uniform(seed, "mask", *who) < mask_probability) & F.lit(mask_points > 0),
            "_start": hash_below(F.greatest(F.lit(1), F.size("chunk") - mask_points + 1), seed, "start", *who),
        }
    )

    if noise_std > 0:
        drawn = drawn.withColumn("_noise", normals(F.size("chunk"), seed, "noise", *who))

    def sample(v: Column, i: Column) -> Column:
        out = v * F.col("_scale") + F.col("_shift")
        if noise_std > 0:
            out = out + F.col("_noise")[i] * noise_std
        inside = F.col("_masked") & (i >= F.col("_start")) & (i < F.col("_start") + mask_points)
        return F.when(inside, F.lit(0.0)).otherwise(out)

    return drawn.withColumn("chunk", F.transform("chunk", sample)).drop("_scale", "_shift", "_masked", "_start", "_noise")
