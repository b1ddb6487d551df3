"""File-by-file classification and running reports with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sigspark.operators.bags import AttentionParams, LinearHead, encode_chunks, score_bags
from sigspark.operators.calibration import ThresholdSpec, abundance
from sigspark.operators.chunks import SignalProfile, build_chunks, count_by_status, read_status
from sigspark.operators.metrics import composition
from sigspark.operators.prefix import with_row_number
from sigspark.session import own_stages
from sigspark.sources.files import config_hash
from sigspark.sources.signals import SIGNAL_SCHEMA
from sigspark.streaming.seen import SeenIds


def classify_reads(
    reads: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], head: LinearHead,
    profile: SignalProfile, classes: Sequence[str], *, dim: int, attention: AttentionParams | None = None,
) -> DataFrame:
    """Signals to read-level predictions in one plan; the windows are never stored."""
    chunks = encode_chunks(build_chunks(reads, profile), make_encoder, chunk_size=profile.chunk_size)
    return score_bags(chunks, head, classes, dim=dim, keys=["read_id", "source_file"], attention=attention)


def run_checkpoint(base: str, settings: Mapping[str, object]) -> str:
    """Checkpoint folder of one configuration; the same settings resume, other settings start afresh."""
    return f"{base.rstrip('/')}/{config_hash(settings)[:16]}"


def run_output(out_dir: str, checkpoint: str) -> str:
    """Folder of the predictions that belong to a checkpoint."""
    return f"{out_dir.rstrip('/')}/run=r{config_hash({'checkpoint': checkpoint.rstrip('/')})[:16]}"


def classified(spark: SparkSession, out_dir: str, checkpoint: str) -> DataFrame:
    """All predictions of one run of :func:`classify_stream`."""
    return spark.read.parquet(run_output(out_dir, checkpoint))


def _state(out_dir: str, checkpoint: str, name: str) -> str:
    """Folder of a side table of a run; readers of ``out_dir`` pass over it."""
    return f"{out_dir.rstrip('/')}/_state/{run_output('', checkpoint).lstrip('/')}/{name}"


COUNTERS = ("scanned", "eligible", "too_short", "invalid")


def file_counters(spark: SparkSession, out_dir: str, checkpoint: str) -> DataFrame:
    """Scanned, eligible, too short and invalid reads per source file, over all finished batches of a run."""
    stored = spark.read.schema("source_file string, " + ", ".join(f"{c} long" for c in COUNTERS)).parquet(
        _state(out_dir, checkpoint, "counters")
    )
    return stored.groupBy("source_file").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def _first_reads(batch: DataFrame, remaining: int) -> DataFrame:
    """The rows up to the ``remaining``-th eligible one in (file, position) order; later ones do not count as scanned."""
    eligible = batch.where("status = 'eligible'").select("source_file", "source_read_index", "read_id")
    # as many rows as a batch has files
    counts = eligible.groupBy("source_file").count().orderBy("source_file").collect()
    before = 0
    for row in counts:
        if before + row["count"] >= remaining:
            break
        before += row["count"]
    else:
        return batch
    edge = eligible.where(F.col("source_file") == row.source_file)
    place = ["source_read_index", "read_id"]
    last = with_row_number(edge, ["source_file"], place, "nth").where(F.col("nth") == remaining - before).first()
    up_to = F.struct(*place) <= F.struct(F.lit(last.source_read_index).cast("long"), F.lit(last.read_id))
    return batch.where((F.col("source_file") < row.source_file) | ((F.col("source_file") == row.source_file) & up_to))


def classify_stream(
    spark: SparkSession, input_dir: str, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], head: LinearHead,
    profile: SignalProfile, classes: Sequence[str], *, dim: int, out_dir: str, checkpoint: str, files_per_trigger: int = 64,
    attention: AttentionParams | None = None, max_reads: int = 0, capacity: int = 10_000_000,
) -> StreamingQuery:
    """Classify files as they arrive; with ``max_reads`` above 0, no more than so many eligible reads of the run.

    A read is one row, so its windows never span two micro-batches. Each batch replaces its own folders: predictions in
    ``run=<checkpoint>/batch_id=<n>``, counters per file and the ids it scored beside them, so a batch that is run again after a
    failure leaves no duplicates, and runs with other settings, which have another checkpoint, stay apart; :func:`classified` and
    :func:`file_counters` read one run. An eligible read id that the batch holds twice, or that an earlier batch has
    scored, is an error that stops the query; ids are looked up in a :class:`SeenIds` store made for ``capacity`` ids.

    Under a limit reads are taken in order of arrival of the batches and of (file, position) inside a batch. Batches behind the
    limit are passed over unread.
    """
    target = run_output(out_dir, checkpoint)
    counters = _state(out_dir, checkpoint, "counters")
    arriving = (
        spark.readStream.schema(SIGNAL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(input_dir)
    )

    @own_stages
    def score(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if max_reads > 0:
            taken = 0
            if batch_id:
                stored = session.read.schema("eligible long, batch_id long").parquet(counters)
                taken = stored.where(F.col("batch_id") < batch_id).agg(F.sum("eligible")).first()[0] or 0
            if taken >= max_reads:
                return
        # kept on disk, so that counting, the check and the scoring read the files once
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            kept = _first_reads(batch, max_reads - taken) if max_reads > 0 else batch
            count_by_status(kept).write.mode("overwrite").parquet(f"{counters}/batch_id={batch_id}")
            reads = kept.where("status = 'eligible'").drop("status")
            seen = SeenIds(session, _state(out_dir, checkpoint, "seen"), capacity)
            seen.require_new(reads.select("read_id"), batch_id, input_dir)
            scored = classify_reads(reads, make_encoder, head, profile, classes, dim=dim, attention=attention)
            scored.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        read_status(arriving, profile)
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@dataclass(frozen=True)
class StreamReport:
    """What a finished run has: all predictions, counters per file, composition of the accepted reads."""

    predictions: DataFrame
    counters: DataFrame
    composition: DataFrame


def finish_stream(
    spark: SparkSession, out_dir: str, checkpoint: str, classes: Sequence[str], spec: ThresholdSpec
) -> StreamReport:
    """Merge the batches of a run; a run without an eligible read is an error."""
    counters = file_counters(spark, out_dir, checkpoint)
    if not counters.agg(F.sum("eligible")).first()[0]:
        raise ValueError("no eligible reads were found")
    predictions = classified(spark, out_dir, checkpoint)
    return StreamReport(predictions, counters, abundance(predictions, classes, spec))


def unique_reads(stream: DataFrame) -> DataFrame:
    """First arrival of every read id over the whole run, however old its file is.

    There is no watermark, because one would drop every read of a file that is older than the newest by more than its delay.
    The state therefore holds every id once; it is dealt over the shuffle partitions, and
    ``spark.sql.streaming.stateStore.providerClass`` may keep it in RocksDB, on disk rather than in memory.
    """
    return stream.dropDuplicates(["read_id"])


def arrivals(stream: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Keep, per batch, how often each id that arrived in it has arrived so far."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    counts = stream.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def repeated_reads(spark: SparkSession, out_dir: str) -> DataFrame:
    """(read_id, n) of the ids that have arrived more than once in all batches of :func:`arrivals`."""
    stored = spark.read.schema("read_id string, n long").parquet(out_dir)
    return stored.groupBy("read_id").agg(F.max("n").alias("n")).where("n > 1")


def abundance_stream(pred: DataFrame, spec: ThresholdSpec, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Per-batch counts of accepted labels; their sum is the composition so far."""

    def count(batch: DataFrame, batch_id: int) -> None:
        accepted = batch.where(spec.accepts()).groupBy(F.col("predicted_label").alias("label"))
        counts = accepted.agg(F.count(F.lit(1)).alias("reads"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return (
        pred.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def abundance_so_far(spark: SparkSession, out_dir: str, classes: Sequence[str]) -> DataFrame:
    """Composition over all finished batches, with a row for every declared class."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("reads", T.LongType())])
    parts = spark.read.schema(schema).parquet(out_dir).select("label", "reads")
    return composition(parts, classes)
