"""Inventories, stores, incremental plans and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigspark.operators import bags as bag
from sigspark.operators import chunks as ch
from sigspark.operators.calibration import ThresholdSpec
from sigspark.plans import cache
from sigspark.plans.bag_queries import CLASSES as BAG_CLASSES
from sigspark.plans.bag_queries import (
    LONG_SQL,
    PROFILE,
    RAW_DIM,
    RAW_HEAD,
    RAW_SCORES_SQL,
    embedding_values,
    formula_encoder,
    read_scores,
)
from sigspark.plans.bridge import CLASSES, predictions_of, signals, table
from sigspark.plans.metric_queries import LABELS
from sigspark.plans.registry import query, sql
from sigspark.session import cut_lineage, scratch_path
from sigspark.sources import files, sinks
from sigspark.sources.predictions import read_predictions
from sigspark.sources.signals import SIGNAL_SCHEMA
from sigspark.streaming import classify as stream
from sigspark.streaming.seen import SeenIds


@query("inventory_files")
def _(spark, d):
    return files.inventory(spark, d, (".parquet",)).withColumn("extensions", F.array_join("extensions", ","))


@query("checksums")
def _(spark, d):
    return files.checksums(spark, d)


@query("incremental_plan", """
WITH f AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS BIGINT) AS size, p_partkey * 10 AS mtime, p_partkey AS k FROM part),
ledger AS (SELECT path, CASE WHEN k % 5 = 0 THEN size + 1 ELSE size END AS size, mtime,
                  CASE WHEN k % 7 = 0 THEN 'old' ELSE 'new' END AS h, CASE WHEN k % 11 = 0 THEN 'partial' ELSE 'complete' END AS status
           FROM f WHERE k % 3 <> 0)
SELECT path, size, mtime FROM f WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.path = f.path AND l.size = f.size
  AND l.mtime = f.mtime AND l.h = 'new' AND l.status = 'complete')""")
def _(spark, d):
    found = table(spark, d, "part").selectExpr(
        "concat('p', p_partkey) AS path", "CAST(p_size AS BIGINT) AS size", "p_partkey * 10 AS mtime", "p_partkey AS k"
    )
    ledger = found.where("k % 3 <> 0").selectExpr(
        "path", "IF(k % 5 = 0, size + 1, size) AS size", "mtime", "IF(k % 7 = 0, 'old', 'new') AS config_hash",
        "IF(k % 11 = 0, 'partial', 'complete') AS status",
    )
    return files.plan_incremental(found.drop("k"), ledger, "new")


@query("chunk_store", sql(["samples"], """
, n AS (SELECT read_id, source_file, (count(*) - 25) // 10 + 1 AS c FROM samples GROUP BY 1, 2 HAVING count(*) >= 25)
SELECT source_file, count(*) AS n_reads, CAST(sum(least(c, 4)) AS BIGINT) AS n_chunks FROM n GROUP BY 1"""))
def _(spark, d):
    path = scratch_path(spark, "chunks")
    chunks = ch.build_chunks(signals(spark, d), PROFILE)
    sinks.write_store(chunks, path, by="source_file")
    return sinks.read_store(chunks, path).groupBy("source_file", "read_id").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "source_file"
    ).agg(F.count(F.lit(1)).alias("n_reads"), F.sum("n").alias("n_chunks"))


@query("cache_rebuild", sql(["samples"], """
, n AS (SELECT read_id, source_file, (count(*) - 25) // 10 + 1 AS c FROM samples GROUP BY read_id, source_file, source_read_index
        HAVING count(*) >= 25 AND NOT (source_read_index % 2 = 0 AND source_read_index % 3 = 0))
SELECT source_file, count(*) AS n_reads, CAST(sum(least(c, 3)) AS BIGINT) AS n_chunks FROM n GROUP BY 1"""))
def _(spark, d):
    """Three calls: two files, both again with other settings, then one replaced by shorter reads and one added."""
    source, store = scratch_path(spark, "signals"), scratch_path(spark, "store")
    reads = signals(spark, d)
    even, added = F.col("source_read_index") % 2 == 0, F.col("source_read_index") % 5 == 0
    reads.where(even).write.parquet(f"{source}/a")
    reads.where(~even & ~added).write.parquet(f"{source}/b")
    fewer = replace(PROFILE, max_chunks=3)
    for profile in (PROFILE, fewer):
        cache.cache_chunks(spark, source, store, profile)
    cut = F.when(F.col("source_read_index") % 3 == 0, F.slice("signal", 1, 24)).otherwise(F.col("signal"))
    reads.where(even).withColumn("signal", cut).write.mode("overwrite").parquet(f"{source}/a")
    reads.where(~even & added).write.parquet(f"{source}/c")
    cache.cache_chunks(spark, source, store, fewer)
    return cache.stored_reads(spark, store).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum("raw_n_chunks").alias("n_chunks")
    )


@query("embed_store", sql(["samples", "physical"], LONG_SQL))
def _(spark, d):
    chunks = ch.build_chunks(signals(spark, d), PROFILE)
    path = scratch_path(spark, "embeddings")
    encoded = bag.encode_chunks(chunks, formula_encoder, chunk_size=PROFILE.chunk_size)
    sinks.write_store(encoded, path, by="source_file")
    stored = sinks.read_store(encoded, path)
    sinks.require_complete(chunks.select("read_id", "chunk_index"), stored, ["read_id", "chunk_index"])
    return embedding_values(stored)


@query("stream_classify", sql(["samples", "physical"], RAW_SCORES_SQL))
def _(spark, d):
    """Three batches, then a file that repeats a read of the first one, which has to stop the resumed run."""
    source, out = scratch_path(spark, "signals"), scratch_path(spark, "predictions")
    reads = signals(spark, d)
    reads.repartition(3, "source_read_index").write.parquet(source)
    checkpoint = stream.run_checkpoint(scratch_path(spark, "stream"), {"profile": PROFILE, "source": source})

    def run():
        stream.classify_stream(
            spark, source, formula_encoder, RAW_HEAD, PROFILE, BAG_CLASSES, dim=RAW_DIM, out_dir=out, checkpoint=checkpoint,
            files_per_trigger=1,
        ).awaitTermination()

    run()
    scored = cut_lineage(stream.classified(spark, out, checkpoint))
    late = scored.agg(F.min("read_id")).first()[0]
    if late is None:
        # no read was eligible, so none can come twice
        return read_scores(scored)
    spark.read.schema(SIGNAL_SCHEMA).parquet(source).where(F.col("read_id") == late).write.mode("append").parquet(source)
    try:
        run()
    except StreamingQueryException as error:
        if "duplicate read_id" not in str(error):
            raise
        return read_scores(scored)
    raise RuntimeError("a read that came twice was scored twice")


@query("stream_resume", sql(["samples", "physical"], RAW_SCORES_SQL))
def _(spark, d):
    """A run over the first half of the files, and its resumption with the same settings once the others are there."""
    source, out, base = (scratch_path(spark, name) for name in ("signals", "predictions", "stream"))
    reads = cut_lineage(signals(spark, d))
    checkpoint = stream.run_checkpoint(base, {"profile": PROFILE, "source": source})
    first = F.substring("source_file", 2, 1).cast("int") < 5
    for part in (first, ~first):
        reads.where(part).coalesce(1).write.mode("append").parquet(source)
        stream.classify_stream(
            spark, source, formula_encoder, RAW_HEAD, PROFILE, BAG_CLASSES, dim=RAW_DIM, out_dir=out, checkpoint=checkpoint
        ).awaitTermination()
    # a batch may hold no eligible read, so what was scanned tells, not what was scored
    scanned = stream.file_counters(spark, out, checkpoint).agg(F.sum("scanned")).first()[0]
    if (scanned or 0) != reads.count():
        raise RuntimeError("the resumed run read finished files again, or passed over new ones")
    return read_scores(stream.classified(spark, out, checkpoint))


@query("csv_round_trip", sql(["predictions"], """
SELECT read_id, true_label, predicted_label, round(confidence, 6) AS confidence, split FROM predictions"""))
def _(spark, d):
    path = scratch_path(spark, "table") + ".csv"
    sinks.write_csv(predictions_of(table(spark, d, "events")), path)
    return read_predictions(spark, path).select(
        "read_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "split"
    )


COUNTERS_SQL = """
, lengths AS (SELECT source_file, source_read_index, read_id, count(*) AS n FROM samples GROUP BY ALL),
ordered AS (SELECT *, coalesce(sum(CAST(n >= 25 AS INTEGER)) OVER (ORDER BY source_file, source_read_index, read_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM lengths)
SELECT source_file, count(*) AS scanned, CAST(sum(CAST(n >= 25 AS INTEGER)) AS BIGINT) AS eligible,
       CAST(sum(CAST(n < 25 AS INTEGER)) AS BIGINT) AS too_short, CAST(0 AS BIGINT) AS invalid
FROM ordered WHERE taken < (SELECT count(*) // 2 FROM lengths WHERE n >= 25) GROUP BY source_file"""


@query("stream_counters", sql(["samples"], COUNTERS_SQL))
def _(spark, d):
    """Counters per file of a run over two folders, limited to half of the eligible reads; a batch holds half of the files."""
    source, out = scratch_path(spark, "signals"), scratch_path(spark, "predictions")
    reads = cut_lineage(signals(spark, d))
    first = F.substring("source_file", 2, 1).cast("int") < 5
    for part in (first, ~first):
        reads.where(part).coalesce(1).write.mode("append").parquet(source)
    checkpoint = scratch_path(spark, "stream")
    limit = ch.read_status(reads, PROFILE).where("status = 'eligible'").count() // 2
    if limit == 0:
        # half of the eligible reads is none, while a limit of 0 would stand for all
        return ch.status_counts(reads, PROFILE).limit(0)
    stream.classify_stream(
        spark, source, formula_encoder, RAW_HEAD, PROFILE, BAG_CLASSES, dim=RAW_DIM, out_dir=out, checkpoint=checkpoint,
        files_per_trigger=1, max_reads=limit,
    ).awaitTermination()
    return stream.file_counters(spark, out, checkpoint)


@query("seen_ids", """
WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 977 AS VARCHAR) AS read_id, event_id % 5 AS batch FROM events),
n AS (SELECT batch, read_id, count(*) AS n FROM e GROUP BY batch, read_id)
SELECT CAST(batch AS INTEGER) AS batch, read_id FROM n
WHERE n > 1 OR EXISTS (SELECT 1 FROM n o WHERE o.read_id = n.read_id AND o.batch < n.batch)""")
def _(spark, d):
    """Ids of the events in five batches: those that each batch repeats."""
    ids = table(spark, d, "events").selectExpr("concat('u', user_id, '-', event_id % 977) AS read_id", "event_id % 5 AS batch")
    seen = SeenIds(spark, scratch_path(spark, "seen"), capacity=1 << 18)
    found = None
    for k in range(5):
        repeated = cut_lineage(seen.add(ids.where(F.col("batch") == k).select("read_id"), k))
        repeated = repeated.select(F.lit(k).alias("batch"), "read_id")
        found = repeated if found is None else found.unionByName(repeated)
    return found


@query("stream_dedup", "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS read_id FROM events")
def _(spark, d):
    """The ids of the events arrive in six files, one a batch, so most of them arrive again in later batches."""
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "unique")
    ids = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("read_id"), "event_id")
    ids.repartition(6, "event_id").write.parquet(source)
    arriving = spark.readStream.schema("read_id string").option("maxFilesPerTrigger", 1).parquet(source)
    (
        stream.unique_reads(arriving).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "dedup")).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out)


@query("stream_abundance", sql(["predictions"], f"""
SELECT l.label, 'c' || CAST(l.label AS VARCHAR) AS class_name, count(p.read_id) AS reads,
       round(count(p.read_id) / (SELECT count(*) FROM predictions WHERE confidence >= 0.5), 6) AS fraction_of_accepted
FROM {LABELS} l LEFT JOIN predictions p ON p.predicted_label = l.label AND p.confidence >= 0.5 GROUP BY l.label"""))
def _(spark, d):
    out = scratch_path(spark, "abundance")
    schema = table(spark, d, "events").schema
    arriving = predictions_of(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"))
    stream.abundance_stream(
        arriving, ThresholdSpec(0.5, True), out, scratch_path(spark, "abundance-stream")
    ).awaitTermination()
    return stream.abundance_so_far(spark, out, CLASSES).withColumn(
        "fraction_of_accepted", F.round("fraction_of_accepted", 6)
    )
