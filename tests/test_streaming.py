from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_io import PROFILE, signal_rows, write_signals

from sigspark.operators.bags import LinearHead, random_projection
from sigspark.operators.calibration import ThresholdSpec, abundance
from sigspark.session import discard
from sigspark.sources.signals import SIGNAL_SCHEMA
from sigspark.streaming import classify as stream
from sigspark.streaming.seen import SeenIds

CLASSES = ["a", "b", "c"]
HEAD = LinearHead(np.eye(3, 4), np.zeros(3))
ENCODER = random_projection(PROFILE.chunk_size, 4)


def start(spark, tmp_path, checkpoint, **options):
    query = stream.classify_stream(
        spark, str(tmp_path / "in"), ENCODER, HEAD, PROFILE, CLASSES, dim=4, out_dir=str(tmp_path / "out"),
        checkpoint=checkpoint, files_per_trigger=1, **options,
    )
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 15)
    write_signals(spark, tmp_path / "in", 15, start=15)
    checkpoint = stream.run_checkpoint(str(tmp_path / "cp"), {"profile": PROFILE})
    start(spark, tmp_path, checkpoint)
    counters = stream.file_counters(spark, str(tmp_path / "out"), checkpoint).collect()
    assert sum(c.scanned for c in counters) == 30 and sum(c.eligible for c in counters) == 30
    batches = lambda: {r.batch_id for r in spark.read.parquet(str(tmp_path / "out")).select("batch_id").distinct().collect()}
    assert batches() == {0, 1}

    write_signals(spark, tmp_path / "in", 5, start=30)
    again = start(spark, tmp_path, checkpoint)
    assert sum(p["numInputRows"] for p in again.recentProgress) == 5
    got = spark.read.parquet(str(tmp_path / "out"))
    reads = spark.read.schema(SIGNAL_SCHEMA).parquet(str(tmp_path / "in"))
    expected = stream.classify_reads(reads, ENCODER, HEAD, PROFILE, CLASSES, dim=4)
    key = lambda df: {r.read_id: (r.predicted_label, round(r.confidence, 9)) for r in df.collect()}
    assert got.count() == 35 and key(got) == key(expected)


def test_checkpoint_changes_with_the_settings():
    a = stream.run_checkpoint("/x", {"profile": PROFILE})
    assert a == stream.run_checkpoint("/x/", {"profile": PROFILE}) != stream.run_checkpoint("/x", {"profile": None})


def test_a_read_that_was_scored_before_stops_the_stream(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 6)
    checkpoint = str(tmp_path / "cp")
    start(spark, tmp_path, checkpoint)
    write_signals(spark, tmp_path / "in", 3, start=4)
    with pytest.raises(Exception, match="duplicate read_id"):
        start(spark, tmp_path, checkpoint)


def test_runs_with_other_settings_stay_apart(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 4)
    for name in ("one", "two"):
        start(spark, tmp_path, str(tmp_path / name))
        assert stream.classified(spark, str(tmp_path / "out"), str(tmp_path / name)).count() == 4


def test_unique_reads_over_files_of_any_age(spark, tmp_path):
    for start_at in (0, 5, 12):
        write_signals(spark, tmp_path / "in", 10, start=start_at)
    for age, path in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):
        os.utime(path, (time.time() - 14400 * age,) * 2)
    arriving = spark.readStream.schema(SIGNAL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ids = arriving.select("read_id")
    stream.unique_reads(ids).writeStream.format("parquet").option("path", str(tmp_path / "u")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = [r.read_id for r in spark.read.parquet(str(tmp_path / "u")).collect()]
    assert sorted(rows) == sorted({r[0] for r in signal_rows(22)})
    stream.arrivals(ids, str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    twice = {r.read_id: r.n for r in stream.repeated_reads(spark, str(tmp_path / "a")).collect()}
    assert twice == {f"r{i}": 2 for i in (5, 6, 7, 8, 9, 12, 13, 14)}


def test_running_composition_equals_batch(spark, tmp_path):
    schema = "read_id string, predicted_label int, confidence double"
    for part in range(3):
        rows = [(f"r{part}-{i}", (i * (part + 1)) % 2, (i % 10) / 10) for i in range(50)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    spec = ThresholdSpec(0.5, True)
    stream.abundance_stream(arriving, spec, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = stream.abundance_so_far(spark, str(tmp_path / "o"), CLASSES).orderBy("label").collect()
    expected = abundance(spark.read.parquet(str(tmp_path / "p")), CLASSES, spec).orderBy("label").collect()
    assert got == expected and [r.reads for r in got][2] == 0


def test_a_limit_stops_behind_the_last_read_it_allows(spark, tmp_path):
    for at in (0, 10, 20):
        write_signals(spark, tmp_path / "in", 10, start=at)
    start(spark, tmp_path, str(tmp_path / "cp"), max_reads=13)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    assert stream.classified(spark, out, checkpoint).count() == 13
    counters = stream.file_counters(spark, out, checkpoint).agg(F.sum("scanned"), F.sum("eligible")).first()
    assert tuple(counters) == (13, 13)
    report = stream.finish_stream(spark, out, checkpoint, CLASSES, ThresholdSpec(0.0, True))
    assert report.predictions.count() == 13 and report.composition.agg(F.sum("reads")).first()[0] == 13
    # a batch behind the limit and a later start with the same limit add nothing
    write_signals(spark, tmp_path / "in", 10, start=30)
    start(spark, tmp_path, checkpoint, max_reads=13)
    assert stream.classified(spark, out, checkpoint).count() == 13
    start(spark, tmp_path, str(tmp_path / "cp2"), max_reads=1000)
    assert stream.classified(spark, out, str(tmp_path / "cp2")).count() == 40


def test_a_run_without_eligible_reads_has_no_report(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 3)
    rows = spark.read.schema(SIGNAL_SCHEMA).parquet(str(tmp_path / "in")).withColumn("signal", F.slice("signal", 1, 1))
    rows.write.parquet(str(tmp_path / "short" / "in"))
    start(spark, tmp_path / "short", str(tmp_path / "cp"))
    with pytest.raises(ValueError, match="no eligible reads"):
        stream.finish_stream(spark, str(tmp_path / "short" / "out"), str(tmp_path / "cp"), CLASSES, ThresholdSpec(0.0, True))


def _ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "read_id string")


def test_seen_ids_are_found_in_any_earlier_batch(spark, tmp_path):
    rng, met = np.random.default_rng(1), set()
    # a capacity far below the number of ids: filters fill up, answers stay exact
    for capacity, name in ((1 << 17, "wide"), (64, "tight")):
        seen = SeenIds(spark, str(tmp_path / name), capacity, 1 << 16 if name == "wide" else 16)
        met = set()
        for batch in range(5):
            values = [f"r{i}" for i in rng.integers(0, 3000, 400)]
            expected = {v for v in values if v in met or values.count(v) > 1}
            assert {r.read_id for r in seen.add(_ids(spark, values), batch).collect()} == expected
            met |= set(values)
        # the last batch once more: its own ids are no repetition
        assert {r.read_id for r in seen.add(_ids(spark, ["new", "r0", None, None]), 4).collect()} <= {"r0", None}
    with pytest.raises(ValueError, match="duplicate read_id in here"):
        seen.require_new(_ids(spark, ["new"]), 5, "here")


def test_lost_filters_are_built_again(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path), 1000)
    for batch in range(3):
        assert seen.add(_ids(spark, [f"{batch}-{i}" for i in range(50)]), batch).count() == 0
    discard(spark, f"{tmp_path}/filters")
    assert {r.read_id for r in seen.add(_ids(spark, ["0-7", "x", "2-49"]), 3).collect()} == {"0-7", "2-49"}


def test_what_a_batch_shuffles_does_not_grow_with_the_run(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path), 1 << 18)
    written = []
    for batch in range(6):
        ids = _ids(spark, [f"{batch}-{i}" for i in range(2000)])
        before = shuffled_rows(spark)
        assert seen.add(ids, batch).count() == 0
        written.append(shuffled_rows(spark) - before)
    assert max(written[2:]) <= written[1] + 8 and written[-1] < 4 * 2000


def shuffled_rows(spark):
    """Shuffle records written by all stages so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(
        gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    )
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
