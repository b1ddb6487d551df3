from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sigspark.operators import calibration as cal
from sigspark.operators.bags import LinearHead, random_projection
from sigspark.operators.chunks import SignalProfile, build_chunks
from sigspark.plans import cache, jobs
from sigspark.sources import files, manifests, predictions, signals, sinks, tables

import numpy as np

CLASSES = [f"c{i}" for i in range(9)]
PROFILE = SignalProfile("mad", discard_first=2, chunk_size=8, overlap=4)


def signal_rows(n, start=0):
    return [(f"r{i}", f"f{i % 3}", i, [(i * 7 + j * j) % 97 for j in range(20 + i % 5)], 1.0, 0.5, None, None, None, None)
            for i in range(start, start + n)]


def write_signals(spark, path, n, start=0):
    spark.createDataFrame(signal_rows(n, start), signals.SIGNAL_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_inventory_counts_signal_files_by_first_folder(spark, tmp_path):
    for name, size in (("one/a.ccf5", 4), ("one/deep/b b+.BLOW5", 6), ("one/e e.ccf5", 0), ("c.slow5", 1), ("two/notes.txt", 9)):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)
    rows = {r.group: (r.files, r.bytes, r.extensions) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert rows == {"one": (3, 10, [".blow5", ".ccf5"]), "root": (1, 1, [".slow5"])}
    plan = files.inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "two"))


def test_checksums(spark, tmp_path):
    (tmp_path / "mini").mkdir()
    (tmp_path / "mini" / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    sums = files.checksums(spark, str(tmp_path))
    assert {r.path: (r.sha256, r["size"]) for r in sums.collect()} == {
        "mini/a.bin": (hashlib.sha256(b"abc").hexdigest(), 3), "b.bin": (hashlib.sha256(b"").hexdigest(), 0)
    }
    assert {r.tier: (r.files, r.payload_bytes) for r in files.handoff_summary(sums).collect()} == {"mini": (1, 3), "root": (1, 0)}
    files.write_checksums(sums, str(tmp_path / "sums"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "sums")).collect()]
    assert f"{hashlib.sha256(b'abc').hexdigest()}  mini/a.bin" in lines


def test_a_file_above_two_gigabytes_is_hashed_in_blocks(spark, tmp_path):
    big = tmp_path / "in" / "big file.bin"
    big.parent.mkdir()
    with big.open("wb") as out:
        out.truncate(3 * 2**30)
    wanted = hashlib.sha256()
    for _ in range(3 * 2**30 >> 24):
        wanted.update(bytes(1 << 24))
    row = files.checksums(spark, str(big.parent)).first()
    assert (row.sha256, row.path, row["size"]) == (wanted.hexdigest(), "big file.bin", 3 * 2**30)


def test_files_behind_a_limit_are_never_opened(spark, tmp_path):
    for part in range(5):
        rows = spark.createDataFrame(signal_rows(10, start=10 * part), signals.SIGNAL_SCHEMA)
        short = F.when(F.col("source_read_index") % 4 == 0, F.slice("signal", 1, 2)).otherwise(F.col("signal"))
        rows.withColumn("signal", short).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    (tmp_path / "in" / "p3").mkdir(exist_ok=True)
    for part in (3, 4):  # groups are one, two and four files; the limit falls into the second group
        for file in (tmp_path / "in" / f"p{part}").glob("*.parquet"):
            file.write_bytes(b"not a table")
    eligible = [i for i in range(50) if i % 4]
    for limit in (0, 1, 7, 8, 12, 20):
        got = signals.first_eligible(spark, str(tmp_path / "in"), PROFILE, limit)
        assert sorted(r.source_read_index for r in got.collect()) == eligible[:limit]
    with pytest.raises(Exception, match="not a Parquet file|PARQUET|FAILED_READ_FILE"):
        signals.first_eligible(spark, str(tmp_path / "in"), PROFILE, 40).count()


def test_select_and_missing_reads(spark):
    rows = spark.createDataFrame([("f", "a"), ("f", "a"), ("g", "b")], "source_file string, read_id string")
    wanted = spark.createDataFrame([("f", "a", 1), ("f", "b", 1), ("f", "b", 2)], "source_file string, read_id string, x int")
    assert signals.select_reads(rows, wanted).count() == 2
    assert [tuple(r) for r in signals.missing_reads(wanted, rows).collect()] == [("f", "b")]
    assert signals.select_reads(rows, wanted, ["read_id"]).count() == 3


def test_manifest_reader(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("split,split_order,barcode,label,read_id,raw_chunk_path,raw_chunk_start,raw_n_chunks\n"
                    "train,0,a,0,r0,chunks/a.npy,0,4\nextra,1,a,0,r1,chunks/a.npy,4,4\nval,0,a,0,r2,/abs/a.npy,8,4\n")
    rows = {r.read_id: r for r in manifests.read_manifest(spark, str(path), kind="raw").collect()}
    assert set(rows) == {"r0", "r2"}
    assert rows["r0"].raw_chunk_path == f"{tmp_path}/chunks/a.npy" and rows["r2"].raw_chunk_path == "/abs/a.npy"
    assert rows["r0"].label == 0 and rows["r0"].raw_n_chunks == 4 and rows["r0"].ccf_file is None
    with pytest.raises(ValueError, match="bag manifest is missing columns"):
        manifests.read_manifest(spark, str(path), kind="bag")
    assert jobs.validate_manifest(spark, str(path)).summary.first().rows == 3


def test_manifest_assertions(spark):
    df = spark.createDataFrame([(0, "p"), (2, "p")], "label int, preprocessing_profile_id string")
    assert manifests.assert_manifest(df, 3, "p").first()["rows"] == 2
    for rows, n, profile, message in (
        (df.where("false"), 3, None, "empty"), (df, 2, None, "outside the declared classes"),
        (df.union(spark.createDataFrame([(1, "q")], df.schema)), 3, None, "mixes"), (df, 3, "q", "another preprocessing"),
    ):
        with pytest.raises(Exception, match=message):
            manifests.assert_manifest(rows, n, profile).collect()


def test_group_file_falls_back_to_the_second_column(spark):
    df = spark.createDataFrame([("x/a.ccf5", "b"), ("", "y/b.ccf5"), (None, "")], "ccf_file string, source_ccf_file string")
    assert [r.g for r in df.select(manifests.group_file(df).alias("g")).collect()] == ["a.ccf5", "b.ccf5", None]


def test_distance_matrix_reader(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("label,A x,B y\nA x,0,0.5\nB y,0.5,0\n")
    rows = {(r.src, r.dst): r.distance for r in tables.read_distances(spark, str(path)).collect()}
    assert rows == {("A", "A"): 0.0, ("A", "B"): 0.5, ("B", "A"): 0.5, ("B", "B"): 0.0}


def test_chunk_cache_skips_finished_files(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    write_signals(spark, source, 20)
    first = jobs.cache_chunks(spark, str(source), store, PROFILE)
    assert sum(r.eligible for r in first.collect()) == 20
    assert jobs.cache_chunks(spark, str(source), store, PROFILE).count() == 0
    write_signals(spark, source, 10, start=20)
    again = jobs.cache_chunks(spark, str(source), store, PROFILE)
    assert sum(r.scanned for r in again.collect()) == 10
    stored = spark.read.parquet(f"{store}/chunks")
    expected = build_chunks(spark.read.parquet(str(source)), PROFILE)
    key = ["read_id", "chunk_index"]
    assert stored.count() == expected.count() and sinks.missing_rows(expected, stored, key).isEmpty()
    # other settings make every file stale and replace its chunks
    longer = SignalProfile("mad", discard_first=2, chunk_size=12, overlap=4)
    assert sum(r.scanned for r in jobs.cache_chunks(spark, str(source), store, longer).collect()) == 30
    sizes = cache.stored_chunks(spark, store).select(F.size("chunk").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [12]


def test_chunk_cache_rejects_a_read_in_two_files(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 5)
    write_signals(spark, tmp_path / "in", 5)
    with pytest.raises(ValueError, match="duplicate read_id"):
        jobs.cache_chunks(spark, str(tmp_path / "in"), str(tmp_path / "store"), PROFILE)


def put(spark, path, rows):
    spark.createDataFrame(rows, signals.SIGNAL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(path))


def in_store(spark, store):
    return {r.read_id: r.raw_n_chunks for r in cache.stored_reads(spark, str(store)).collect()}


def test_chunk_cache_forgets_what_shrank_or_went(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    rows = signal_rows(6)
    put(spark, source / "a", rows[:3])
    put(spark, source / "b", rows[3:])
    jobs.cache_chunks(spark, str(source), str(store), PROFILE)
    assert set(in_store(spark, store)) == {f"r{i}" for i in range(6)}
    put(spark, source / "a", [(*r[:3], r[3][:5], *r[4:]) for r in rows[:3]])
    done = jobs.cache_chunks(spark, str(source), str(store), PROFILE).collect()
    assert [(r.scanned, r.eligible, r.too_short, r.invalid) for r in done] == [(3, 0, 3, 0)]
    assert set(in_store(spark, store)) == {"r3", "r4", "r5"}
    for p in (source / "a").iterdir():
        p.unlink()
    assert jobs.cache_chunks(spark, str(source), str(store), PROFILE).count() == 0
    assert cache.stored_files(spark, str(store)).count() == 1


def test_chunk_cache_redoes_settings_that_come_back(spark, tmp_path):
    put(spark, tmp_path / "in" / "a", signal_rows(4))
    store = str(tmp_path / "store")
    longer = SignalProfile("mad", discard_first=2, chunk_size=12, overlap=4)
    for profile in (PROFILE, longer, PROFILE):
        assert jobs.cache_chunks(spark, str(tmp_path / "in"), store, profile).first().eligible == 4
    sizes = cache.stored_chunks(spark, store).select(F.size("chunk").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [8]
    with pytest.raises(ValueError, match="profile mad, not sclamp"):
        jobs.predict(spark, store, str(tmp_path / "p"), None, CLASSES, dim=4, profile_id="sclamp")


def test_chunk_cache_rejects_a_read_of_an_earlier_call(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    put(spark, source / "a", signal_rows(3))
    jobs.cache_chunks(spark, str(source), str(store), PROFILE)
    put(spark, source / "b", signal_rows(3, start=2))
    with pytest.raises(ValueError, match="duplicate read_id"):
        jobs.cache_chunks(spark, str(source), str(store), PROFILE)
    assert set(in_store(spark, store)) == {"r0", "r1", "r2"}


def test_chunk_cache_keeps_its_limit_over_calls(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    rows = [(*r[:1], "f", *r[2:]) for r in signal_rows(6)]
    put(spark, source / "a", [(*rows[0][:3], rows[0][3][:5], *rows[0][4:]), *rows[1:3]])
    limited = lambda: jobs.cache_chunks(spark, str(source), str(store), PROFILE, max_reads=3).collect()
    assert [(r.scanned, r.eligible, r.too_short) for r in limited()] == [(3, 2, 1)]
    put(spark, source / "b", rows[3:])
    assert [(r.scanned, r.eligible) for r in limited()] == [(1, 1)]
    put(spark, source / "c", signal_rows(2, start=9))
    assert limited() == [] and set(in_store(spark, store)) == {"r1", "r2", "r3"}


def test_jobs_leave_no_staged_tables(spark, tmp_path):
    from sigspark.session import shared_dir

    rows = [(f"r{i}", i % 2, (i + i // 7) % 2, 0.5 + (i % 40) / 100) for i in range(200)]
    df = spark.createDataFrame(rows, "read_id string, true_label int, predicted_label int, confidence double")
    path = str(tmp_path / "p")
    df.write.parquet(path)
    folder = shared_dir(spark).removeprefix("file:")
    staged = lambda: {p for p in os.listdir(folder) if p.startswith("stage-")}
    before = staged()
    spec = jobs.calibrate(spark, path, str(tmp_path / "cal"), ["a", "b"])
    jobs.report(spark, path, str(tmp_path / "report"), ["a", "b"], spec)
    assert staged() == before
    assert spark.read.option("header", True).csv(str(tmp_path / "cal" / "auroc")).count() == 1


def test_of_two_calls_at_once_the_later_one_stores_nothing(spark, tmp_path, monkeypatch):
    write_signals(spark, tmp_path / "in", 6)
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    write, calls = cache.sinks.write_store, []

    def while_another_call_runs(*args, **options):
        write(*args, **options)
        if not calls:
            calls.append(1)
            cache.cache_chunks(spark, source, store, PROFILE)

    monkeypatch.setattr(cache.sinks, "write_store", while_another_call_runs)
    with pytest.raises(RuntimeError, match="another call changed"):
        cache.cache_chunks(spark, source, store, PROFILE)
    monkeypatch.undo()
    assert cache.stored_reads(spark, store).count() == 6
    assert len(list((tmp_path / "store" / "chunks").glob("run=*"))) == 1
    # cut off inside a commit: the version counts as unused
    (tmp_path / "store" / "commits" / "2").write_text("")
    write_signals(spark, tmp_path / "in", 2, start=6)
    cache.cache_chunks(spark, source, store, PROFILE)
    assert cache.stored_reads(spark, store).count() == 8


def test_replaced_chunks_stay_for_one_more_version(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 6)
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    cache.cache_chunks(spark, source, store, PROFILE)
    reader = cache.stored_chunks(spark, store)
    before = reader.count()
    runs = lambda: len(list((tmp_path / "store" / "chunks").glob("run=*")))
    cache.cache_chunks(spark, source, store, PROFILE, max_reads=2)
    assert reader.count() == before and runs() == 2 and cache.stored_reads(spark, store).count() == 2
    cache.cache_chunks(spark, source, store, PROFILE, max_reads=3)
    assert runs() == 2 and cache.stored_reads(spark, store).count() == 3


def test_prediction_from_stored_chunks(spark, tmp_path):
    write_signals(spark, tmp_path / "in", 12)
    jobs.cache_chunks(spark, str(tmp_path / "in"), str(tmp_path / "store"), PROFILE)
    head = LinearHead(np.eye(3, 4), np.zeros(3))
    rows = jobs.predict(
        spark, str(tmp_path / "store" / "chunks"), str(tmp_path / "out"), head, CLASSES[:3], dim=4,
        make_encoder=random_projection(8, 4), chunk_size=8,
    )
    assert rows.count() == 12 and all(len(r.probabilities) == 3 for r in rows.collect())


def test_benchmark_export(spark, tmp_path):
    """54 reads of 4 chunks each, 3 of them exported."""
    from test_splits import MANIFEST, packaged

    from sigspark.operators import splits

    source = spark.createDataFrame(packaged(), MANIFEST)
    tier = splits.round_robin(source, targets={"train": 2, "val": 2, "test": 2}, seed=42, order=["split_order"])
    raw = source.select("read_id", F.lit(4).alias("raw_n_chunks"))
    chunks = source.select("read_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_index")).withColumn(
        "chunk", F.array_repeat(F.col("chunk_index").cast("float"), 8)
    )
    out = str(tmp_path / "bench")
    jobs.export_benchmark(spark, tier, raw, chunks, out, max_chunks=3, profile_id="mad")
    manifest = spark.read.parquet(f"{out}/manifest")
    assert {r.split: r["count"] for r in manifest.groupBy("split").count().collect()} == {"train": 18, "val": 18, "test": 18}
    stored = spark.read.parquet(f"{out}/chunks")
    assert stored.count() == 162 and {r.chunk_index for r in stored.select("chunk_index").distinct().collect()} == {0, 1, 3}
    for rows in stored.groupBy("barcode").agg(F.array_sort(F.collect_list("raw_chunk_at")).alias("at")).collect():
        assert rows["at"] == list(range(18))
    assert spark.read.text(f"{out}/checksums").count() >= 9
    with pytest.raises(ValueError, match="incomplete"):
        jobs.export_benchmark(spark, tier, raw, chunks.where("chunk_index < 3"), out, max_chunks=3, profile_id="mad")


def prediction_csv(path, truth=True):
    lines = ["read_id,true_label,pred_label,confidence" if truth else "read_id,pred_label,confidence"]
    for i in range(90):
        ok = i % 5 != 0
        p = i % 9 if ok else (i % 9 + 1) % 9
        lines.append(f"r{i},{i % 9},{p},{0.9 if ok else 0.2}" if truth else f"r{i},{p},{0.9 if ok else 0.2}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_calibrate_then_report(spark, tmp_path):
    path = prediction_csv(tmp_path / "val.csv")
    spec = jobs.calibrate(spark, path, str(tmp_path / "cal"), CLASSES)
    assert spec.enabled and spec.threshold > 0.2
    assert cal.ThresholdSpec.read(spark, str(tmp_path / "cal" / "threshold")) == spec
    jobs.report(spark, path, str(tmp_path / "report"), CLASSES, spec)
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "report" / name))
    assert read("summary").first().accepted_reads == "72"
    assert read("abundance").count() == 9 and read("per_class").count() == 9 and read("confusion_matrix").count() == 9
    assert float(read("auroc").first().auroc) == 1.0


def test_report_without_truth(spark, tmp_path):
    path = prediction_csv(tmp_path / "new.csv", truth=False)
    jobs.report(spark, path, str(tmp_path / "report"), CLASSES, cal.ThresholdSpec(0.0, False))
    rows = spark.read.option("header", True).csv(str(tmp_path / "report" / "confidence")).collect()
    assert sum(int(r.reads) for r in rows) == 90


def test_evaluation_tables_and_wide_predictions(spark, tmp_path):
    pred = predictions.read_predictions(spark, prediction_csv(tmp_path / "p.csv"))
    sinks.save_evaluation(pred, CLASSES, str(tmp_path / "eval"))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "eval" / name))
    assert read("predictions").count() == 90 and read("metrics").count() == 1
    assert read("confusion_matrix").columns == ["true_label", *[f"pred_{i}" for i in range(9)]]
    probs = spark.createDataFrame([("r", 1, [0.25, 0.75])], "read_id string, predicted_label int, probabilities array<double>")
    sinks.write_predictions(probs, ["x", "y"], str(tmp_path / "wide"))
    row = spark.read.option("header", True).csv(str(tmp_path / "wide")).first()
    assert (row.prob_0, row.prob_1, row.prob_x, row.prob_y) == ("0.25", "0.75", "0.25", "0.75")


def test_runs_need_validation_rows(spark, tmp_path):
    rows = [(0, "val", "a", 0, 0, 0.5), (1, "test", "a", 0, 0, 0.5)]
    schema = "run_id int, split string, read_id string, true_label int, predicted_label int, confidence double"
    spark.createDataFrame(rows, schema).write.partitionBy("run_id").parquet(str(tmp_path / "runs"))
    with pytest.raises(ValueError, match=r"runs without validation rows: \[1\]"):
        predictions.read_run_predictions(spark, str(tmp_path / "runs"))


def test_store_is_complete_or_raises(spark, tmp_path):
    df = spark.range(10).selectExpr("concat('r', id) AS read_id", "id % 2 AS part")
    sinks.write_store(df.where("id < 8"), str(tmp_path / "s"), by="part", rows_per_file=2)
    with pytest.raises(ValueError, match="incomplete"):
        sinks.require_complete(df, spark.read.parquet(str(tmp_path / "s")), ["read_id"])


def test_binary_read_ids_are_decoded(spark, tmp_path):
    spark.createDataFrame([(bytearray(b"abc"),)], "read_id binary").write.parquet(str(tmp_path / "b"))
    assert signals.read_signals(spark, str(tmp_path / "b")).first().read_id == "abc"
