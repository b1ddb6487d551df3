"""The chunk store of a folder of signal files, exact when files change, shrink or go, and when settings change.

``chunks/run=<run>/file_id=<id>`` holds the windows that one call cut from one input file, ``ledger/run=<run>`` one row for
every input file that is stored after the call, ``commits/<n>`` the run that made version n. A call writes into a run of its own, then
its ledger, then the commit, a file that must not exist yet; chunks count only if the last committed ledger names their run for
their file. A call that is cut off thus leaves the store as it was, and of two calls at once the later one to finish is an error and
leaves nothing. What a call replaces is deleted by the next one, so that readers of the version before it can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.audit import require_unique_reads
from sigspark.operators.chunks import SignalProfile, build_chunks, read_status
from sigspark.operators.prefix import with_row_number, with_running_sums
from sigspark.session import create_exclusively, cut_lineage, discard, names_in, text_of
from sigspark.sources import files, sinks
from sigspark.sources.signals import SIGNAL_SCHEMA

COUNTERS = ("scanned", "eligible", "too_short", "invalid")
LEDGER = (
    "path string, size long, mtime timestamp, config_hash string, profile_id string, file_id string, run string, "
    + ", ".join(f"{c} long" for c in COUNTERS)
)
#: The order in which reads are taken up to a limit and numbered in the manifest.
ORDER = ["path", "source_file", "source_read_index", "read_id"]


def _scan_path() -> Column:
    """The path of a row's file as a listing writes it: not percent-encoded, one slash after ``file:``."""
    encoded = F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(encoded), "^file:/+", "file:/")


def _file_id(path: str) -> Column:
    """A letter comes first, so that no reader takes the folder name for a number."""
    return F.concat(F.lit("f"), F.substring(F.sha2(F.col(path), 256), 1, 20))


def _ledgers(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """The highest version number in use, and the runs of the last two committed versions, newest first."""
    numbers = sorted((int(n) for n in names_in(spark, f"{store}/commits") if n.isdigit()), reverse=True)
    runs: list[str] = []
    for n in numbers:
        # empty: its call was cut off inside the commit
        run = text_of(spark, f"{store}/commits/{n}")
        runs += [run] if run else []
        if len(runs) == 2:
            break
    return numbers[0] if numbers else 0, runs


def _ledger(spark: SparkSession, store: str, runs: Sequence[str]) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{store}/ledger/run={runs[0]}") if runs else spark.createDataFrame([], LEDGER)


def stored_files(spark: SparkSession, store: str) -> DataFrame:
    """The ledger of the last finished call: one row per stored input file, with its counters and its run."""
    store = store.rstrip("/")
    return _ledger(spark, store, _ledgers(spark, store)[1])


def _sweep(spark: SparkSession, store: str, old: DataFrame, used: DataFrame) -> None:
    """Delete what ``old`` names and ``used`` does not: whole runs where nothing of them is in use, else single files."""
    gone = old.select("run", "file_id").join(used.select("run", "file_id"), ["run", "file_id"], "left_anti")
    runs = gone.select("run").distinct()
    for row in runs.join(used.select("run").distinct(), "run", "left_anti").collect():
        discard(spark, f"{store}/chunks/run={row.run}")
    for row in gone.join(used.select("run").distinct(), "run", "left_semi").toLocalIterator():
        discard(spark, f"{store}/chunks/run={row.run}/file_id={row.file_id}")


def _chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    reads = spark.createDataFrame([], SIGNAL_SCHEMA).withColumns({"file_id": F.lit(""), "run": F.lit("")})
    made = build_chunks(reads, SignalProfile(), keep=["source_read_index", "file_id", "run"])
    names = [c for c in made.columns if c not in ("run", "file_id")]
    return spark.read.schema(made.select(*names, "run", "file_id").schema).parquet(path)


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The windows of the current files, with the run and the file they come from."""
    store = store.rstrip("/")
    known = stored_files(spark, store).select("run", "file_id")
    return _chunk_rows(spark, f"{store}/chunks").join(known, ["run", "file_id"], "left_semi")


def stored_reads(spark: SparkSession, store: str) -> DataFrame:
    """Manifest of the store: one row per read with its place over all files, chunk count, file and profile."""
    known = stored_files(spark, store).select("file_id", "path", F.col("profile_id").alias("preprocessing_profile_id"))
    counts = stored_chunks(spark, store).groupBy("file_id", "read_id").agg(
        F.first("source_file").alias("source_file"),
        F.first("source_read_index").alias("source_read_index"),
        F.count(F.lit(1)).alias("raw_n_chunks"),
    )
    placed = with_row_number(counts.join(known, "file_id"), [], ORDER, "split_order")
    return placed.withColumn("split_order", F.col("split_order") - 1).select(
        "split_order", "read_id", "path", "source_file", "source_read_index", "preprocessing_profile_id", "raw_n_chunks"
    )


def require_profile(spark: SparkSession, store: str, profile_id: str) -> None:
    """Raise unless every stored file was normalised with ``profile_id``."""
    others = stored_files(spark, store).where(F.col("profile_id") != profile_id).select("profile_id").distinct()
    found = sorted(r.profile_id for r in others.limit(3).collect())
    if found:
        raise ValueError(f"the store holds chunks of profile {', '.join(found)}, not {profile_id}")


def _up_to(index: DataFrame, room: int) -> DataFrame:
    """The reads that are looked at until ``room`` eligible ones are found, in the order of files and positions."""
    eligible = F.when(F.col("status") == "eligible", 1).otherwise(0)
    rows = with_running_sums(index, [], ORDER, {"upto": eligible})
    return rows.where(F.col("upto") - eligible < room).drop("upto")


def _used(reads: DataFrame, index: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``reads`` whose index row is in ``seen``; only the file in which the limit falls is joined row by row."""
    n = lambda rows, name: rows.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    files_ = cut_lineage(n(seen, "looked_at").join(n(index, "held"), "path"))
    whole = reads.join(files_.where("looked_at = held").select("path"), "path", "left_semi")
    edge = files_.where("looked_at < held").select("path").first()
    if edge is None:
        return whole.select(*reads.columns)
    keys = [reads[c].eqNullSafe(seen[c]) for c in ORDER[1:]]
    part = reads.where(F.col("path") == edge.path).join(seen.where(F.col("path") == edge.path), keys, "left_semi")
    return whole.select(*reads.columns).unionByName(part)


def cache_chunks(
    spark: SparkSession, input_dir: str, store: str, profile: SignalProfile, *, max_reads: int = 0,
    suffixes: Sequence[str] = (".parquet",),
) -> DataFrame:
    """Bring the store up to the files of a folder and return path and counters of the files done in this call.

    A file is done again unless the last ledger holds it with the same size, modification time and settings. Files that
    are gone leave the store. ``max_reads`` is a limit on the eligible reads of the whole store: files that are kept
    count first, the others are read in the order of their paths until it is reached; ``scanned`` counts the reads looked at
    on the way, and files beyond the limit are not entered. A read id that is eligible twice, in this call or in a kept
    file, is an error that leaves the store as it was.
    """
    store = store.rstrip("/")
    signature = files.config_hash({**asdict(profile), "max_reads": max_reads})
    found = files.discover(spark, input_dir, suffixes).select("path", "size", "mtime")
    version, runs = _ledgers(spark, store)
    before, earlier = _ledger(spark, store, runs), _ledger(spark, store, runs[1:])
    kept = cut_lineage(before.where(F.col("config_hash") == signature).join(found, ["path", "size", "mtime"], "left_semi"))
    todo = files.plan_incremental(found, kept.withColumn("status", F.lit("complete")), signature)
    room = max_reads - (kept.agg(F.sum("eligible")).first()[0] or 0) if max_reads else None
    # file metadata only, which the listing already holds on the driver
    entries = [] if max_reads and room <= 0 else todo.orderBy("path").collect()

    run = f"r{uuid.uuid4().hex}"
    target = f"{store}/chunks/run={run}"
    done = spark.createDataFrame([], LEDGER)
    if entries:
        reads = spark.read.schema(SIGNAL_SCHEMA).parquet(*[e.path for e in entries]).withColumn("path", _scan_path())
        index = cut_lineage(read_status(reads, profile).select(*ORDER, "status"))
        seen = index
        if max_reads:
            seen = cut_lineage(_up_to(index, room))
            reads = _used(reads, index, seen)
        chunks = build_chunks(reads.withColumn("file_id", _file_id("path")), profile, keep=["source_read_index", "file_id"])
        sinks.write_store(chunks, target, by="file_id")
        is_ = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
        counts = seen.groupBy("path").agg(F.count(F.lit(1)).alias("scanned"), *[is_(s) for s in COUNTERS[1:]])
        listed = spark.createDataFrame(entries, "path string, size long, mtime timestamp")
        # without a limit a file without a read is done as well
        done = cut_lineage(
            listed.join(counts, "path", "inner" if max_reads else "left").select(
                "path", "size", "mtime", F.lit(signature).alias("config_hash"), F.lit(profile.profile_id).alias("profile_id"),
                _file_id("path").alias("file_id"), F.lit(run).alias("run"),
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS],
            )
        )
        taken = seen.where("status = 'eligible'").select("read_id")
        try:
            old = kept.select("run", "file_id")
            held = _chunk_rows(spark, f"{store}/chunks").where("chunk_index = 0").join(old, ["run", "file_id"], "left_semi")
            require_unique_reads(taken.unionByName(held.select("read_id")), input_dir)
        except ValueError:
            discard(spark, target)
            raise
    if entries or not before.join(kept, ["run", "file_id"], "left_anti").isEmpty():
        kept.unionByName(done).write.parquet(f"{store}/ledger/run={run}")
        if not create_exclusively(spark, f"{store}/commits/{version + 1}", run):
            discard(spark, target)
            discard(spark, f"{store}/ledger/run={run}")
            raise RuntimeError(f"another call changed {store} meanwhile; nothing was stored")
        _sweep(spark, store, earlier, _ledger(spark, store, [run]).unionByName(before))
    return done.select("path", *COUNTERS)
