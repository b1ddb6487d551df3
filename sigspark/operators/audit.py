"""Leakage and integrity audits of manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.metrics import merge_rows
from sigspark.sources.manifests import SPLITS, group_file, run_prefix

EXAMPLES = 10
KNOWN_SPLITS = (*SPLITS, "atlas")


@dataclass(frozen=True)
class AuditResult:
    """Independent lazy tables: a passing summary never pays for the examples."""

    summary: DataFrame
    counts: DataFrame
    examples: DataFrame


def crosses_splits(split: str) -> Column:
    """Whether a group has rows in more than one split.

    Two extremes differ exactly when there are two distinct values. The usual split names become small numbers and any
    other name its 64-bit hash, because aggregates over numbers stay in hash tables while those over strings are sorted.
    """
    code = F.xxhash64(split)
    for i, name in enumerate(KNOWN_SPLITS):
        code = F.when(F.col(split) == name, F.lit(i).cast("long")).otherwise(code)
    return F.min(code) != F.max(code)


def _examples(rows: DataFrame, value: Column, kind: str) -> DataFrame:
    first = rows.select(value.alias("example")).orderBy("example").limit(EXAMPLES)
    return first.select(F.lit(kind).alias("kind"), "example")


def audit_manifest(manifest: DataFrame, split: str = "split") -> AuditResult:
    """Duplicate read ids, and reads and (class, file) groups that appear in more than one split."""
    reads = manifest.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), crosses_splits(split).alias("leaks"))
    files = (
        manifest.select("barcode", group_file(manifest).alias("file"), split)
        .where("file IS NOT NULL")
        .groupBy("barcode", "file")
        .agg(crosses_splits(split).alias("leaks"))
    )
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    parts = [
        reads.agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("unique_reads"),
            flag(F.col("n") > 1).alias("duplicate_read_rows"),
            flag(F.col("leaks")).alias("read_id_split_leakage"),
        ),
        files.agg(flag(F.col("leaks")).alias("ccf_file_split_leakage")),
    ]
    clean = (
        (F.col("duplicate_read_rows") == 0)
        & (F.col("read_id_split_leakage") == 0)
        & (F.col("ccf_file_split_leakage") == 0)
    )
    summary = merge_rows(parts).withColumn("status", F.when(clean, F.lit("pass")).otherwise(F.lit("fail")))
    examples = (
        _examples(reads.where("n > 1"), F.col("read_id"), "duplicate_read_ids")
        .unionByName(_examples(reads.where("leaks"), F.col("read_id"), "read_id_leakage"))
        .unionByName(_examples(files.where("leaks"), F.concat_ws("/", "barcode", "file"), "ccf_file_leakage"))
    )
    return AuditResult(summary, split_class_counts(manifest, split), examples)


def split_class_counts(manifest: DataFrame, split: str = "split") -> DataFrame:
    """Rows per observed split x observed class, with zeros."""
    counts = manifest.groupBy(F.col(split).alias("split"), "barcode").agg(F.count(F.lit(1)).alias("n"))
    # splits x classes cells, both declared sets
    cells = counts.agg(
        F.collect_set("split").alias("splits"),
        F.collect_set("barcode").alias("classes"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("split", "barcode"), "n"))).alias("found"),
    )
    grid = cells.select(F.explode("splits").alias("split"), "classes", "found").select(
        "split", F.explode("classes").alias("barcode"), "found"
    )
    n = F.try_element_at("found", F.struct("split", "barcode"))
    return grid.select("split", "barcode", F.coalesce(n, F.lit(0)).alias("n"))


def audit_files(manifest: DataFrame, split: str = "split") -> DataFrame:
    """Per (class, file): size, the splits it appears in and whether it crosses splits."""
    splits = F.array_sort(F.collect_set(split))
    return manifest.groupBy("barcode", "ccf_file").agg(
        F.count(F.lit(1)).alias("read_count"), splits.alias("s")
    ).select(
        "barcode",
        "ccf_file",
        "read_count",
        F.size("s").alias("split_count"),
        F.array_join("s", "|").alias("splits"),
        (F.size("s") > 1).cast("int").alias("cross_split"),
        run_prefix(F.col("ccf_file")).alias("run_prefix"),
    )


def audit_classes(
    manifest: DataFrame, split: str = "split", splits: Sequence[str] = ("train", "atlas", "val", "test")
) -> DataFrame:
    """Per class: files, crossing files and reads by split."""
    in_split = {s: F.sum((F.col(split) == s).cast("long")).alias(f"{s}_reads") for s in splits}
    per_file = manifest.groupBy("barcode", "ccf_file").agg(crosses_splits(split).alias("crosses"), *in_split.values())
    per_class = per_file.groupBy("barcode").agg(
        F.count(F.lit(1)).alias("ccf_files"),
        F.sum(F.col("crosses").cast("long")).alias("files_crossing_splits"),
        *[F.sum(f"{s}_reads").alias(f"{s}_reads") for s in splits],
    )
    return per_class.withColumn(
        "crossing_fraction", F.col("files_crossing_splits") / F.greatest(F.lit(1), F.col("ccf_files"))
    )


def audit_runs(manifest: DataFrame) -> DataFrame:
    """The classes that share a run (file-name prefix)."""
    return manifest.groupBy(run_prefix(F.col("ccf_file")).alias("run_prefix")).agg(
        F.array_join(F.array_sort(F.collect_set("barcode")), "|").alias("classes")
    )


def audit_protocol(manifest: DataFrame, order: Sequence[str], split: str = "split") -> DataFrame:
    """One row: duplicates, reads whose later rows change split, and files that cross splits."""
    reads = (
        manifest.groupBy("read_id", split)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_at"))
        .groupBy("read_id")
        .agg(F.sum("n").alias("n"), F.min_by("n", "first_at").alias("in_first_split"))
    )
    files = manifest.groupBy("barcode", "ccf_file").agg(crosses_splits(split).alias("crosses"))
    parts = [
        reads.agg(
            F.sum("n").alias("total_rows"),
            F.count(F.lit(1)).alias("unique_read_ids"),
            F.sum(F.col("n") - 1).alias("duplicate_read_rows"),
            F.sum(F.col("n") - F.col("in_first_split")).alias("inconsistent_read_splits"),
        ),
        files.agg(
            F.count(F.lit(1)).alias("files"), F.sum(F.col("crosses").cast("long")).alias("files_crossing_splits")
        ),
    ]
    return merge_rows(parts).withColumn(
        "cross_split_fraction", F.col("files_crossing_splits") / F.greatest(F.lit(1), F.col("files"))
    )


def split_overlap(manifest: DataFrame, split: str = "split") -> DataFrame:
    """Read ids and (class, file) groups shared by each pair of splits."""

    def shared(keys: Sequence[str], kind: str) -> DataFrame:
        present = {s: F.max((F.col(split) == s).cast("int")) for s in SPLITS}
        rows = manifest.groupBy(*keys).agg(*[c.alias(s) for s, c in present.items()])
        pairs = [("train", "val"), ("train", "test"), ("val", "test")]
        both = [
            F.coalesce(F.sum((F.col(a) * F.col(b)).cast("long")), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs
        ]
        return rows.agg(*both).select(F.lit(kind).alias("kind"), "*")

    return shared(["read_id"], "reads").unionByName(shared(["barcode", "ccf_file"], "files"))


def require_isolated(rows: DataFrame, what: str) -> DataFrame:
    """Raise when a read or a (class, file) group is in two splits."""
    shared = {r.kind: r.train_val + r.train_test + r.val_test for r in split_overlap(rows).collect()}
    if any(shared.values()):
        raise ValueError(f"{what} leaks between splits: {shared}")
    return rows


def duplicate_reads(rows: DataFrame) -> DataFrame:
    """Read ids that occur more than once."""
    return rows.groupBy("read_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique_reads(rows: DataFrame, what: str) -> DataFrame:
    repeated = duplicate_reads(rows).orderBy("read_id").limit(3).collect()
    if repeated:
        raise ValueError(f"duplicate read_id in {what}: {[r.read_id for r in repeated]}")
    return rows


def tier_summary(rows: DataFrame, split: str = "split") -> DataFrame:
    """Reads and distinct source files per split and class."""
    return (
        rows.groupBy(F.col(split).alias("split"), "barcode", "ccf_file")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("split", "barcode")
        .agg(F.sum("n").alias("n_reads"), F.count("ccf_file").alias("n_files"))
    )


def missing_cells(rows: DataFrame, classes: Sequence[str], targets: Mapping[str, int]) -> DataFrame:
    """Expected (class, split) cells that hold fewer rows than their target."""
    spark = rows.sparkSession
    expected = spark.createDataFrame(
        [(c, s, int(t)) for c in classes for s, t in targets.items()], "barcode string, split string, target long"
    )
    found = rows.groupBy("barcode", "split").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return (
        expected.join(found, ["barcode", "split"], "left")
        .where(n < F.col("target"))
        .select("barcode", "split", (F.col("target") - n).alias("missing"))
    )
