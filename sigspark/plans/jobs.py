"""End-to-end jobs: validate, split, cache chunks, export, predict, calibrate and report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators import calibration as cal
from sigspark.operators import chunks as ch
from sigspark.operators import splits
from sigspark.operators.audit import (
    AuditResult,
    audit_manifest,
    require_isolated,
    require_unique_reads,
    tier_summary,
)
from sigspark.operators.bags import AttentionParams, LinearHead, encode_chunks, score_bags
from sigspark.operators.metrics import auroc, aurc, confidence_hist, confusion_wide
from sigspark.plans.cache import cache_chunks, require_profile, stored_chunks  # noqa: F401
from sigspark.session import own_stages
from sigspark.sources import files, sinks
from sigspark.sources.manifests import SPLITS, assert_manifest, read_manifest
from sigspark.sources.predictions import read_predictions
from sigspark.sources.signals import select_reads


def validate_manifest(spark: SparkSession, path: str) -> AuditResult:
    manifest = read_manifest(spark, path)
    if manifest.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    return audit_manifest(manifest)


def _store_split(selected: DataFrame, path: str, classes: Sequence[str], targets: Mapping[str, int]) -> DataFrame:
    """Write selected rows and check what was written: targets met, no duplicate read, no file in two splits."""
    selected.write.mode("overwrite").parquet(path)
    stored = selected.sparkSession.read.parquet(path)
    splits.require_targets(stored, classes, targets)
    require_isolated(require_unique_reads(stored, path), path)
    return tier_summary(stored)


@own_stages
def build_group_split(
    manifest: DataFrame, out: str, classes: Sequence[str], *, targets: Mapping[str, int], cap: int, seed: int,
    order: Sequence[str], features: DataFrame | None = None,
) -> DataFrame:
    """File-held-out split of a manifest; with ``features`` only reads that have a feature row take part."""
    if features is not None:
        manifest = select_reads(manifest, features, ["read_id"])
    assigned = splits.assign_groups(manifest, targets=targets, cap=cap, seed=seed)
    assigned.write.mode("overwrite").parquet(f"{out}/assignments")
    assigned = manifest.sparkSession.read.parquet(f"{out}/assignments")
    selected = splits.group_split(
        manifest, assigned, targets=targets, cap=cap, order=order, n_classes=len(classes)
    )
    return _store_split(selected, f"{out}/manifest", classes, targets)


@own_stages
def build_tier(
    manifest: DataFrame, out: str, classes: Sequence[str], *, targets: Mapping[str, int], seed: int, order: Sequence[str]
) -> DataFrame:
    """Balanced tier of a split manifest, reads taken from all files in turn; the old position is kept."""
    known = manifest.where(F.col("barcode").isin(*classes)).withColumn("source_split_order", F.col("split_order"))
    selected = splits.round_robin(known, targets=targets, seed=seed, order=order)
    return _store_split(selected, f"{out}/manifest", classes, targets)


def build_subsets(manifest: DataFrame, out: str, ordered: Sequence[str], *, k_min: int) -> DataFrame:
    """Nested class subsets, stored by class count, with their audit; a shared read or file or an empty cell is an error."""
    audit = splits.subset_audit(manifest, ordered, k_min)
    for row in audit.orderBy("class_count").collect():
        if row.read_overlap or row.file_overlap:
            raise ValueError(f"subset of {row.class_count} classes leaks between splits")
    splits.require_targets(manifest, ordered, {s: 1 for s in SPLITS})
    sinks.write_store(splits.nested_subsets(manifest, ordered, k_min), out, by="class_count")
    return audit


@own_stages
def export_benchmark(
    spark: SparkSession, benchmark: DataFrame, raw: DataFrame, chunks: DataFrame, out: str, *, max_chunks: int,
    profile_id: str,
) -> DataFrame:
    """Portable benchmark: manifest with re-based chunk pointers, at most ``max_chunks`` even picks per read, checksums.

    ``benchmark`` has split, split_order, barcode, label, read_id and ccf_file; ``raw`` has read_id and raw_n_chunks;
    ``chunks`` has read_id, chunk_index and chunk.
    """
    manifest = ch.export_benchmark(benchmark, raw, max_chunks=max_chunks, splits=SPLITS, profile_id=profile_id)
    manifest = manifest.withColumn("chunk_selection", F.lit("uniform_eval"))
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    manifest = spark.read.parquet(f"{out}/manifest")
    wanted = manifest.select("barcode", "read_id", "raw_chunk_start", F.col("source_n_chunks").alias("n_chunks"))
    picked = ch.pick_chunks(chunks.join(wanted, "read_id"), max_chunks)
    indices = ch.pick_indices(F.col("n_chunks"), max_chunks)
    at = F.col("raw_chunk_start") + F.array_position(indices, F.col("chunk_index")) - 1
    sinks.write_store(
        picked.select("barcode", "read_id", "chunk_index", at.alias("raw_chunk_at"), "chunk"), f"{out}/chunks", by="barcode"
    )
    expected = manifest.select("read_id", F.explode(ch.pick_indices(F.col("source_n_chunks"), max_chunks)).alias("chunk_index"))
    sinks.require_complete(expected, spark.read.parquet(f"{out}/chunks"), ["read_id", "chunk_index"])
    files.write_checksums(files.checksums(spark, f"{out}/chunks"), f"{out}/checksums")
    return tier_summary(manifest)


def predict(
    spark: SparkSession, chunks_path: str, out: str, head: LinearHead, classes: Sequence[str], *, dim: int,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, chunk_size: int | None = None,
    attention: AttentionParams | None = None, profile_id: str | None = None,
) -> DataFrame:
    """Score stored chunk embeddings, or stored raw chunks when an encoder is given.

    With ``profile_id`` the path is a store of :func:`cache_chunks`: its current chunks are scored, and a store of another
    normalisation than the model's is an error.
    """
    if profile_id is not None:
        require_profile(spark, chunks_path, profile_id)
        chunks = stored_chunks(spark, chunks_path)
    else:
        chunks = spark.read.parquet(chunks_path)
    if make_encoder is not None:
        chunks = encode_chunks(chunks, make_encoder, chunk_size=chunk_size)
    scored = score_bags(chunks, head, classes, dim=dim, keys=["read_id", "source_file"], attention=attention)
    scored.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def check_manifest(spark: SparkSession, path: str, classes: Sequence[str], profile_id: str | None = None) -> None:
    """Raise unless the raw manifest fits the classes and the preprocessing profile of a model."""
    assert_manifest(read_manifest(spark, path, kind="raw"), len(classes), profile_id).collect()


@own_stages
def calibrate(
    spark: SparkSession, predictions: str, out: str, classes: Sequence[str], settings: Mapping[str, float] | None = None,
    order_col: str = "read_id",
) -> cal.ThresholdSpec:
    """Choose a threshold on validation predictions.

    Writes the curve, the choice, the frozen threshold and how well confidence ranks correct reads above errors.
    """
    pred = read_predictions(spark, predictions)
    options = dict(settings or {})
    grid_size = options.pop("grid_size", 1001)
    limits = cal.Limits(**options)
    cal.risk_coverage(pred, classes, grid_size).write.mode("overwrite").parquet(f"{out}/curve")
    sinks.write_csv(auroc(pred), f"{out}/auroc")
    sinks.write_csv(aurc(pred, order_col), f"{out}/aurc")
    chosen = cal.select_operating_point(spark.read.parquet(f"{out}/curve"), limits)
    chosen.write.mode("overwrite").parquet(f"{out}/selected")
    spec = cal.threshold_spec(spark.read.parquet(f"{out}/selected"))
    spec.frame(spark).coalesce(1).write.mode("overwrite").json(f"{out}/threshold")
    return spec


@own_stages
def report(
    spark: SparkSession, predictions: str, out: str, classes: Sequence[str], spec: cal.ThresholdSpec,
    order_col: str = "read_id",
) -> None:
    """Composition of the accepted reads and, where the truth is known, metrics at full coverage and at the threshold."""
    pred = read_predictions(spark, predictions, require_truth=False)
    sinks.write_csv(cal.abundance(pred, classes, spec).orderBy("label"), f"{out}/abundance")
    labelled = "true_label" in pred.columns and pred.where("true_label IS NULL").isEmpty()
    if not labelled:
        sinks.write_csv(confidence_hist(pred.drop("true_label")).drop("correct"), f"{out}/confidence")
        return
    sinks.write_csv(cal.selective_report(pred, classes, spec), f"{out}/summary")
    sinks.write_csv(cal.per_class_selective(pred, classes, spec).orderBy("label"), f"{out}/per_class")
    sinks.write_csv(confusion_wide(pred.where(spec.accepts()), classes).orderBy("true_label"), f"{out}/confusion_matrix")
    sinks.write_csv(confidence_hist(pred), f"{out}/confidence")
    sinks.write_csv(auroc(pred), f"{out}/auroc")
    sinks.write_csv(aurc(pred, order_col), f"{out}/aurc")
