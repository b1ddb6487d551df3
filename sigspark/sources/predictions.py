"""Reading, checking and naming prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.metrics import class_name, is_correct
from sigspark.sources.manifests import require_columns


def read_predictions(spark: SparkSession, path: str, *, require_truth: bool = True) -> DataFrame:
    """Prediction table from CSV (header) or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.parquet(path)
    rows = normalize_predictions(rows, require_truth=require_truth)
    if rows.isEmpty():
        raise ValueError(f"prediction table is empty: {path}")
    return rows


def normalize_predictions(rows: DataFrame, *, require_truth: bool = True) -> DataFrame:
    """Accept the short name ``pred_label``, check the required columns and fix their types."""
    if "predicted_label" not in rows.columns and "pred_label" in rows.columns:
        rows = rows.withColumnRenamed("pred_label", "predicted_label")
    need = ["true_label", "predicted_label", "confidence"] if require_truth else ["read_id", "predicted_label", "confidence"]
    require_columns(rows, need, "prediction table")
    types = {"true_label": "int", "predicted_label": "int", "confidence": "double"}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in rows.columns})


def read_run_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of many runs, stored partitioned by ``run_id``; every run must have validation rows."""
    rows = normalize_predictions(spark.read.parquet(path))
    require_columns(rows, ["run_id", "split", "read_id"], "run predictions")
    runs = rows.groupBy("run_id").agg(F.max((F.col("split") == "val").cast("int")).alias("has_val"))
    missing = runs.where("has_val = 0").orderBy("run_id").limit(10).collect()
    if missing:
        raise ValueError(f"runs without validation rows: {[r.run_id for r in missing]}")
    return rows


def name_predictions(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add class names and the correct flag."""
    return pred.withColumns(
        {
            "true_species": class_name(F.col("true_label"), classes),
            "predicted_species": class_name(F.col("predicted_label"), classes),
            "correct": is_correct().cast("int"),
        }
    )


def attach_groups(pred: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the source file of every read; a read that the manifest lacks is an error at run time."""
    # grouped on the join key, so the join needs no further shuffle
    known = manifest.groupBy("read_id").agg(
        F.min("ccf_file").alias("ccf_file"), (F.min("ccf_file") != F.max("ccf_file")).alias("ambiguous")
    )
    absent = F.concat(F.lit("read is missing from the manifest: "), F.col("read_id"))
    twice = F.concat(F.lit("read has several files in the manifest: "), F.col("read_id"))
    checked = (
        F.when(F.col("ccf_file").isNull(), F.raise_error(absent).cast("string"))
        .when(F.col("ambiguous"), F.raise_error(twice).cast("string"))
        .otherwise(F.col("ccf_file"))
    )
    return pred.join(known, "read_id", "left").withColumn("ccf_file", checked).drop("ambiguous")


def wide_probabilities(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Spread the ``probabilities`` array to ``prob_<i>`` and ``prob_<name>`` columns for the file sink."""
    by_index = {f"prob_{i}": F.get("probabilities", i) for i in range(len(classes))}
    by_name = {f"prob_{c}": F.get("probabilities", i) for i, c in enumerate(classes)}
    return pred.withColumns({**by_index, **by_name}).drop("probabilities")
