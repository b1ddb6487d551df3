"""Writers for chunk and embedding stores, predictions and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators.metrics import class_metrics, class_summary, confusion_wide
from sigspark.session import exists
from sigspark.sources.predictions import name_predictions, wide_probabilities


def write_store(rows: DataFrame, path: str, *, by: str, rows_per_file: int = 100_000) -> None:
    """Parquet partitioned by ``by`` with bounded files; only the partitions present in ``rows`` are replaced.

    The rebalance hint gathers the rows of a small partition in one task and splits a large one over many.
    """
    (
        rows.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(by)
        .parquet(path)
    )


def read_store(rows: DataFrame, path: str) -> DataFrame:
    """The store at ``path`` that :func:`write_store` made of ``rows``; one of no rows holds no file to infer a schema from."""
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)


def missing_rows(expected: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(stored, list(keys), "left_anti")


def require_complete(expected: DataFrame, stored: DataFrame, keys: Sequence[str]) -> None:
    """Raise unless the store holds every expected key."""
    examples = missing_rows(expected, stored, keys).select(*keys).limit(3).collect()
    if examples:
        raise ValueError(f"store is incomplete, for example {[tuple(r) for r in examples]}")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(pred: DataFrame, classes: Sequence[str], path: str) -> None:
    """CSV prediction table with one probability column per class index and per class name."""
    write_csv(wide_probabilities(pred, classes), path)


def save_evaluation(pred: DataFrame, classes: Sequence[str], path: str) -> None:
    """Metrics, named predictions, confusion matrix and per-class table of one evaluation."""
    write_csv(class_summary(pred, classes), f"{path}/metrics")
    named = name_predictions(pred, classes)
    simple = [c for c, t in named.dtypes if not t.startswith(("array", "map", "struct"))]
    write_csv(named.select(*simple), f"{path}/predictions")
    write_csv(confusion_wide(pred, classes).orderBy("true_label"), f"{path}/confusion_matrix")
    write_csv(class_metrics(pred, classes).orderBy("label"), f"{path}/per_class_metrics")
