"""Small helper tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """Distance matrix from CSV as (src, dst, distance) rows."""
    return unpivot_distances(spark.read.option("header", True).csv(path))


def unpivot_distances(wide: DataFrame, label: str = "label") -> DataFrame:
    """Long form of a wide matrix; labels end at their first space."""
    columns = [c for c in wide.columns if c != label]
    typed = wide.select(label, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    first_word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    return typed.unpivot([label], columns, "dst", "distance").select(
        first_word(label).alias("src"), first_word("dst").alias("dst"), "distance"
    )
