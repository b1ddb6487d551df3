"""Connected components of a distributed list of links, and of a small one inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import scratch_path


def _stage(df: DataFrame, old: str | None = None) -> tuple[DataFrame, str]:
    """Written to the shared folder and read back; ``old`` is a stage that nothing needs any more."""
    spark = df.sparkSession
    path = scratch_path(spark, "components")
    df.write.parquet(path)
    if old:
        discard(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark, path: str) -> None:
    """Delete a staged table, through the file system that its path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another one; the component is its smallest node.

    Large-star and small-star steps by turns: each node hands its larger, then its smaller neighbours to the least node that
    it knows of, until every component is a star around its least node. Minima are map-side aggregates and neighbours are
    reached by joins, so a node with very many neighbours is no single row or task. Every round is written to the shared
    folder, the round before is deleted. Null ends are ignored.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current, path = _stage(pairs.select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, middle = _stage(large, path)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(smallest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current, path = _stage(handed.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), middle)
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state


def local_components(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every index below ``size`` the smallest index that it is connected to by the given links."""
    label = np.arange(size)
    while len(left):
        lower = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right):
            np.minimum.at(new, label[side], lower)
        new = new[new]
        if (new == label).all():
            break
        label = new
        open_links = label[left] != label[right]
        if not open_links.any():
            # flatten what is left of chains
            while (label[label] != label).any():
                label = label[label]
            break
        left, right = left[open_links], right[open_links]
    while (label[label] != label).any():
        label = label[label]
    return label
