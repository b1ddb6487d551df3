"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Bytes of text that a mapper works on at a time; a longer text is a slice by itself.
SLICE = 1 << 21


def sliced(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``most`` bytes in its column ``text``; without such a column, the batch."""
    if "text" not in batch.schema.names:
        yield batch
        return
    stops = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = stops[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """An Arrow mapper that applies ``function`` to every batch that has rows, a slice of bounded text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from map(function, sliced(batch))

    return run


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, exclude: Column, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` labelled documents of each class, and how many of each class may be learnt from.

    The sample is the rows with the smallest hashed ids, so it is the same on every partitioning. ``exclude`` is a condition
    on ``doc_id`` for rows that labels must not be learnt from. Rows without an id or a label do not count; a document
    labelled more than once takes its largest label.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~exclude)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = None
    for y in sorted(counts):
        some = usable.where(F.col("y") == y).orderBy(*order).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = usable
    # at most 2 x per_class ids
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").drop_duplicates(["doc_id"])
    return rows.select("text", "y"), counts
