"""Which ids a run has met before: a store of ids in hash buckets with one Bloom filter per bucket.

A batch shuffles its own ids and one filter per bucket, never the ids of earlier batches: buckets meet their filter in a task,
which says which ids may have come before and hands on the filter with the new ids added. Only the buckets of those few ids are then
read from the stored ids, which are sorted by bucket so that the scan skips the rest. The answer is exact: a filter
never misses an id, and what it wrongly suspects is looked up.

The filters have a fixed total size, which ``capacity`` sets. Beyond it they let more ids through to the look-up; nothing is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import discard, exists

#: Ids per bucket at capacity, bits per id and bits set per id: about one id in a million is suspected wrongly.
BUCKET_IDS, BITS_PER_ID, PROBES = 1 << 16, 32, 12
IDS = "read_id string, n long, h1 long, h2 long, bucket int, batch_id long"
FOUND = "bucket int, read_id string, bits binary"


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """ids x probes: double hashing of two 64-bit hashes."""
    step = (h1.view(np.uint64) >> np.uint64(20)) | np.uint64(1)
    return ((h2.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class SeenIds:
    """The ids below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, capacity: int = 10_000_000, bucket_ids: int = BUCKET_IDS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = max(1, math.ceil(capacity / bucket_ids))
        self.bits = bucket_ids * BITS_PER_ID

    def _stored(self, before: int) -> DataFrame:
        return self.spark.read.schema(IDS).parquet(f"{self.root}/ids").where(F.col("batch_id") < before)

    def _filters(self, batch_id: int) -> DataFrame:
        """One filter per bucket that has ids of earlier batches; built again from the ids where the last one is gone."""
        last = f"{self.root}/filters/batch_id={batch_id - 1}"
        if batch_id and exists(self.spark, last):
            return self.spark.read.schema(FOUND).parquet(last).where(F.col("bits").isNotNull()).select("bucket", "bits")
        if batch_id and exists(self.spark, f"{self.root}/ids"):
            earlier, none = self._stored(batch_id), self.spark.createDataFrame([], "bucket int, bits binary")
            return self._probe(earlier, none).where(F.col("bits").isNotNull()).select("bucket", "bits")
        return self.spark.createDataFrame([], "bucket int, bits binary")

    def _probe(self, ids: DataFrame, filters: DataFrame) -> DataFrame:
        bits = self.bits

        def run(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
            old = known.column("bits").to_pylist()
            flags = np.unpackbits(np.frombuffer(old[0], np.uint8)) if old else np.zeros(bits, np.uint8)
            # a filter that was made for another capacity
            flags = flags if len(flags) == bits else np.ones(bits, np.uint8)
            at = _positions(own.column("h1").to_numpy(), own.column("h2").to_numpy(), bits)
            maybe = own.column("read_id").filter(pa.array(flags[at].all(1) if len(at) else np.zeros(0, bool)))
            flags[at.ravel()] = 1
            n = len(maybe) + 1
            return pa.table({
                "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
                "read_id": pa.array([*maybe.to_pylist(), None], pa.string()),
                "bits": pa.array([None] * len(maybe) + [np.packbits(flags).tobytes()], pa.binary()),
            })

        own = ids.select("bucket", "read_id", "h1", "h2").groupBy("bucket")
        return own.cogroup(filters.groupBy("bucket")).applyInArrow(run, FOUND)

    def add(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Store the ids of a batch; returns (read_id) of those that the batch holds twice or an earlier batch has stored.

        A batch that is added again replaces what it had stored, and is compared with the batches before it only. Rows without an id
        are one id, so a second one is a repetition.
        """
        h1 = F.xxhash64("read_id")
        keyed = (
            ids.groupBy("read_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("read_id", "n", h1.alias("h1"), F.xxhash64("read_id", F.lit(1)).alias("h2"), F.pmod(h1, F.lit(self.buckets)).cast("int").alias("bucket"))
        )
        own, found = f"{self.root}/ids/batch_id={batch_id}", f"{self.root}/filters/batch_id={batch_id}"
        filters = self._filters(batch_id)
        # small row groups, sorted by bucket: a look-up reads the row groups of its buckets
        keyed.repartitionByRange("bucket").sortWithinPartitions("bucket").write.mode("overwrite").option(
            "parquet.block.size", 1 << 20
        ).parquet(own)
        stored = self.spark.read.schema(IDS).parquet(own).drop("batch_id")
        self._probe(stored, filters).write.mode("overwrite").parquet(found)
        if batch_id > 1:
            discard(self.spark, f"{self.root}/filters/batch_id={batch_id - 2}")
        repeated = stored.where("n > 1").select("read_id")
        suspects = self.spark.read.schema(FOUND).parquet(found).where(F.col("bits").isNull()).select("bucket", "read_id")
        buckets = [r.bucket for r in suspects.select("bucket").distinct().collect()]
        if not buckets:
            return repeated
        # a number of buckets at most, whatever has been stored
        earlier = self._stored(batch_id).where(F.col("bucket").isin(buckets)).select("bucket", "read_id")
        same = suspects["read_id"].eqNullSafe(earlier["read_id"]) & (suspects["bucket"] == earlier["bucket"])
        again = suspects.join(earlier, same, "left_semi").select("read_id")
        return repeated.unionByName(again).distinct()

    def require_new(self, ids: DataFrame, batch_id: int, what: str) -> None:
        """:meth:`add`, where a repeated id is an error."""
        repeated = self.add(ids, batch_id).orderBy("read_id").limit(3).collect()
        if repeated:
            raise ValueError(f"duplicate read_id in {what}: {[r.read_id for r in repeated]}")
