"""Near duplicates of embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Copies of a vector become one class with a count. Classes whose signs agree in all hyperplanes of some table meet in a task
and their cosines are computed in double precision. A pair that meets in several tables counts in the first of them only, so
links can be counted without listing pairs; what a task hands on is one row per class with links: their number and a
spanning forest. Buckets above ``block`` rows are split into tiles of two blocks.

The number of hyperplanes grows with the logarithm of the number of classes, so a bucket stays small; the number of tables
follows from it and from the wanted recall of pairs exactly at the threshold (pairs above it are found more surely).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import per_batch
from sigspark.llm.components import components, local_components
from sigspark.llm.vectors import matrix, usable, usable_rows
from sigspark.session import cut_lineage

BLOCK = 4096


def plan(classes: int, threshold: float, recall: float, bucket: int = 256) -> tuple[int, int]:
    """(hyperplanes per table, tables) for ``classes`` rows: buckets of about ``bucket`` rows, ``recall`` at the threshold."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = min(30, max(4, math.ceil(math.log2(max(classes, 1) / bucket)) if classes > bucket else 4))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def signatures(rows: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """rows x tables; the hyperplanes depend on the seed and on the number of dimensions only."""
    planes = np.random.default_rng([seed, rows.shape[1]]).normal(size=(rows.shape[1], tables * bits))
    signs = (rows @ planes > 0).reshape(len(rows), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def tile(rows: np.ndarray, signs: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, table: int, threshold: float,
         step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(links per row, root per row) of one bucket; with ``side`` only pairs of a False and a True row count."""
    n = len(rows)
    links = np.zeros(n, dtype=np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cols = np.arange(n) if side is None else np.flatnonzero(side)
    lines = np.arange(n) if side is None else np.flatnonzero(~side)
    for at in range(0, len(lines), step):
        own = lines[at : at + step]
        other = cols[cols > own[0]] if side is None else cols
        i, j = np.nonzero(rows[own] @ rows[other].T >= threshold)
        i, j = own[i], other[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 18):
            a, b = i[cut : cut + (1 << 18)], j[cut : cut + (1 << 18)]
            fresh = ~(signs[a, :table] == signs[b, :table]).any(1)
            a, b = a[fresh], b[fresh]
            links += np.bincount(a, sizes[b], n).astype(np.int64) + np.bincount(b, sizes[a], n).astype(np.int64)
            if len(a):
                nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = local_components(len(nodes), back[: len(a)], back[len(a) :])
                left.append(nodes)
                right.append(nodes[root])
    return links, local_components(n, np.concatenate(left), np.concatenate(right))


def near_duplicates(
    embeddings: DataFrame, vector: str = "embedding", threshold: float = 0.9, recall: float = 0.999, seed: int = 5,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component,
    as do vectors of different length with each other. Repeated rows link like copies. A null vec_id takes part but names no
    component; it is kept if its component has no id. Other columns are ignored.
    """
    rows = usable_rows(embeddings, vector)
    classes = cut_lineage(
        rows.groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    number = classes.count()
    bits, tables = plan(number, threshold, recall)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("vec").to_pylist()
        out: list = [None] * len(vectors)
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            found = signatures(unit(np.array([vectors[i] for i in at])), bits, tables, seed)
            for i, s in zip(at.tolist(), found):
                out[i] = s
        return pa.RecordBatch.from_arrays(
            [batch.column("cls"), batch.column("copies"), batch.column("vec"), pa.array(out, pa.list_(pa.int32()))],
            ["cls", "copies", "vec", "signs"],
        )

    signed = cut_lineage(
        classes.select("cls", "copies", "vec").mapInArrow(
            per_batch(sign), "cls long, copies long, vec array<double>, signs array<int>"
        )
    )
    key = ["dim", "table", "bucket"]
    narrow = signed.select(F.size("vec").alias("dim"), F.posexplode("signs").alias("table", "bucket"))
    # a bucket of one row has no pair; large ones are few
    sizes = narrow.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("rows"))
    shared = cut_lineage(sizes.where("rows > 1").drop("rows"))
    wide = signed.select("*", F.size("vec").alias("dim"), F.posexplode("signs").alias("table", "bucket")).join(shared, key)
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j"), (F.col("own") > k).alias("side")),
    )
    dealt = wide.withColumn("own", own).withColumn("tile", F.explode(pairs)).select(
        *key, F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), F.col("tile.side").alias("side"), "cls", "copies", "vec", "signs"
    )

    def compare(group_key: tuple, group: pa.Table) -> pa.Table:
        _, table, _, i, j = (k.as_py() for k in group_key)
        vectors = unit(matrix(group.column("vec")))
        signs, cls = matrix(group.column("signs")), group.column("cls").to_numpy()
        side = None if i == j else group.column("side").to_numpy()
        links, root = tile(vectors, signs, group.column("copies").to_numpy(), side, table, threshold)
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "root": cls[root[some]], "links": links[some]})

    found = cut_lineage(
        dealt.groupBy(*key, "i", "j").applyInArrow(compare, "cls long, root long, links long")
    )
    linked = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labelled = (
        classes.select("cls", "copies", "least").join(linked, "cls", "left").join(counted, "cls", "left")
        .withColumn("label", F.coalesce("component", "cls"))
    )
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "label").select(
        "cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    by_vector = classes.select("cls", "vec").join(named, "cls").select("vec", "component_id", "n_links")
    inside = rows.join(by_vector, "vec").select("vec_id", "n_links", "component_id")
    outside = embeddings.where(~usable(vector)).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return inside.unionByName(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def cosine_query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings).select("vec_id", "n_links", F.col("component_id").cast("long"), "kept")
