"""Mixing sources to target weights by balanced sampling with the cube method.

The mix takes every document of a source the same whole number of times, and once more with a probability that makes the
source's words meet its target. Which documents are taken once more is drawn by the cube method: inclusion probabilities move
through the null space of the balancing constraints (the source's number of documents and its number of words) until they
are 0 or 1, so the totals stay where they are while the draw stays random. A dozen documents of a source are spared for the
landing: with those that the flight left open they are decided together, by the choice that brings the words nearest to
their total.

The flight runs in groups of bounded size: documents of a source are dealt into chunks by a hash of their id, each chunk
leaves at most two documents open, and these meet in the next level, until the open documents of every source fit one
chunk. A hot source is many chunks. Texts are read once for their number of words and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

#: Documents that one flight sees, and those of a source that are kept for the landing.
CHUNK, SPARED = 4096, 12


def source_targets(
    sizes: Sequence[int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> list[float]:
    """Targets of sources in their order: ``share`` of all words dealt by repeating weights, none above ``most`` times its size.

    What a source cannot take is dealt again, by weight, among those that still can.
    """
    limit = [most * s for s in sizes]
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if unit * weight[i] > limit[i]]
        if not full:
            for i in open_:
                target[i] = unit * weight[i]
            break
        for i in full:
            target[i] = limit[i]
            left -= limit[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def flight(psi: np.ndarray, size: np.ndarray, rng: np.random.Generator, landing: bool) -> np.ndarray:
    """Cube method on one chunk; constraints are sum(psi) and sum(psi * size). At most two entries stay between 0 and 1,
    with ``landing`` none."""
    psi, size = psi.tolist(), size.astype(float).tolist()
    draws = iter(())

    def draw() -> float:
        nonlocal draws
        value = next(draws, None)
        if value is None:
            draws = iter(rng.random(1024).tolist())
            value = next(draws)
        return value

    def move(units: list[int], u: list[float]) -> None:
        up = down = float("inf")
        for k, d in zip(units, u):
            if d > 0:
                up, down = min(up, (1 - psi[k]) / d), min(down, psi[k] / d)
            elif d < 0:
                up, down = min(up, psi[k] / -d), min(down, (1 - psi[k]) / -d)
        step = up if draw() * (up + down) < down else -down
        for k, d in zip(units, u):
            value = psi[k] + step * d
            psi[k] = 0.0 if value < 1e-9 else 1.0 if value > 1 - 1e-9 else value

    waiting = [i for i in range(len(psi)) if 0 < psi[i] < 1][::-1]
    spared: list[int] = []
    if landing:  # the longest ones and some of every length, to meet the words with
        spots = range(len(waiting)) if len(waiting) <= SPARED else [
            *range(-4, 0), *np.linspace(0, len(waiting) - 5, SPARED - 4).astype(int).tolist()
        ]
        spared = [waiting[k] for k in spots]
        waiting = [k for k in waiting if k not in set(spared)]
    window: list[int] = []
    while True:
        while len(window) < 3 and waiting:
            window.append(waiting.pop())
        if len(window) < 3:
            break
        a, b, c = window
        u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
        top = max(map(abs, u))
        move(window, [x / top for x in u] if top > 0 else [1.0, -1.0, 0.0])
        window = [k for k in window if 0 < psi[k] < 1]
    if landing:
        units = window + spared
        ways = np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1
        chance, words = np.array([psi[k] for k in units]), np.array([size[k] for k in units])
        off = np.abs((ways - chance) @ words) + 1e-6 * np.abs((ways - chance).sum(1))
        for k, taken in zip(units, ways[np.argmin(off)].tolist()):
            psi[k] = float(taken)
    return np.array(psi)


def _flyer(seed: int, level: int, landing: bool):
    def fly(key: tuple, group: pa.Table) -> pa.Table:
        # long documents first, so that what stays open is short
        group = group.take(pc.sort_indices(group, [("size", "descending"), ("doc_id", "ascending")]))
        rng = np.random.default_rng([seed, level, *(int(k.as_py()) for k in key)])
        psi = flight(group.column("psi").to_numpy(), group.column("size").to_numpy(), rng, landing)
        return group.set_column(group.schema.get_field_index("psi"), "psi", pa.array(psi))

    return fly


def mix(
    documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken (words).

    Sources are ordered by code point, null last, and take the weights in turn. A null text has no words; documents without
    words are drawn like any other and take none. Repeated rows are drawn each. Other columns are ignored. One number per source
    reaches the driver.
    """
    spark = documents.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = cut_lineage(documents.select("doc_id", "source", words.alias("size")))
    totals = {r.source: r["total"] for r in rows.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = source_targets([totals[s] for s in names], weights, share, most)
    ratio = [t / totals[s] if totals[s] else 0.0 for s, t in zip(names, targets)]
    table = spark.createDataFrame(
        [(i, s, totals[s], t, int(r), r - int(r)) for i, (s, t, r) in enumerate(zip(names, targets, ratio))],
        "number int, name string, source_size long, target double, whole int, psi double",
    )
    level, done = 0, None
    open_ = rows.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    while True:
        counts = open_.groupBy("number").count()
        chunks = F.ceil(F.col("count") / chunk).cast("long")
        landing = not (counts.agg(F.max("count")).first()[0] or 0) > chunk
        dealt = open_.join(counts.select("number", chunks.alias("chunks")), "number").withColumn(
            "chunk", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("chunks"))
        )
        flown = cut_lineage(
            # by both keys: the join before would leave all chunks of a source in one task
            dealt.repartition("number", "chunk").groupBy("number", "chunk")
            .applyInArrow(_flyer(seed, level, landing), dealt.schema)
            .drop("chunks", "chunk")
        )
        closed = flown if landing else flown.where("psi <= 0 or psi >= 1")
        done = closed if done is None else done.unionByName(closed)
        if landing:
            break
        open_, level = flown.where("psi > 0 and psi < 1"), level + 1
    copies = F.col("whole") + F.col("psi").cast("int")
    return done.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """``documents`` with every row as often as the mix takes it, all columns as they were.

    Rows that repeat an id all take the largest number of copies drawn for it; rows without an id stay once.
    """
    copies = mixed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    named = documents.join(copies.where(F.col("__copies") > 0), "doc_id").select(
        *documents.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    )
    return named.drop("__copy").unionByName(documents.where(F.col("doc_id").isNull()))


def mixing_query(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "copies")
