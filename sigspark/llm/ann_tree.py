"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every row is then put into the leaf that descending to the nearest centre leads to.
A query walks the tree through a priority queue of branches by distance to their centres and visits leaves in that order.
How many leaves have to be visited is calibrated: for a sample of queries the exact neighbours are found by brute force over
all rows, and the number of visits is the smallest at which the wanted share of them lies in a visited leaf.

Copies of a vector are one row with its smallest ids: as no answer is longer than k, k + 1 ids of each vector are all that
can appear. Queries and rows meet by leaf; a leaf with very many rows or queries is split into blocks of bounded size.

Leaves are visited in rounds: the first one, then up to ``growth`` times as many as before. After each round a query keeps
its k + 1 nearest answers, and from then on only rows nearer than the last of them (or as near) are handed on, so what a
round hands on does not grow with the number of leaves. The answers are those of all visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import per_batch
from sigspark.llm.vectors import KIND, matrix, usable_rows
from sigspark.session import cut_lineage


@dataclass(frozen=True)
class TreeSettings:
    """``sample`` bounds the rows that the fit sees, ``calibration`` the queries that are answered by brute force."""

    branches: int = 16
    leaf: int = 256
    sample: int = 20_000
    rounds: int = 8
    calibration: int = 200
    recall: float = 0.98
    seed: int = 3
    row_block: int = 8192
    query_block: int = 2048
    growth: int = 6


@dataclass(frozen=True)
class Tree:
    """Inner node n has children ``children[n]`` with centres ``centres[n]``; a child below 0 is the leaf -child - 1."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int


def _kmeans(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        owner = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, 1)
        kept = np.unique(owner)
        centres = np.stack([rows[owner == c].mean(0) for c in kept])
    return centres, np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, 1)


def build(rows: np.ndarray, leaf: float, settings: TreeSettings) -> Tree:
    """Split until a node has at most ``leaf`` of the sampled rows."""
    rng = np.random.default_rng(settings.seed)
    centres: list[np.ndarray] = [np.zeros((0, 0))]
    children: list[list[int]] = [[]]
    leaves = 0
    todo = [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        k = int(min(settings.branches, max(2, len(own) // max(leaf, 1)), len(own)))
        middle, owner = _kmeans(rows[own], k, settings.rounds, rng) if len(own) else (np.zeros((1, rows.shape[1])), own)
        parts = [own[owner == c] for c in range(len(middle))]
        alive = [c for c in range(len(middle)) if len(parts[c]) or len(middle) == 1]
        centres[node] = middle[alive]
        for c in alive:
            if len(parts[c]) > leaf and len(alive) > 1:
                children[node].append(len(centres))
                todo.append((len(centres), parts[c]))
                centres.append(np.zeros((0, 0)))
                children.append([])
            else:
                children[node].append(-leaves - 1)
                leaves += 1
    return Tree(centres, children, leaves)


def assign(rows: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of every row."""
    out = np.zeros(len(rows), dtype=np.int64)
    todo = [(0, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        centres = tree.centres[node]
        nearest = np.argmin((centres**2).sum(1) - 2 * rows[own] @ centres.T, 1)
        for c, child in enumerate(tree.children[node]):
            part = own[nearest == c]
            if child < 0:
                out[part] = -child - 1
            else:
                todo.append((child, part))
    return out


def best_bins(query: np.ndarray, tree: Tree, visits: int) -> list[int]:
    """The first ``visits`` leaves in best-bin-first order."""
    queue: list[tuple[float, int]] = [(0.0, 0)]
    found: list[int] = []
    while queue and len(found) < visits:
        _, node = heapq.heappop(queue)
        if node < 0:
            found.append(-node - 1)
            continue
        far = ((tree.centres[node] - query) ** 2).sum(1).tolist()
        for d, child in zip(far, tree.children[node]):
            heapq.heappush(queue, (d, child))
    return found


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: list, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest (distance, id) of each query; rows stand for all of their ids."""
    answers = []
    square = (rows**2).sum(1)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = np.maximum(square + (part**2).sum(1)[:, None] - 2 * part @ rows.T, 0)
        some = min(k, len(rows))
        limit = np.partition(rough, some - 1, axis=1)[:, some - 1]
        slack = 1e-9 * (square.max() + (part**2).sum(1)) + 1e-300
        for q, line, most in zip(part, rough, limit + slack):
            at_row = np.flatnonzero(line <= most)  # rounding cannot push one of the k out
            exact = np.sqrt(((rows[at_row] - q) ** 2).sum(1)).tolist()
            near = [(d, i) for d, r in zip(exact, at_row.tolist()) for i in ids[r]]
            answers.append(heapq.nsmallest(k, near))
    return answers


def rounds(visits: int, growth: int) -> list[tuple[int, int]]:
    """(first, end) of the visits of every round: the first one, then ``growth`` times as many in all as before."""
    ends = [0, 1]
    while ends[-1] < visits:
        ends.append(min(visits, ends[-1] * growth))
    return list(zip(ends, ends[1:]))


def _brute(batches: Iterator[pa.RecordBatch], queries: np.ndarray, tree: Tree, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest vectors of a task's rows for every calibration query, with their leaves."""
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows = matrix(part.column("vec"))
            leaf = part.column("leaf").to_pylist()
            for q, near in enumerate(_nearest(queries, rows, [[x] for x in leaf], k)):
                best[q] = heapq.nsmallest(k, best[q] + near)
    flat = [(q, d, leaf) for q, near in enumerate(best) for d, leaf in near]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.float64()),
         pa.array([f[2] for f in flat], pa.int64())], ["q", "distance", "leaf"])


def search(
    embeddings: DataFrame, is_query, vector: str = "embedding", k: int = 10, settings: TreeSettings = TreeSettings()
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every row that ``is_query`` (a condition) selects.

    Score is the Euclidean distance in double precision, ties go to the smaller id. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, take no part; nor do vectors whose length differs from the
    commonest one. Rows that repeat an id with the same vector count once; fewer candidates than k are all returned.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    rows = usable_rows(embeddings, vector).where(F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vec") == lengths[0].dim).distinct()
    order = Window.partitionBy("vec").orderBy("vec_id")
    classes = cut_lineage(
        rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    number = classes.count()
    picked = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(settings.sample).toArrow()
    sample = matrix(picked.column("vec"))
    tree = build(sample, max(8.0, settings.leaf * len(sample) / number), settings)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf = assign(matrix(batch.column("vec")), tree)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    placed = cut_lineage(classes.mapInArrow(per_batch(place), f"vec {KIND}, ids array<long>, leaf long"))
    asked = cut_lineage(rows.where(is_query).select("vec_id", "vec"))
    distinct = cut_lineage(asked.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()))
    some = matrix(distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(settings.calibration).toArrow().column("vec"))
    if not len(some):
        return spark.createDataFrame([], empty)
    top = Window.partitionBy("q").orderBy("distance", "leaf")
    truth = (
        placed.select("vec", "leaf")
        .mapInArrow(lambda batches: _brute(batches, some, tree, k + 1), "q long, distance double, leaf long")
        .withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1).collect()
    )
    orders = [{leaf: i for i, leaf in enumerate(best_bins(q, tree, tree.leaves))} for q in some]
    needed = np.sort([orders[r.q][r.leaf] + 1 for r in truth])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))) - 1)])

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [best_bins(q, tree, visits) for q in matrix(batch.column("vec"))]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        return pa.RecordBatch.from_arrays(
            [batch.column("q").take(at), batch.column("vec").take(at), pa.array([x for f in found for x in f], pa.int64()),
             pa.array([i for f in found for i in range(len(f))], pa.int32())], ["q", "vec", "leaf", "visit"],
        )

    walks = cut_lineage(distinct.select("q", "vec").mapInArrow(per_batch(walk), f"q long, vec {KIND}, leaf long, visit int"))
    # one number per leaf of the bounded tree
    filled = {r.leaf: -(-r["count"] // settings.row_block) for r in placed.groupBy("leaf").count().collect()}

    def spread(frame: DataFrame, blocks: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        return frame.join(blocks, "leaf").withColumn(mine + "_at", F.pmod(F.xxhash64(key), F.col(mine)).cast("int")).withColumn(
            other + "_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        )

    def meet(group: pa.Table) -> pa.Table:
        asking = group.filter(group.column("q").is_valid())
        held = group.filter(group.column("q").is_null())
        out: list[tuple[int, int, float]] = []
        if asking.num_rows and held.num_rows:
            near = _nearest(matrix(asking.column("vec")), matrix(held.column("vec")), held.column("ids").to_pylist(), k + 1)
            limits = asking.column("most").to_pylist()
            out = [
                (q, i, d) for q, most, found in zip(asking.column("q").to_pylist(), limits, near)
                for d, i in found if most is None or d <= most
            ]
        return pa.table(
            [pa.array([o[n] for o in out], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            names=["q", "vec_id", "score"],
        )

    best = Window.partitionBy("q").orderBy("score", "vec_id")

    def further(answers: DataFrame | None, first: int, end: int) -> DataFrame:
        """The k + 1 nearest of every query after a round of visits."""
        now = walks.where((F.col("visit") >= first) & (F.col("visit") < end))
        if answers is None:
            now = now.withColumn("most", F.lit(None).cast("double"))
        else:  # a query that has fewer than k + 1 answers takes all
            full = answers.groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("most")).where(F.col("n") > k)
            now = now.join(full.select("q", "most"), "q", "left")
        wanted = {r.leaf: -(-r["count"] // settings.query_block) for r in now.groupBy("leaf").count().collect()}
        blocks = spark.createDataFrame(
            [(leaf, n, wanted[leaf]) for leaf, n in filled.items() if leaf in wanted], "leaf long, rows int, asks int"
        )
        meeting = spread(placed, blocks, "vec", "rows", "asks").select(
            "leaf", "rows_at", "asks_at", F.lit(None).cast("long").alias("q"), "vec", "ids", F.lit(None).cast("double").alias("most")
        ).unionByName(
            spread(now, blocks, "q", "asks", "rows").select(
                "leaf", "rows_at", "asks_at", "q", "vec", F.lit(None).cast("array<long>").alias("ids"), "most"
            )
        )
        partial = meeting.groupBy("leaf", "rows_at", "asks_at").applyInArrow(meet, "q long, vec_id long, score double")
        if answers is not None:
            partial = partial.unionByName(answers)
        ranked = partial.withColumn("place", F.row_number().over(best))
        return cut_lineage(ranked.where(F.col("place") <= k + 1).drop("place"))

    answers = None
    for first, end in rounds(visits, settings.growth):
        answers = further(answers, first, end)
    asked = asked.join(distinct, "vec").select(F.col("vec_id").alias("query_id"), "q")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.join(answers, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own).cast("int"))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def ann_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 100 == 0)
