"""Hard negatives of anchors by exact integer inner products.

Components become integers; inner products are taken modulo several small primes, each by one float32 matrix product of centred
residues (sums below 2^24 are exact in float32; more dimensions are summed in pieces), and put together by Chinese
remaindering with centred mixed-radix digits, which gives signed 64-bit scores without rounding. As many primes are used as the
largest norm asks for.

Anchors are a stated share of the rows and are compared with all rows in blocks: every tile of a block of anchors and a block of rows is one
group. The first pass hands on the best rows of an anchor's label, the second one, with the positives' scores, the best
rows of other labels within each positive's window. A tile keeps the first ``k`` rows per anchor or window, so what is handed
on is bounded by anchors x tiles, not by pairs; Spark keeps the first ones of all tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.vectors import matrix
from sigspark.session import cut_lineage

#: The contract's limits of a negative's score in parts of the positive's, 80 of 100 to 100 of 100.
SHARE = (4, 5)
#: Rows, and anchors, of a tile; fewer where vectors are long. Scores computed at a time.
ROWS, ANCHORS, CELLS = 8192, 4096, 1 << 20
#: Bytes that the vectors of one side of a tile may take.
SIDE_BYTES = 1 << 25
LARGEST_PRIME = 256


def primes_for(bound: int) -> list[int]:
    """Odd primes below 256, largest first, whose product exceeds 2 x bound + 1."""
    found, product = [], 1
    for p in range(LARGEST_PRIME - 1, 2, -1):
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise ValueError(f"scores up to {bound} are out of range")


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2."""
    rest = values % prime
    return np.where(rest > prime // 2, rest - prime, rest)


class Residues:
    """The rows of an integer matrix modulo every prime, as float32."""

    def __init__(self, rows: np.ndarray, primes: list[int]) -> None:
        self.primes = primes
        self.parts = [centred(rows, p).astype(np.float32) for p in primes]

    def scores(self, other: "Residues", mine: slice, theirs: slice) -> np.ndarray:
        """Exact inner products of some of these rows with some of ``other``'s."""
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.primes):
            most = max(1, ((1 << 24) - 1) // ((p // 2) ** 2))
            a, b = self.parts[k][mine], other.parts[k][theirs]
            rest = np.zeros((len(a), len(b)), dtype=np.int64)
            for at in range(0, a.shape[1], most):
                rest += (a[:, at : at + most] @ b[:, at : at + most].T).astype(np.int64)
            # mixed-radix digit: what the earlier digits leave, divided by the earlier primes modulo p
            product = 1
            for digit, q in zip(digits, self.primes):
                rest -= digit * (product % p)
                product *= q
            if k:
                rest = centred(rest, p) * pow(product, -1, p)
            digits.append(centred(rest, p))
        total, product = digits[-1], 1
        for digit, p in zip(digits[-2::-1], self.primes[-2::-1]):
            total = total * p + digit
        return total


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best allowed cells of each row, ties to the smaller column, best first."""
    if not scores.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    k = min(k, masked.shape[1])
    limit = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
    row, column = np.nonzero((masked >= limit[:, None]) & allowed)
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def _windows(scores: np.ndarray, allowed: np.ndarray, upper: list[list[int]], k: int) -> tuple[list, list, list]:
    """(row, positive, column) of the first ``k`` allowed cells of each row with lower limit <= score <= upper limit.

    ``upper`` has the positives' scores of each row.
    """
    low = [[-((-SHARE[0] * u) // SHARE[1]) for u in some] for some in upper]
    floor = np.array([min(some, default=1) for some in low], dtype=np.int64)
    ceiling = np.array([max(some, default=0) for some in upper], dtype=np.int64)
    row, column = np.nonzero(allowed & (scores >= floor[:, None]) & (scores <= ceiling[:, None]))
    value = scores[row, column]
    order = np.lexsort((column, -value, row))
    column, value = column[order], value[order]
    ends = np.searchsorted(row, np.arange(len(upper) + 1))
    rows, positives, columns = [], [], []
    for i, (limits, least) in enumerate(zip(upper, low)):
        own = value[ends[i] : ends[i + 1]]
        for j, (u, lo) in enumerate(zip(limits, least)):
            # own falls, so what is above u comes first
            at = len(own) - np.searchsorted(own[::-1], u, side="right")
            for c in range(at, min(at + k, len(own))):
                if own[c] < lo:
                    break
                rows.append(i)
                positives.append(j)
                columns.append(column[ends[i] + c])
    return rows, positives, columns


def integer_rows(embeddings: DataFrame, scale: int = 256, relabel: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, vec (whole numbers as doubles) of the rows that take part, one row per vec_id."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    # floor of a double gives a long, which saturates; sizes beyond it are found by the norm
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = embeddings.where(usable).select("vec_id", label.cast("long").alias("label"), whole.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.label", "row.vec")


def hard_negatives(
    embeddings: DataFrame, anchor_share: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, relabel: int = 7,
    classes: int = 10, rows_in_tile: int = ROWS, anchors_in_tile: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Of rows that share an id the one
    with the least (label, vector) takes part. Vectors without components have score 0 with each other. Vectors of
    different lengths, and scores beyond 64 bits, are an error. Ties go to the smaller id. Other columns are ignored; an empty table gives no
    rows.
    """
    staged = cut_lineage(integer_rows(embeddings, scale, relabel, classes))
    facts = staged.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("vec_id") % anchor_share == 0).alias("anchors"),
        F.min(F.size("vec")).alias("least"),
        F.max(F.size("vec")).alias("most"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"),
    ).first()
    if facts.n and facts.least != facts.most:
        raise ValueError(f"vectors have {facts.least} to {facts.most} components")
    norm = facts.norm or 0.0
    if norm >= 2.0**62:
        raise ValueError("scores do not fit 64 bits")
    # sums of doubles are exact up to 2^53 and off by a share below 1e-9 beyond
    primes = primes_for(math.ceil(norm * (1 + 1e-9)) + 1)
    fitting = max(256, SIDE_BYTES // (8 * max(facts.most or 1, 1)))
    row_blocks = max(1, -(-facts.n // min(rows_in_tile, fitting)))
    anchor_blocks = max(1, -(-facts.anchors // min(anchors_in_tile, fitting)))

    def dealt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    rows = staged.select("vec_id", "label", "vec", dealt(row_blocks).alias("row_block")).select(
        "*", every(anchor_blocks).alias("anchor_block")
    )
    # a stated query set against all rows, in blocks
    anchors = staged.where(F.col("vec_id") % anchor_share == 0).withColumn("anchor_block", dealt(anchor_blocks))

    def met(asked: DataFrame, function: Callable, schema: str) -> DataFrame:
        asked = asked.select("*", every(row_blocks).alias("row_block"))
        key = ("anchor_block", "row_block")
        return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(function, schema)

    def sides(left: pa.Table, right: pa.Table) -> tuple[Residues, Residues, pa.Table, pa.Table]:
        right = right.sort_by("vec_id")
        left = left.sort_by("vec_id")
        return *[Residues(matrix(t.column("vec")).astype(np.int64), primes) for t in (left, right)], left, right

    def chunks(left: pa.Table, right: pa.Table):
        """Scores of some anchors with some rows, and where these begin."""
        a, b, left, right = sides(left, right)
        step = max(1, CELLS // max(1, min(len(right), ROWS)))
        for i in range(0, len(left), step):
            mine = slice(i, min(i + step, len(left)))
            for j in range(0, len(right), ROWS):
                theirs = slice(j, min(j + ROWS, len(right)))
                yield a.scores(b, mine, theirs), left.slice(i, mine.stop - i), right.slice(j, theirs.stop - j)

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):
            for scores, ask, row in chunks(left, right):
                ids, found = column(ask, "vec_id"), column(row, "vec_id")
                allowed = (column(ask, "label")[:, None] == column(row, "label")) & (ids[:, None] != found)
                i, j = _first(scores, allowed, positives)
                out.append((ids[i], found[j], scores[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "positive_id", "positive_score"])

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        out = [(np.zeros(0, np.int64),) * 5]
        if len(left) and len(right):
            for scores, ask, row in chunks(left, right):
                ids, found = column(ask, "vec_id"), column(row, "vec_id")
                allowed = column(ask, "label")[:, None] != column(row, "label")
                wanted, upper = ask.column("positive_ids").to_pylist(), ask.column("positive_scores").to_pylist()
                i, p, j = _windows(scores, allowed, upper, negatives)
                got = [(ids[r], wanted[r][s], upper[r][s], found[c], scores[r, c]) for r, s, c in zip(i, p, j)]
                if got:
                    out.append(tuple(np.array(c, dtype=np.int64) for c in zip(*got)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = (
        met(anchors, same_label, "anchor_id long, positive_id long, positive_score long")
        .withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= positives)
    )
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("best")
    )
    asked = cut_lineage(
        anchors.join(best, "vec_id").select(
            "vec_id", "label", "vec", "anchor_block",
            F.col("best.positive_id").alias("positive_ids"), F.col("best.positive_score").alias("positive_scores"),
        )
    )
    second = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return (
        met(asked, other_label, schema)
        .withColumn("rank", F.row_number().over(second))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def negatives_query(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)


NEGATIVES_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.vec, r.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows_ a, rows_ r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
