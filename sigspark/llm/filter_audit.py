"""How filters interact: survivors of every subset of five filters, and from them every order of application.

A document that fails the filters in mask ``m`` survives the subset ``S`` of filters where ``S & m`` is 0. So it becomes one
32-bit word, the truth-table column of its mask, whose bit ``S`` says whether it survives ``S``. Words are added up by bit
position: carry-save adders turn three words of one weight into one of that weight and one of the next, until two are left per
weight; only those are unpacked. That gives the survivors of all 32 subsets per part and label in one pass, and whatever is asked of
an order of filters is a difference of two of these counts.

Filters A to D are functions of a text; E, copies of the text of a smaller id, needs one aggregate by digest. What is shuffled
is a digest, an id and a mask per document; a very common text is combined before the shuffle, and its documents are split
by adaptive execution in the join (both sides of it are plain shuffles).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import per_batch
from sigspark.session import cut_lineage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of a text whose words are listed at a time.
STEP = 1 << 20


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words); words are runs of anything but the six ASCII blanks."""
    if len(text) <= STEP:
        words = text.split()
        return len(words), len(set(words))
    count, seen, at = 0, set(), 0
    while at < len(text):
        blank = re.compile(rb"[\x20\x09-\x0d]").search(text, at + STEP)
        end = blank.start() if blank else len(text)
        words = text[at:end].split()
        count += len(words)
        seen.update(words)
        at = end
    return count, len(seen)


def mask_of(text: str) -> tuple[int, bytes]:
    """(filters A to D that the text fails, digest of the text)."""
    raw = text.encode("utf-8", "surrogatepass")
    words, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    mask = (
        (words < LEAST_WORDS)
        | (100 * distinct < LEAST_DISTINCT * words) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | (SYMBOLS.search(raw) is not None) << 3
    )
    return mask, hashlib.sha256(raw).digest()


def survival_words() -> np.ndarray:
    """The 32-bit word of every mask."""
    word = np.zeros(SUBSETS, dtype=np.uint32)
    for mask, subset in itertools.product(range(SUBSETS), repeat=2):
        word[mask] |= np.uint32((mask & subset == 0) << subset)
    return word


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each of the 32 bits set, by carry-save adders."""
    out = np.zeros(32, dtype=np.int64)
    weight, level = 0, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            level = np.concatenate([half ^ c, level[3 * third :]])
        for word in level:
            out += ((int(word) >> np.arange(32)) & 1) << weight
        level = np.concatenate(carries) if carries else level[:0]
        weight += 1
    return out


def _masks(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [mask_of(t or "") for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("part"), pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())],
        ["doc_id", "part", "mask", "digest"],
    )


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and part, survivors of every subset among all, good and toxic documents."""
    word = survival_words()
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("part").dictionary_encode()
        part, words = coded.indices.to_numpy(), word[batch.column("mask").to_numpy()]
        labels = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(len(coded.dictionary) + 1))
        counts: list[list[list[int]]] = [[], [], []]
        for a, b in zip(cuts, cuts[1:]):
            rows = order[a:b]
            for k, some in enumerate([rows, rows[labels[0][rows]], rows[labels[1][rows]]]):
                counts[k].append(positional_counts(words[some]).tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(c, kind) for c in counts]], ["part", "n", "n_good", "n_toxic"])


def filter_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit k: the document fails the k-th of filters A to E), one row per row of ``documents``.

    A null text counts as empty, a null lang as the empty part. Copies are told by SHA-256. A document without an id has no
    smaller id and is no smaller id to another; rows that share id and text do not make each other copies.
    """
    part = F.coalesce("lang", F.lit("")).alias("part")
    staged = cut_lineage(
        documents.select("doc_id", part, "text").mapInArrow(
            per_batch(_masks), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"
        )
    )
    copied = (
        staged.where(F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where(F.col("first_id") < F.col("last_id"))
        .select("digest", "first_id")
    )
    fails = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return staged.join(cut_lineage(copied), "digest", "left").select("doc_id", "part", (F.col("mask") + fails * 16).alias("mask"))


def subset_survivors(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n, n_good, n_toxic: one row per part, with survivors of subset S at index S.

    A document is good (toxic) if any of its labels says so; null labels and labels without an id say nothing.
    """
    masks = filter_masks(documents)
    known = cut_lineage(
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])
    )
    flags = [(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")]
    # rows without an id have no labels: kept out of the join, where they would be one key
    counted = masks.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select("part", "mask", *flags)
    counted = counted.unionByName(
        masks.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    )
    found = counted.mapInArrow(_survivors, "part string, n array<long>, n_good array<long>, n_toxic array<long>")
    sums = [
        F.array(*[F.sum(F.col(c)[s]) for s in range(SUBSETS)]).alias(c) for c in ("n", "n_good", "n_toxic")
    ]
    return found.groupBy("part").agg(*sums)


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see ``audit_query`` for the columns.

    No documents, no rows. Repeated rows count each; other columns are ignored.
    """
    survivors = subset_survivors(documents, labels)
    full = SUBSETS - 1
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            name = "".join(FILTERS[k] for k in order)
            steps.append({"filter_order": name, "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    # 600 steps, whatever the input
    kind = "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>"
    plan = F.explode(F.from_json(F.lit(json.dumps(steps)), kind)).alias("at")

    def of(c: str, subset: Column) -> Column:
        return F.element_at(c, subset + 1)

    def shapley(f: int) -> Column:
        """Orders in which f comes after exactly S: |S|! (4 - |S|)!, for every S without f."""
        terms = []
        for subset in range(SUBSETS):
            if not subset >> f & 1:
                k = subset.bit_count()
                orders = math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)
                terms.append((F.col("n")[subset] - F.col("n")[subset | 1 << f]) * F.lit(orders))
        return sum(terms[1:], terms[0])

    shares = survivors.withColumn("shares", F.array(*[shapley(f) for f in range(len(FILTERS))]))
    own = F.col("after") - F.col("before")
    removed = of("n", F.col("before")) - of("n", F.col("after"))
    return shares.select("*", plan).select(*shares.columns, "at.*").select(
        "part",
        "filter_order",
        "step",
        of("n", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (F.col("n")[0] - of("n", own) - removed).alias("redundant"),
        (of("n", F.lit(full) - own) - F.col("n")[full]).alias("unique_fails"),
        (of("n_good", F.col("before")) - of("n_good", F.col("after"))).alias("good_lost"),
        (of("n_toxic", F.col("before")) - of("n_toxic", F.col("after"))).alias("toxic_lost"),
        of("shares", F.col("f")).alias("shapley"),
    )


def audit_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_interactions(documents, labels)


AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts
), fails AS (
  SELECT doc_id, part,
    len(words) < 200 AS a,
    100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM words
), marked AS (
  SELECT part, [a, b, c, d, e] AS fail,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM fails LEFT JOIN labels USING (doc_id)
), classes AS (
  SELECT part, fail, good, toxic, count(*) AS n FROM marked GROUP BY ALL
), letters AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
  SELECT [p.f, q.f, r.f, s.f, t.f] AS fs FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), steps AS (
  SELECT fs, array_to_string(list_transform(fs, lambda f: substr('ABCDE', f, 1)), '') AS filter_order,
    unnest(range(1, 6)) AS step FROM orders
), states AS (
  SELECT part, filter_order, step, fs[step] AS f, n, good, toxic, fail[fs[step]] AS fails_it,
    list_bool_or(list_transform(fs[1:step - 1], lambda f: fail[f])) AS gone,
    NOT list_bool_or(list_transform(list_filter(fs, lambda f: f <> fs[step]), lambda f: fail[f])) AS passes_rest
  FROM steps, classes
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT coalesce(gone, false) AND NOT fails_it THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT coalesce(gone, false) AND fails_it THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN coalesce(gone, false) AND fails_it THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails_it AND passes_rest THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT coalesce(gone, false) AND fails_it AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT coalesce(gone, false) AND fails_it AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM states GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
