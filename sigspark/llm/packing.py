"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, number of documents and attention cost (sum of squared piece lengths). An item goes to
an open bin that has room for it in every dimension; among these the one with the least weighted norm of what would be left
(``norm``) or the largest weighted product of demand and room (``dot``) takes it. Items come longest first.

Only documents longer than a bin are cut: into full pieces, the first one being the shorter rest, so that every piece after it
is a bin by itself. Other items are dealt by a hash into blocks of bounded size, packed block by block; bins that stay
poorly filled are packed once more, as items, with those of other blocks. Only lengths and checksums move between tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import per_batch, texts
from sigspark.llm.tokens import encoder, vocabulary
from sigspark.session import cut_lineage

#: Items that one block packs.
BLOCK = 16_384


@dataclass(frozen=True)
class Bins:
    """Capacities and how much each dimension counts in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


def best_fit(demand: np.ndarray, bins: Bins) -> np.ndarray:
    """The bin of every item, given in packing order; ``demand`` is items x (tokens, documents, attention).

    An item that no empty bin could take gets a bin of its own.
    """
    capacity = bins.capacity
    scale = np.array(bins.weights) / capacity**2
    # with demands below it, what a bin has left is of use; others leave the list of open bins
    least = np.minimum.accumulate(demand[::-1], axis=0)[::-1] if len(demand) else demand
    room = np.empty((3, 256))
    number = np.empty(256, dtype=np.int64)
    used = made = 0
    out = np.empty(len(demand), dtype=np.int64)
    for i, need in enumerate(demand):
        fits = np.flatnonzero(
            (room[0, :used] >= need[0]) & (room[1, :used] >= need[1]) & (room[2, :used] >= need[2])
        )
        if len(fits):
            left = room[:, fits]
            if bins.rule == "dot":
                pick = fits[np.argmax((scale * need) @ left)]
            else:
                pick = fits[np.argmin(scale @ (left - need[:, None]) ** 2)]
        else:
            if used == len(number):
                alive = (room[:, :used] >= least[i][:, None]).all(0)
                kept = int(alive.sum())
                room[:, :kept], number[:kept] = room[:, :used][:, alive], number[:used][alive]
                used = kept
                if used * 2 > len(number):
                    room = np.concatenate([room, np.empty_like(room)], axis=1)
                    number = np.concatenate([number, np.empty_like(number)])
            pick = used
            room[:, pick], number[pick] = capacity, made
            used, made = used + 1, made + 1
        room[:, pick] -= need
        out[i] = number[pick]
    return out


def _places(bin_: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where each item starts in its bin, in packing order."""
    order = np.argsort(bin_, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    first = np.concatenate([[True], bin_[order][1:] != bin_[order][:-1]])
    out = np.empty(len(length), dtype=np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(length))))
    return out


def _pack_group(group: pa.Table, bins: Bins) -> pa.Table:
    demand = np.stack([group.column(c).to_numpy().astype(np.float64) for c in ("tokens", "documents", "attention")], 1)
    order = np.lexsort((group.column("item").to_numpy(), -demand[:, 1], -demand[:, 0]))
    bin_ = np.empty(len(order), dtype=np.int64)
    bin_[order] = best_fit(demand[order], bins)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = _places(bin_[order], demand[order, 0].astype(np.int64))
    return group.append_column("bin", pa.array(bin_)).append_column("place", pa.array(place))


def _pack_blocks(items: DataFrame, count: int, bins: Bins, block: int) -> DataFrame:
    blocks = max(1, -(-count // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("bin", T.LongType()), T.StructField("place", T.LongType())])
    return dealt.groupBy("block").applyInArrow(lambda group: _pack_group(group, bins), schema)


def pack(items: DataFrame, length: str = "length", bins: Bins = Bins(), block: int = BLOCK, poor: float = 0.97) -> DataFrame:
    """``items`` with sequence_id and offset (gapless from 0 in every sequence).

    Items need no key: rows are numbered when they are staged. A length of null or below 1 is an error of the caller; an
    item above a capacity gets a sequence of its own. Bins filled by less than ``poor`` are packed again across blocks.
    """
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    staged = cut_lineage(items.select(*own).withColumn("__item", F.monotonically_increasing_id()))
    size = F.col(length).cast("long")
    demand = staged.select(
        F.col("__item").alias("item"), size.alias("tokens"), F.lit(1).cast("long").alias("documents"),
        (size * size).alias("attention"),
    )
    full = demand.where(F.col("tokens") >= bins.tokens)
    rest = demand.where(F.col("tokens") < bins.tokens)
    first = cut_lineage(_pack_blocks(rest, rest.count(), bins, block))
    made = first.groupBy("block", "bin").agg(
        *[F.sum(c).alias(c) for c in ("tokens", "documents", "attention")], F.min("item").alias("item")
    )
    again = made.where(F.col("tokens") < poor * bins.tokens)
    number = again.count()
    second = cut_lineage(_pack_blocks(again.select("item", "tokens", "documents", "attention", F.col("block").alias("b1"),
                                                   F.col("bin").alias("c1")), number, bins, block))
    moved = second.select("b1", "c1", F.col("block").alias("b2"), F.col("bin").alias("c2"), F.col("place").alias("base"))
    # even numbers: full items, odd ones: bins of the first and, after them, of the second packing
    placed = first.join(moved, (F.col("block") == F.col("b1")) & (F.col("bin") == F.col("c1")), "left").select(
        "item",
        F.when(F.col("b2").isNull(), F.col("block") * 4 * (1 << 24) + F.col("bin") * 4 + 1)
        .otherwise(F.col("b2") * 4 * (1 << 24) + F.col("c2") * 4 + 3)
        .alias("sequence_id"),
        (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
    alone = full.select("item", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    numbers = placed.unionByName(alone).withColumnRenamed("item", "__item")
    return staged.join(numbers, "__item").drop("__item")


def pieces(documents: DataFrame, tokenizer: str, blanks: bool, end: int, most: int = 2048, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    A document is the ids of its whole text and the id ``end``; null and empty texts are the end id alone. Texts of at most
    ``most`` ids are one piece, longer ones pieces of ``most`` ids after a first one that holds the rest.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stop = np.array([end], dtype="<u4").tobytes()
        rows, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, found in enumerate(encoder(tokenizer, blanks).encode(texts(batch.column("text")))):
            found += stop
            total = len(found) // 4
            cuts = [0, *range(total % most or most, total, most), total] if total > most else [0, total]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = found[4 * a : 4 * b]
                rows.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(part)
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return documents.select("doc_id", "text").mapInArrow(per_batch(run), schema)


def packing_query(documents: DataFrame) -> DataFrame:
    found = pieces(documents, vocabulary("byte_bpe_50k.json"), True, 0)
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
