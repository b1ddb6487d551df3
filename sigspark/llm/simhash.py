"""SimHash fingerprints of word shingles and their near-duplicates by tiled exact comparison.

Fingerprints are computed in Arrow batches next to the texts; only (id, 64 bits) move on. Equal fingerprints become one row
with a map-side aggregate, so copies cost nothing further.

Distinct fingerprints are compared exactly: two that differ in at most ``radius`` bits differ by at most ``radius`` in their
number of ones. They are dealt into strips of ``radius`` + 1 counts, strips into blocks of bounded size, and only blocks of
the same or the next strip meet in a task (a tile). Inside a tile the rows are sorted by the counts of ones of their four
16-bit quarters; a run of equal counts is compared, by exclusive-or and bit count, only with runs whose counts differ by at
most ``radius`` in sum, about an eighth of all. A tile hands on a spanning forest of the links it found, never the pairs, so
a large group of near copies yields as many rows as it has members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sigspark.llm.common import per_batch, texts
from sigspark.llm.components import components, local_components
from sigspark.session import cut_lineage

#: Rows of one block of a tile; a tile holds two blocks, 2 MB.
BLOCK = 131_072


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles of ``width`` words, repeats included.

    Words are what ASCII blanks separate, A-Z lower-cased. Fewer words than ``width`` are one shingle; none give zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - width + 1)
    starts, stops = first[:count].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 65_536):  # a very long text is added up in blocks
        part = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row; null texts are empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width, seed) for t in texts(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(per_batch(run), f"doc_id {kind}, fp long")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values sorted by the ones of their quarters, the distinct counts (runs x 4), and where each run starts (and ends)."""
    quarters = np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    code = quarters @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
    return values[order], quarters[order][starts].astype(np.int16), np.append(starts, len(values))


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``left`` and ``right`` (within ``left`` if None) as two columns of values."""
    rows, row_counts, row_starts = _runs(left)
    cols, col_counts, col_starts = (rows, row_counts, row_starts) if right is None else _runs(right)
    shift = 0 if right is None else len(rows)
    from_, to = [], []
    for k in range(len(row_counts)):
        near = np.flatnonzero(np.abs(col_counts - row_counts[k]).sum(1) <= radius)
        if right is None:
            near = near[near >= k]
        if not len(near):
            continue
        size = col_starts[near + 1] - col_starts[near]
        index = np.repeat(col_starts[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        other = cols[index]
        step = max(1, cells // len(index))
        for at in range(row_starts[k], row_starts[k + 1], step):
            own = rows[at : min(at + step, row_starts[k + 1])]
            i, j = np.nonzero(np.bitwise_count(own[:, None] ^ other[None, :]) <= radius)
            i, j = i + at, index[j]
            if right is None:
                keep = i < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            # a chunk in which everything is linked would give its square; it hands on a forest
            nodes, back = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
            root = local_components(len(nodes), back[: len(i)], back[len(i) :])
            tied = root != np.arange(len(nodes))
            from_.append(nodes[tied])
            to.append(nodes[root[tied]])
    if not from_:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    every = rows if right is None else np.concatenate([rows, cols])
    nodes, back = np.unique(np.concatenate(from_ + to), return_inverse=True)
    half = len(back) // 2
    root = local_components(len(nodes), back[:half], back[half:])
    tied = root != np.arange(len(nodes))
    return every[nodes[tied]], every[nodes[root[tied]]]


def links(values: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all rows of ``values`` (distinct ``fp``) that differ in at most ``radius`` bits."""
    width = radius + 1
    dealt = values.select("fp", F.floor(F.bit_count("fp") / width).cast("int").alias("strip"))
    sizes = {r.strip: r["count"] for r in dealt.groupBy("strip").count().collect()}  # at most 65 rows
    blocks = [-(-sizes.get(s, 0) // block) for s in range(-1, 64 // width + 2)]
    number = F.array(*[F.lit(n) for n in blocks])

    def of(strip):
        return F.element_at(number, strip + 2)

    def upto(strip):
        return F.when(of(strip) > 0, F.sequence(F.lit(0), of(strip) - 1)).otherwise(F.array().cast("array<int>"))

    def tile(s, i, t, j, right):
        return F.struct(s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"), right.alias("side"))

    strip, own = F.col("strip"), F.col("block")
    rows = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.greatest(of(strip), F.lit(1))).cast("int"))
    meets = F.concat(
        F.transform(upto(strip), lambda j: tile(strip, F.least(own, j), strip, F.greatest(own, j), own > j)),
        F.transform(upto(strip + 1), lambda j: tile(strip, own, strip + 1, j, F.lit(False))),
        F.transform(upto(strip - 1), lambda j: tile(strip - 1, j, strip, own, F.lit(True))),
    )
    tiles = rows.select("fp", F.explode(meets).alias("tile")).select("fp", "tile.*")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        value, side = group["fp"].to_numpy().view(np.uint64), group["side"].to_numpy()
        s, i, t, j = key
        left = np.ascontiguousarray(value[~side])
        a, b = tile_links(left, None if (s, i) == (t, j) else np.ascontiguousarray(value[side]), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tiles.groupBy("s", "i", "t", "j").applyInPandas(compare, "a long, b long")


def classes(documents: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, own one included) for every row.

    Texts without words share the fingerprint zero and are linked like any other; repeated rows and ids are kept. Rows
    without an id take part; a component of such rows only has a null id. Other columns are ignored.
    """
    rows = cut_lineage(fingerprints(documents, width, seed))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct, radius, block))
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "label").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, radius: int = 4) -> DataFrame:
    """One document of every component, that with the smallest id; all columns as they were.

    Rows that repeat an id count as copies of each other and one of them stays. Rows without an id cannot be told apart and
    stay.
    """
    found = classes(documents, radius)
    kept = found.where("doc_id = component_id").select("doc_id")
    repeated = not kept.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty()
    named = documents.where(F.col("doc_id").isNotNull()).join(kept.distinct(), "doc_id", "left_semi")
    if repeated:
        named = named.drop_duplicates(["doc_id"])
    return named.unionByName(documents.where(F.col("doc_id").isNull()))


def simhash_query(documents: DataFrame) -> DataFrame:
    return classes(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("long")
    )
