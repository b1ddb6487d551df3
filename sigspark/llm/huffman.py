"""Token ids in a compressed binary format: canonical length-limited Huffman codes in independent blocks.

Code lengths come from the counts of all ids in the whole table by package-merge, none longer than 16 bits; codes are
canonical, so the lengths alone describe them. Documents are written in ascending order of their id, in blocks that can be
decoded alone; a block holds its documents' ids and token counts, the bit stream, and the bit offset of every 512th token.
Decoding looks up 16 bits at a time in one table of symbols and lengths and advances all checkpoints of a block together.

The container is a Parquet table of blocks, written by Spark's committer to any file system that Spark reaches, beside a
table of code lengths and an index with the number of tokens before each file. Ids are tokenised once, staged compressed,
and shuffled once by range of the document id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import per_batch, texts
from sigspark.llm.tokens import encoder, vocabulary
from sigspark.session import cut_lineage, scratch_path

LIMIT = 16
CHECKPOINT = 512
#: Tokens after which a block is closed.
BLOCK = 1 << 19


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that do not occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols do not fit codes of {limit} bits")
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, from_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        from_leaf.append(place < len(leaves))
    taken = 2 * len(symbols) - 2
    for leaf in reversed(from_leaf):
        mine = int(leaf[:taken].sum())
        lengths[order[:mine]] += 1
        taken = 2 * (taken - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every symbol, by length and then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        # a code counts the 16-bit prefixes that the codes before it take up
        span = 1 << (LIMIT - lengths[order].astype(np.int64))
        codes[order] = (np.cumsum(span) - span) >> (LIMIT - lengths[order].astype(np.int64))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each of the 16-bit prefixes."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << LIMIT, dtype=np.uint32), np.ones(1 << LIMIT, dtype=np.int64)
    symbol[: span.sum()] = np.repeat(order, span)
    length[: span.sum()] = np.repeat(lengths[order], span)
    return symbol, length


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every CHECKPOINT-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    # a code and its shift inside a byte fit three bytes; codes do not overlap, so adding is setting bits
    windows = codes[ids] << (24 - size - (start & 7))
    n_bytes = int(end[-1] + 7 >> 3) if len(ids) else 0
    sums = np.bincount(start >> 3, weights=windows, minlength=n_bytes).astype(np.int64)
    out = np.zeros(n_bytes + 2, dtype=np.int64)
    out[: len(sums)] += sums >> 16
    out[1 : len(sums) + 1] += sums >> 8 & 255
    out[2 : len(sums) + 2] += sums & 255
    return out[:n_bytes].astype(np.uint8).tobytes(), start[::CHECKPOINT]


def decode_ids(stream: bytes, checkpoints: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    symbol, length = table
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    windows = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    lanes = len(checkpoints)
    out = np.empty((lanes, CHECKPOINT), dtype=np.uint32)
    at = np.asarray(checkpoints, dtype=np.int64).copy()
    last = count - (lanes - 1) * CHECKPOINT
    for step in range(CHECKPOINT if lanes > 1 else count):
        if step == last:  # the last lane has no more
            lanes -= 1
            at = at[:lanes]
        prefix = windows[at >> 3] >> (8 - (at & 7)) & 0xFFFF
        out[:lanes, step] = symbol[prefix]
        at += length[prefix]
    return out.ravel()[:count]


def _squeeze(ids: bytes) -> bytes:
    """Low bytes, then high bytes, compressed; for the stage and the shuffle only. An id of more than 16 bits is an error."""
    wide = np.frombuffer(ids, dtype="<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"token id {wide.max()} does not fit the 16 bits in which ids are staged")
    planes = wide.astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(2, -1)
    return planes[0].astype(np.int64) | planes[1].astype(np.int64) << 8


def token_ids(documents: DataFrame, tokenizer: str, blanks: bool, end: int) -> DataFrame:
    """doc_id, n, ids (squeezed) of every whole text and the id ``end``; null and empty texts are the end id alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stop = np.array([end], dtype="<u4").tobytes()
        found = [ids + stop for ids in encoder(tokenizer, blanks).encode(texts(batch.column("text")))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(f) // 4 for f in found], pa.int64()),
             pa.array([_squeeze(f) for f in found], pa.binary())], ["doc_id", "n", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(per_batch(run), f"doc_id {kind}, n long, ids binary")


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        rows = [_unsqueeze(b) for b in batch.column("ids").to_pylist()]
        if rows:
            total += np.bincount(np.concatenate(rows), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "count"])


def _encode_blocks(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, codes: np.ndarray, kind: pa.DataType):
    names = ["part", "block", "doc_ids", "counts", "n_tokens", "checkpoints", "stream"]
    part, block = TaskContext.get().partitionId(), 0
    docs: list = []
    rows: list[np.ndarray] = []
    pending = 0

    def close() -> pa.RecordBatch:
        stream, checkpoints = encode_ids(np.concatenate(rows), lengths, codes)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(kind)),
             pa.array([[len(r) for r in rows]], pa.list_(pa.int64())), pa.array([pending], pa.int64()),
             pa.array([checkpoints], pa.list_(pa.int64())), pa.array([stream], pa.binary())], names)

    for batch in batches:
        for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            docs.append(doc)
            rows.append(_unsqueeze(packed))
            pending += len(rows[-1])
            if pending >= BLOCK:
                yield close()
                docs, rows, pending, block = [], [], 0, block + 1
    if docs:
        yield close()


def write(documents: DataFrame, path: str, tokenizer: str, blanks: bool, end: int) -> None:
    """Tokenise ``documents`` and write them below ``path``: ``blocks``, ``lengths`` and ``index``.

    Rows without an id come first; rows that repeat an id follow each other. No rows: empty tables.
    """
    spark = documents.sparkSession
    staged = cut_lineage(token_ids(documents, tokenizer, blanks, end))
    counts = np.zeros(1 << 16, dtype=np.int64)
    # at most one number per id of the vocabulary
    for r in staged.select("ids").mapInArrow(_count_ids, "id long, count long").groupBy("id").agg(F.sum("count").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    kind = staged.schema["doc_id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    sorted_rows = staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids").select("doc_id", "ids")
    sorted_rows.mapInArrow(
        lambda batches: _encode_blocks(batches, lengths, codes, arrow),
        f"part int, block int, doc_ids array<{kind}>, counts array<long>, n_tokens long, checkpoints array<long>, stream binary",
    ).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.mode("overwrite").parquet(f"{path}/lengths")
    # one number per file and block; tokens before a block
    blocks = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([b.n for b in blocks])]).astype(np.int64).tolist()
    spark.createDataFrame([(b.part, before[i]) for i, b in enumerate(blocks)], "part int, before long").write.mode(
        "overwrite").parquet(f"{path}/index")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files below ``path``."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first().lengths, dtype=np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                counts = np.asarray(row["counts"].values, dtype=np.int64)
                ids = decode_ids(row["stream"].as_py(), np.asarray(row["checkpoints"].values), int(counts.sum()), table)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(counts)
                columns = [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["block"].as_py()] * n, pa.int32()),
                           row["doc_ids"].values, pa.array(starts), pa.array(counts),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, block int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    rows = blocks.select("part", "block", "doc_ids", "counts", "checkpoints", "stream").mapInArrow(run, schema)
    from pyspark.sql import Window

    # tokens before a block of its file: one row per block, one small window per file
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.select("part", "block", "n_tokens")
        .withColumn("earlier", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
        .join(spark.read.parquet(f"{path}/index"), "part")
        .select("part", "block", (F.col("before") + F.col("earlier")).alias("base"))
    )
    extra = ["ids"] if keep_ids else []
    return rows.join(bases, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *extra
    )


def huffman_query(documents: DataFrame) -> DataFrame:
    path = scratch_path(documents.sparkSession, "tokens")
    write(documents, path, vocabulary("word_bpe_49k.json"), False, 2)
    return read(documents.sparkSession, path)
