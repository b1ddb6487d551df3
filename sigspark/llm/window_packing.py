"""Best-fit decreasing packing of token sequences into windows of one length, with next to no padding.

A document longer than a window is first cut into full windows; its rest is an item like a shorter document. Items are dealt by
a hash into blocks of bounded size and placed longest first: a segment tree over remaining capacities (one leaf per
capacity, an inner node says whether some open window lies below it) finds the tightest open window that has room.

Windows that are then still open are closed from the emptiest one: its items move into the room of the fullest ones, and an item that
does not fit is cut. So a block has one window left that is not full. A sequence whose length is a power of two needs no
padding, so that window is cut at the powers of two that add up to its length. All this is for the price of some cut items, at most one
for each open window and block; ``least_piece`` leaves smaller rooms as padding instead of filling them with slivers.

Ids are written once to the shared folder. Between tasks move ids of documents, lengths and checksums; the ids of an item are
fetched again only if it was cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import per_batch, texts
from sigspark.llm.tokens import encoder, vocabulary
from sigspark.session import cut_lineage

WINDOW = 2048
#: Items that one block packs.
BLOCK = 16_384
#: Cut items up to this size are sent to the ids; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 24
PIECES = ("at", "length", "sequence", "place")


class OpenWindows:
    """Numbers of open windows by remaining capacity, found through a segment tree."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def tightest(self, need: int) -> int:
        """The least capacity of ``need`` or more that an open window has, or -1."""
        some, node = self.some, self.size + need
        if some[node]:
            return need
        while node > 1:
            if not node & 1 and some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if some[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def put(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        node = self.size + capacity
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, capacity: int) -> int:
        number = self.at[capacity].pop()
        if not self.at[capacity]:
            some, node = self.some, self.size + capacity
            some[node] = 0
            node >>= 1
            while node and not (some[2 * node] or some[2 * node + 1]):
                some[node] = 0
                node >>= 1
        return number


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Items per window; ``lengths`` are 1 to ``window`` and come longest first."""
    open_, out = OpenWindows(window), []
    for item, need in enumerate(lengths):
        room = open_.tightest(need)
        if room < 0:
            room, number = window, len(out)
            out.append([])
        else:
            number = open_.take(room)
        out[number].append(item)
        if room > need:
            open_.put(room - need, number)
    return out


def close_windows(windows: list[list[tuple[int, int, int]]], window: int, least_piece: int = 1) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) pieces with the same tokens, all full but for rooms below ``least_piece``.

    The last one is cut into sequences whose lengths are powers of two.
    """
    fill = [sum(p[2] for p in w) for w in windows]
    done = [w for w, f in zip(windows, fill) if window - f < least_piece]
    left = sorted((f, w) for w, f in zip(windows, fill) if window - f >= least_piece)
    parts = [list(w) for _, w in left]
    room = [window - f for f, _ in left]
    front, back = len(left) - 1, 0
    while back < front:
        if room[front] < least_piece:
            done.append(parts[front])
            front -= 1
        elif not parts[back]:
            back += 1
        else:
            item, start, length = parts[back].pop()
            moved = min(length, room[front])
            parts[front].append((item, start, moved))
            room[front] -= moved
            room[back] += moved
            if moved < length:
                parts[back].append((item, start + moved, length - moved))
    for rest in parts[back : front + 1]:
        total, powers = sum(p[2] for p in rest), []
        if total == 0:
            continue
        if window - total < least_piece:
            done.append(rest)
            continue
        queue = rest[::-1]
        for power in [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]:
            own = []
            while power:
                item, start, length = queue.pop()
                taken = min(length, power)
                own.append((item, start, taken))
                power -= taken
                if taken < length:
                    queue.append((item, start + taken, length - taken))
            powers.append(own)
        done += powers
    return done


def _fit_block(group: pa.Table, window: int, least_piece: int) -> pa.Table:
    length = group.column("length").to_numpy()
    order = np.lexsort((group.column("item").to_numpy(), -length))
    sizes = length[order].tolist()
    closed = close_windows([[(i, 0, sizes[i]) for i in w] for w in best_fit_decreasing(sizes, window)], window, least_piece)
    block = group.column("block")[0].as_py() if group.num_rows else 0
    pieces: list[list[dict]] = [[] for _ in sizes]
    for number, parts in enumerate(closed):
        place = 0
        for i, at, n in parts:
            pieces[order[i]].append({"at": at, "length": n, "sequence": (block << 24 | number) * 2 + 1, "place": place})
            place += n
    struct = pa.struct([(c, pa.int64()) for c in PIECES])
    return group.append_column("pieces", pa.array(pieces, pa.list_(struct)))


def windows_of(documents: DataFrame, tokenizer: str, blanks: bool, end: int, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: full windows of every document (without ids) and its rest (with ids).

    A document is the ids of its whole text and ``end``; a null or empty text is ``end`` alone. ``ids`` takes two bytes an id if
    the vocabulary allows that.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(tokenizer, blanks)
        small = "<u2" if coder.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        rows, start, length, crc, total, ids = [], [], [], [], [], []
        for i, found in enumerate(coder.arrays(texts(batch.column("text")))):
            found = np.append(found, np.uint32(end)).astype("<u4")
            for a in range(0, len(found), window):
                part = found[a : a + window]
                rows.append(i)
                start.append(a)
                length.append(len(part))
                crc.append(zlib.crc32(part))
                total.append(len(found))
                ids.append(None if len(part) == window else part.astype(small).tobytes())
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return documents.select("doc_id", "text").mapInArrow(per_batch(run), schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece of the cut items, with the checksum of its ids."""
    for batch in batches:
        rows, columns = [], {c: [] for c in ("start", "length", "ids_crc32", "sequence_id", "offset")}
        values = zip(*[batch.column(c).to_pylist() for c in ("start", "length", "ids", "pieces")])
        for i, (start, length, raw, pieces) in enumerate(values):
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")
            for p in pieces:
                rows.append(i)
                found = p["at"] + start, p["length"], zlib.crc32(ids[p["at"] : p["at"] + p["length"]]), p["sequence"], p["place"]
                for c, v in zip(columns.values(), found):
                    c.append(v)
        at = pa.array(rows, pa.int64())
        out = {"doc_id": batch.column("doc_id").take(at), "doc_tokens": batch.column("doc_tokens").take(at)}
        out |= {c: pa.array(v, pa.int64()) for c, v in columns.items()}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def pack_windows(
    documents: DataFrame, tokenizer: str, blanks: bool, end: int, window: int = WINDOW, block: int = BLOCK, least_piece: int = 1
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Every row of ``documents`` is packed by itself, so repeated and null ids are no special case; ties in length go by row
    number. No documents, no rows. Other columns are ignored. ``block`` is at most 2^23.
    """
    staged = cut_lineage(
        windows_of(documents, tokenizer, blanks, end, window).withColumn("item", F.monotonically_increasing_id())
    )
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "item"]
    rest = staged.where(F.col("length") < window).select(*own)
    blocks = max(1, -(-rest.count() // block))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long"))
    pieces = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in PIECES]))
    schema = T.StructType([*dealt.schema.fields, T.StructField("pieces", pieces)])
    placed = cut_lineage(dealt.groupBy("block").applyInArrow(lambda group: _fit_block(group, window, least_piece), schema))
    whole = placed.where(F.size("pieces") == 1).select(
        *own[:-1], F.col("pieces")[0]["sequence"].alias("sequence_id"), F.col("pieces")[0]["place"].alias("offset")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    # counted first; every piece of an item has a token, and all cut items together few more pieces than windows
    several = placed.where(F.size("pieces") > 1)
    size = several.agg(F.count("*").alias("items"), F.sum(F.size("pieces")).alias("pieces")).first()
    if 100 * size["items"] + 40 * (size["pieces"] or 0) <= BROADCAST_BYTES:
        several = F.broadcast(several)
    cut = (
        staged.where(F.col("ids").isNotNull())
        .select("item", "ids")
        .join(several, "item")
        .select("doc_id", "start", "length", "doc_tokens", "ids", "pieces")
        .mapInArrow(_cut, f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    full = staged.where(F.col("length") == window).select(
        *own[:-1], (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(whole).unionByName(cut)


def windows_query(documents: DataFrame) -> DataFrame:
    return pack_windows(documents, vocabulary("word_bpe_49k.json"), False, 1)
