"""Near-duplicate lines over all documents by a segment-partition edit join, in DataFrame functions only.

Two lines are linked if at most ``edits`` insertions, deletions or substitutions of code points turn one into the other. A
line is cut into ``edits`` + 1 segments; a line within the threshold contains at least one segment of the other unchanged,
at a place that the difference of lengths narrows down. So every line is indexed by (length, segment number, segment)
and probes the index, for every shorter length within the threshold, with the substrings that can be that segment. Lines
that meet are verified by a banded bit-parallel edit distance over what lies between their common ends.

No list of all lines that share a segment is made. A first, semi join leaves the lines that meet another one, a row per key.
Of these, neighbours in the order of the lines, read forwards and backwards, are verified and their components found. Then
lines of different components meet by segment and by what else two edits leave unchanged, and are listed if the parities of
their characters and pairs of characters allow it. Links inside a component found before would not change it.

Only 64-bit hashes of segments and lines are shuffled. Copies of a line are one entry: frequent lines are
counted first, and a bounded list of the most frequent ones keeps their copies out of the join before the shuffle; others
are made distinct behind it. Texts are read again for candidate lines only.

The first occurrence, by (doc_id, line number), of every connected component of lines stays; later ones are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import let
from sigspark.llm.components import components
from sigspark.session import cut_lineage

#: Lines below this many code points are too short to be near duplicates of each other and stay.
SHORTEST = 24
#: The list of frequent lines and a broadcast of candidate lines are at most this long; other lines take the way without.
LISTED = 50_000


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line of the lines that can be duplicates; documents without an id take no part."""
    return (
        documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .withColumn("n", F.length("line"))
        .where(F.col("n") >= SHORTEST)
    )


def _ids(lines: DataFrame) -> DataFrame:
    """With a 128-bit identity of the line in two columns."""
    return lines.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(7), "line")})


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, length) of a segment of a line of ``length``; the last ones are the longer."""
    short = F.floor(length / parts).cast("int")
    shorter_ones = parts - (length - short * parts)
    start = short * number + F.greatest(F.lit(0), number - shorter_ones) + 1
    return start.cast("int"), (short + (number >= shorter_ones).cast("int")).cast("int")


def _wide(line: str, length: str) -> Column:
    """Two bytes a code point, so that a place in the line is a place in the bytes. Those beyond 16 bits become one sign.

    Equal substrings have equal bytes, which is what keys and rests need; lines that meet are compared as they are.
    """
    fitting = F.when(F.octet_length(line) == F.col(length), F.col(line))
    return F.encode(fitting.otherwise(F.regexp_replace(line, "[^\\x{0}-\\x{FFFF}]", "\ufffd")), "UTF-16BE")


def _part(start: Column, size: Column) -> Column:
    """Hash of a substring in code points."""
    return F.xxhash64(F.substring(F.col("wide"), F.shiftleft(start, 1) - 1, F.shiftleft(size, 1)))


def _pieces_of_one(i: Column, start: Column, size: Column, whole: Column, n: Column) -> list[tuple[Column, Column]]:
    """(start, length) of the two halves of what a threshold of one edit leaves beside segment ``i``."""
    half = F.floor((whole - size) / 2).cast("int")
    other = (whole - size - half).cast("int")
    begin = F.when(i == 0, start + size).otherwise(1)
    end = F.when(i == 0, n).otherwise(start - 1)
    return [(begin, half), (end - other + 1, other)]


def _pieces_of_two(rows: DataFrame) -> DataFrame:
    """With from0, long0 to from4, long4: the five pieces that a threshold of two edits compares beside segment ``i``.

    Beside the middle segment each side has at most one edit: two halves of the left, two of the right. Beside an outer
    segment the other two thirds have both edits and are cut in three: the first piece counted from the left, the last
    from the right, or the middle one, moved by -1, 0 or 1, is unchanged. The indexed line's middle piece is not moved.
    Every value is a column of its own, else the code repeats them and grows too large to be compiled.
    """
    i, at, start, size, whole, n = (F.col(name) for name in ("i", "at", "start", "size", "whole", "n"))
    rows = rows.withColumns({
        "before": start - at - 1, "beside": whole - size, "middle": i == 1,
        "begin": F.when(i == 0, start + size).otherwise(1), "end": F.when(i == 0, n).otherwise(start - 1),
    })
    rows = rows.withColumn("after", F.col("beside") - F.col("before"))
    rows = rows.withColumns({
        "half": F.shiftright("before", 1), "last": F.shiftright("after", 1), "third": F.floor(F.col("beside") / 3).cast("int"),
    })
    before, beside, begin, end, after, half, last, third, middle = (
        F.col(name) for name in ("before", "beside", "begin", "end", "after", "half", "last", "third", "middle")
    )
    sides = [(begin, half), (start - before + half, before - half), (start + size, last), (n - after + last + 1, after - last)]
    outer = [(begin, third), *[(begin + third + F.lit(move) * (1 - F.col("held")), third) for move in (-1, 0, 1)]]
    pieces = {}
    for j, (a, b) in enumerate(zip(sides, outer)):
        pieces |= {f"from{j}": F.when(middle, a[0]).otherwise(b[0]), f"long{j}": F.when(middle, a[1]).otherwise(b[1])}
    return rows.withColumns(pieces | {"from4": end - beside + third + third + 1, "long4": beside - third - third})


#: The bit of ``rest`` that says that the row is an indexed line, not one that probes, and the one for the middle segment.
HELD, MIDDLE = 62, 60


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    """a, key, rest of every line for every (segment number, shift, shorter), as an indexed line and as one that probes.

    The key hashes segment number, indexed length and substring. ``rest`` serves thresholds of one and two edits: it has some
    bits of the hash of each piece of the line beside the segment, one or two of which are unchanged as well (see
    :func:`_ways`). One key a row keeps the generated code small enough to be compiled; all keys of a line in one
    expression took ten times as long.
    """
    looks = [(*look, 1) for look in index_looks(edits)] + [(*look, 0) for look in probe_looks(edits)]
    array = F.array(*[F.struct(*map(F.lit, look)) for look in looks])
    wide = lines.select("a", "n", _wide("line", "n").alias("wide"))
    rows = wide.select("a", "wide", "n", F.inline(array).alias("i", "at", "d", "held"))
    rows = rows.withColumn("whole", F.col("n") - F.col("d"))
    start, size = _segment(F.col("whole"), F.col("i"), edits + 1)
    rows = rows.withColumns({"start": start + F.col("at"), "size": size})
    rows = rows.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    i, start, size, whole, n = (F.col(name) for name in ("i", "start", "size", "whole", "n"))
    key = F.xxhash64(_part(start, size), whole, i)
    rest = F.shiftleft(F.col("held").cast("long"), HELD)
    if edits == 1:
        for j, piece in enumerate(_pieces_of_one(i, start, size, whole, n)):
            rest = rest.bitwiseOR(F.shiftleft(_part(*piece).bitwiseAND(0x3FFFFFFF), 30 * j))
    elif edits == 2:
        rows = _pieces_of_two(rows)
        rest = rest.bitwiseOR(F.shiftleft((i == 1).cast("long"), MIDDLE))
        for j in range(5):
            piece = _part(F.col(f"from{j}"), F.col(f"long{j}"))
            rest = rest.bitwiseOR(F.shiftleft(piece.bitwiseAND(0xFFF), 12 * j))
    return rows.select("a", key.alias("key"), rest.alias("rest"))


def _ways(edits: int, middle: bool) -> list[int]:
    """Masks of ``rest``: of two lines with the same key within the threshold, the bits under one of them are equal.

    One edit: either half is unchanged. Two edits: beside the middle segment a half on each side is unchanged, beside an
    outer one any of the pieces.
    """
    if edits == 1:
        return [0x3FFFFFFF, 0x3FFFFFFF << 30]
    if edits != 2:
        return [0]
    if middle:
        return [0xFFF << 12 * left | 0xFFF << 12 * right for left in (0, 1) for right in (2, 3)]
    return [0xFFF << 12 * j for j in range(5)]


def _by_place(rest: Column, edits: int, choose: Callable[[list[int]], Column]) -> Column:
    """``choose`` of the ways beside the middle segment or an outer one, whichever ``rest`` belongs to."""
    if edits != 2:
        return choose(_ways(edits, False))
    middle = F.shiftrightunsigned(rest, MIDDLE).bitwiseAND(1) == 1
    return F.when(middle, choose(_ways(edits, True))).otherwise(choose(_ways(edits, False)))


def _first_way(one: Column, other: Column, edits: int) -> Column:
    """The first way in which ``rest`` of two lines with the same key agrees, null if they cannot be within the threshold."""
    apart = one.bitwiseXOR(other)
    return _by_place(one, edits, lambda masks: F.coalesce(*[F.when(apart.bitwiseAND(m) == 0, w) for w, m in enumerate(masks)]))


def index_looks(edits: int) -> list[tuple[int, int, int]]:
    return [(i, 0, 0) for i in range(edits + 1)]


def probe_looks(edits: int) -> list[tuple[int, int, int]]:
    """All substrings that a segment of a line up to ``edits`` shorter can be.

    With i segments before the one that is looked for, at most i edits precede it or at most ``edits`` - i follow it, which
    bounds the shift from the left by i and from the right by ``edits`` - i (the multi-match-aware windows).
    """
    return [
        (i, shift, shorter)
        for shorter in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)
    ]


def within(chars: Column, others: Column, edits: int) -> Column:
    """Whether two arrays of characters are at most ``edits`` edits apart: bit-parallel over the band of 2 x ``edits`` + 1 diagonals.

    Bit d of the e-th mask says that the prefixes of ``others`` of length j and of ``chars`` of length j + d - ``edits`` are at
    most e edits apart. A character of ``others`` moves all diagonals at once: where the characters agree a bit stays,
    a substitution keeps its diagonal, an insertion shifts it down and a deletion up.
    """
    band = (1 << (2 * edits + 1)) - 1

    def up(mask: Column) -> Column:
        return F.shiftleft(mask, 1).bitwiseAND(band)

    def pack(masks: list[Column]) -> Column:
        return F.struct(*[m.cast("int").alias(f"e{k}") for k, m in enumerate(masks)])

    start = [F.lit(1 << edits)]
    for _ in range(edits):
        start.append(start[-1].bitwiseOR(up(start[-1])))

    def advance(state: Column, match: Column) -> Column:
        masks: list[Column] = []
        for k in range(edits + 1):
            now = state[f"e{k}"].bitwiseAND(match)
            if k:
                less = state[f"e{k - 1}"]
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(up(masks[k - 1]))
            masks.append(now)
        return pack(masks)

    def step(state: Column, j: Column) -> Column:
        char = F.get(others, j)
        match = F.lit(0)
        for d in range(2 * edits + 1):
            same = F.coalesce(F.get(chars, j + (d - edits)) == char, F.lit(False))
            match = match.bitwiseOR(F.when(same, 1 << d).otherwise(0))
        # once no diagonal is within reach none will be, and the rest of the characters is passed over
        return F.when(state[f"e{edits}"] == 0, state).otherwise(let(match, lambda m: advance(state, m)))

    last = F.aggregate(F.sequence(F.lit(0), F.size(others) - 1), pack(start), step)
    off = F.size(chars) - F.size(others)
    return (F.abs(off) <= edits) & (
        F.call_function("shiftright", last[f"e{edits}"], off + edits).bitwiseAND(1) == 1
    )


def _agreeing(room: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The largest number up to ``room`` for which the lines agree, found by halving steps.

    ``same`` says of a length that is known to agree and a step whether the next ``step`` characters agree as well.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def grow(known: Column, step: Column) -> Column:
        return F.when((step <= room - known) & same(known, step), known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), grow)


def near_lines(one: Column, other: Column, edits: int) -> Column:
    """:func:`within` for two lines. What they share at both ends, which no edit need touch, is taken off first.

    The ends are compared as substrings, so the character loop runs over the part between the outermost edits only.
    """

    def between(head: Column) -> Column:
        n1, n2 = F.length(one) - head, F.length(other) - head

        def tail(known: Column, step: Column) -> Column:
            ends = [F.substring(line, F.length(line) - known - step + 1, step) for line in (one, other)]
            return ends[0] == ends[1]

        def middle(shared: Column) -> Column:
            chars = [F.split(F.substring(line, head + 1, n - shared), "") for line, n in ((one, n1), (other, n2))]
            shortest, longest = F.least(n1, n2) - shared, F.greatest(n1, n2) - shared
            full = let(chars[0], lambda a: let(chars[1], lambda b: within(a, b, edits)))
            # nothing is left of one line, so all that is left of the other is inserted
            return F.when(shortest == 0, longest <= edits).otherwise(full)

        return let(_agreeing(F.least(n1, n2), tail), middle)

    def start(known: Column, step: Column) -> Column:
        return F.substring(one, known + 1, step) == F.substring(other, known + 1, step)

    head = _agreeing(F.least(F.length(one), F.length(other)), start)
    return (F.abs(F.length(one) - F.length(other)) <= edits) & let(head, between)


def _meeting(lines: DataFrame, edits: int) -> DataFrame:
    """key, a, rest, held of the lines that meet another one under a key, as an indexed line (held = 1) or as one that probes.

    A line is one row per key however many others it meets there. Keys of one line only, nearly all, go before copies are
    made distinct.
    """
    here = Window.partitionBy("key")
    marks = {"low": F.min("a").over(here), "high": F.max("a").over(here), "most": F.max("rest").over(here)}
    rows = _keyed(lines, edits).withColumns(marks).where((F.col("low") < F.col("high")) & (F.col("most") >= 1 << HELD))
    rows = cut_lineage(rows.select("key", "a", "rest").distinct())
    rows = rows.withColumn("held", F.shiftrightunsigned("rest", HELD).cast("int"))
    held, asked = rows.where("held = 1"), rows.where("held = 0")

    def meets(some: DataFrame, others: DataFrame) -> DataFrame:
        others = others.select(F.col("key").alias("__key"), F.col("a").alias("__a"), F.col("rest").alias("__rest"))
        near = _first_way(F.col("rest"), F.col("__rest"), edits).isNotNull()
        return some.join(others, (F.col("key") == F.col("__key")) & (F.col("a") != F.col("__a")) & near, "left_semi")

    return meets(held, asked).unionByName(meets(asked, held))


def _parities(line: str) -> dict[str, Column]:
    """``one`` and ``two``: for 64 classes of characters, and of neighbouring characters, whether their number is odd.

    An edit takes out or puts in at most two characters and four pairs of neighbours, and changes no more bits than these.
    """
    chars = F.split(line, "")

    def parity(of: Callable[[Column, Column, Column], Column]) -> Column:
        def bits(array: Column) -> Column:
            return F.transform(
                array, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), of(array, c, i).bitwiseAND(63).cast("int"))
            )

        return F.aggregate(let(chars, bits), F.lit(0).cast("long"), lambda sum, bit: sum.bitwiseXOR(bit))

    return {
        "one": parity(lambda array, c, i: F.xxhash64(c)),
        "two": parity(lambda array, c, i: F.xxhash64(c, F.get(array, i + 1))),
    }


def _neighbours(texts: DataFrame, edits: int) -> DataFrame:
    """a1, a2 of the lines that follow each other in the order of the lines, or of the lines read backwards.

    Of a dense group this finds, with two pairs a line, most of what connects it. Where a task's range ends a pair is left
    out; no result rests on these pairs alone.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for by in (F.col("line"), F.reverse("line")):
        ranged = texts.select("a", "one", "two", by.alias("by")).repartitionByRange(parts, "by")
        follows = Window.partitionBy("at").orderBy("by")
        rows = ranged.withColumn("at", F.spark_partition_id()).withColumns(
            {"a0": F.lag("a").over(follows), "one0": F.lag("one").over(follows), "two0": F.lag("two").over(follows)}
        )
        rows = rows.where(_few_changes(edits, "one", "one0", "two", "two0"))
        rows = rows.select(F.least("a", "a0").alias("a1"), F.greatest("a", "a0").alias("a2"))
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _few_changes(edits: int, one: str, other_one: str, two: str, other_two: str) -> Column:
    """Whether the parities of two lines leave it open that they are within the threshold."""
    ones = F.bit_count(F.col(one).bitwiseXOR(F.col(other_one)))
    twos = F.bit_count(F.col(two).bitwiseXOR(F.col(other_two)))
    return (ones <= 2 * edits) & (twos <= 4 * edits)


def _pairs(met: DataFrame, edits: int) -> DataFrame:
    """a1, a2 of lines not known to be connected that meet under a key, agree in one way of ``rest`` and in their parities.

    Lines meet by key and way, and only in the first way that they agree in.
    """
    def buckets(masks: list[int]) -> Column:
        return F.array(*[
            F.struct(F.lit(way).alias("way"), F.xxhash64("key", F.lit(way), F.col("rest").bitwiseAND(mask)).alias("bucket"))
            for way, mask in enumerate(masks)
        ])

    dealt = met.select("a", "rest", "held", "one", "two", "known", F.inline(_by_place(F.col("rest"), edits, buckets)))
    held = dealt.where("held = 1").select("bucket", *[F.col(c).alias(c + "1") for c in ("way", "a", "rest", "one", "two", "known")])
    asked = dealt.where("held = 0").select("bucket", *[F.col(c).alias(c + "2") for c in ("a", "rest", "one", "two", "known")])
    test = (held["bucket"] == asked["bucket"]) & (F.col("known1") != F.col("known2"))
    test = test & _few_changes(edits, "one1", "one2", "two1", "two2") & (F.col("way1") == _first_way(F.col("rest1"), F.col("rest2"), edits))
    return held.join(asked, test).select(F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2")).distinct()


def line_classes(documents: DataFrame, edits: int = 2) -> DataFrame:
    """One row per distinct line of at least SHORTEST code points: a, b (identity), copies, first, leader.

    ``first`` is the line's first place (doc_id, line_no), ``leader`` that of the first line of its component.
    """
    lines = _ids(_lines(documents))
    place = F.struct("doc_id", "line_no")
    counts = cut_lineage(lines.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(place).alias("first")))
    frequent = counts.where("copies >= 8").orderBy(F.desc("copies"), "a", "b").limit(LISTED)
    listed = F.broadcast(frequent.select("a", "b", F.col("first").alias("listed_first")))
    once = lines.join(listed, ["a", "b"], "left").where(F.col("listed_first").isNull() | (F.col("listed_first") == place))

    met = cut_lineage(_meeting(once, edits))
    wanted = met.select("a").distinct()
    needed = cut_lineage(counts.join(wanted, "a", "left_semi").select("a", "b", "first.doc_id", "first.line_no"))
    if needed.count() <= LISTED:
        needed = F.broadcast(needed)
    texts = lines.join(needed, ["doc_id", "line_no", "a", "b"]).select("a", place.alias("node"), "line").distinct()
    texts = cut_lineage(texts.withColumns(_parities("line")))

    left = texts.select(F.col("a").alias("a1"), F.col("node").alias("u"), F.col("line").alias("line1"))
    right = texts.select(F.col("a").alias("a2"), F.col("node").alias("v"), F.col("line").alias("line2"))

    def verified(pairs: DataFrame) -> DataFrame:
        """a1, a2, u, v of the pairs within the threshold."""
        near = near_lines(F.col("line1"), F.col("line2"), edits)
        return cut_lineage(pairs.join(left, "a1").join(right, "a2").where(near).select("a1", "a2", "u", "v"))

    chained = verified(_neighbours(texts, edits))
    known = components(chained, "a1", "a2").withColumnsRenamed({"node": "a", "component": "known"})
    marked = texts.join(known, "a", "left").select("a", "one", "two", F.coalesce("known", "a").alias("known"))
    apart = verified(cut_lineage(_pairs(met.join(marked, "a"), edits)))
    links = chained.unionByName(apart).select("u", "v")
    linked = components(links, "u", "v").withColumnsRenamed({"node": "first", "component": "leader"})
    return counts.join(linked, "first", "left").withColumn("leader", F.coalesce("leader", "first"))


def removed_lines(documents: DataFrame, edits: int = 2) -> DataFrame:
    """doc_id, removed (ascending line numbers) of the documents that lose lines."""
    classes = line_classes(documents, edits).where("copies > 1 or first <> leader").select("a", "b", "leader")
    lines = _ids(_lines(documents)).select("a", "b", "doc_id", "line_no")
    gone = lines.join(classes, ["a", "b"]).where(F.struct("doc_id", "line_no") != F.col("leader"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def without_duplicates(documents: DataFrame, edits: int = 2) -> DataFrame:
    """``documents`` with the removed lines cut out of their texts; all other columns and texts as they were.

    A null or empty text has no lines to lose. Rows that repeat an id are the same document and lose the same lines. Rows
    without an id stay as they are. A column n_chars, where there is one, is the length of the new text.
    """
    gone = removed_lines(documents, edits).withColumnsRenamed({"doc_id": "__doc", "removed": "__removed"})
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__removed", i))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = documents.join(gone, documents["doc_id"] == gone["__doc"], "left").withColumn("text", text)
    if "n_chars" in documents.columns:
        size = F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        joined = joined.withColumn("n_chars", size.cast(documents.schema["n_chars"].dataType))
    return joined.select(*documents.columns)


def line_query(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined)."""
    gone = removed_lines(documents).withColumnRenamed("doc_id", "__doc")
    lines = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return lines.join(gone, F.col("doc_id") == F.col("__doc"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
    )
