"""File-held-out splits, balanced tiers and class subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.hashing import digest, hash_below
from sigspark.operators.audit import crosses_splits, missing_cells
from sigspark.operators.metrics import merge_rows
from sigspark.operators.prefix import first_k, with_row_number, with_running_sums
from sigspark.session import cut_lineage
from sigspark.sources.manifests import SPLITS

# An assignment names at most one file per selected read; below this many rows it is sent to every task.
BROADCAST_ROWS = 100_000


def assign_groups(manifest: DataFrame, *, targets: Mapping[str, int], cap: int, seed: int) -> DataFrame:
    """Give whole files to splits until each (class, split) can fill its target.

    Files of a class are taken in seeded hash order; a file counts at most ``cap`` reads; what the last file of a split
    has too much is not carried over. The running sum over files is computed once; each split then starts at the first
    file after the previous split.
    """
    files = (
        manifest.groupBy("barcode", "ccf_file")
        .agg(F.count(F.lit(1)).alias("available_reads"))
        .withColumn("usable", F.least("available_reads", F.lit(cap)))
        .withColumn("at", digest(seed, F.col("barcode"), F.col("ccf_file")))
    )
    placed = with_running_sums(files, ["barcode"], ["at", "ccf_file"], {"upto": "usable"})
    before = (F.col("upto") - F.col("usable")).alias("before")
    # one row per file, read once per split
    rest = cut_lineage(placed.select("barcode", "ccf_file", "available_reads", "usable", before))
    rest = rest.withColumn("start", F.lit(0).cast("long"))
    assigned = None
    for split, target in targets.items():
        filled = F.col("before") - F.col("start")
        chosen = rest.where(filled < target).select(
            "barcode",
            "ccf_file",
            F.lit(split).alias("split"),
            "available_reads",
            F.least(F.col("usable"), F.lit(target) - filled).cast("long").alias("selected_cap"),
        )
        assigned = chosen if assigned is None else assigned.unionByName(chosen)
        left = rest.where(filled >= target).drop("start")
        rest = left.join(left.groupBy("barcode").agg(F.min("before").alias("start")), "barcode")
    return assigned


def require_targets(selected: DataFrame, classes: Sequence[str], targets: Mapping[str, int]) -> None:
    """Raise when a class ran out of files or reads."""
    short = missing_cells(selected, classes, targets).orderBy("barcode", "split").limit(10).collect()
    if short:
        raise ValueError(f"not enough reads: {[(r.barcode, r.split, r.missing) for r in short]}")


def group_split(
    manifest: DataFrame, assignment: DataFrame, *, targets: Mapping[str, int], cap: int, order: Sequence[str],
    n_classes: int,
) -> DataFrame:
    """Rows of assigned files: first row of each read, at most ``cap`` per file and the target per (class, split)."""
    files = assignment.select("barcode", "ccf_file", F.col("split").alias("assigned"))
    if n_classes * sum(targets.values()) <= BROADCAST_ROWS:
        files = F.broadcast(files)
    rows = manifest.drop("split").join(files, ["barcode", "ccf_file"]).withColumnRenamed("assigned", "split")
    rows = first_k(rows, ["read_id"], order, 1, "occurrence").drop("occurrence")
    rows = first_k(rows, ["barcode", "ccf_file"], order, cap, "in_file").drop("in_file")
    return take_targets(rows, targets, order, "split_order").withColumn("split_order", F.col("split_order") - 1)


def take_targets(
    rows: DataFrame, targets: Mapping[str, int], order: Sequence[str | Column], name: str
) -> DataFrame:
    """The first rows of every (class, split), as many as the target of the split."""
    ranked = first_k(rows, ["barcode", "split"], order, max(targets.values()), name, hot=True)
    return ranked.where(F.col(name) <= _target(targets))


def _target(targets: Mapping[str, int]) -> Column:
    target = F.lit(None).cast("long")
    for split, count in targets.items():
        target = F.when(F.col("split") == split, F.lit(int(count))).otherwise(target)
    return target


def split_order(rows: DataFrame, order: Sequence[str | Column], split: str = "split") -> DataFrame:
    """0-based position of every row in its (class, split)."""
    numbered = with_row_number(rows, ["barcode", split], order, "split_order")
    return numbered.withColumn("split_order", F.col("split_order") - 1)


def round_robin(
    manifest: DataFrame, *, targets: Mapping[str, int], seed: int, order: Sequence[str]
) -> DataFrame:
    """Balanced tier: one read of every file in turn, files and reads in seeded hash order, up to the target.

    How many reads each file gives follows from the sizes of the files alone. So the manifest is staged once, and only rows of files that
    give any, at most as many files per (class, split) as its target, are hashed and put in order.
    """
    keys = ["barcode", "split", "ccf_file"]
    rows = cut_lineage(manifest.where(F.col("split").isin(*targets)))
    shares = cut_lineage(_shares(rows, targets, seed))
    if shares.count() <= BROADCAST_ROWS:
        shares = F.broadcast(shares)
    hashed = _join_null_safe(rows, shares, keys).withColumns(
        {"at_file": digest(seed, "group", F.col("ccf_file")), "at_read": digest(seed, "read", F.col("read_id"))}
    )
    lap = first_k(hashed, keys, ["at_read", *order], max(targets.values()), "lap").where(F.col("lap") <= F.col("share"))
    chosen = take_targets(lap, targets, ["lap", "at_file"], "split_order")
    return chosen.withColumn("split_order", F.col("split_order") - 1).drop("at_file", "at_read", "lap", "share")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    condition = reduce(and_, [left[k].eqNullSafe(right[renamed]) for k, renamed in names.items()])
    return left.join(right, condition, how).drop(*names.values())


def _shares(rows: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """(barcode, split, ccf_file, share): how many reads each file gives to its tier, without the files that give none.

    Every file gives its reads up to lap ``whole``, the last lap that leaves the target unmet; of the files that have more, the first
    ``extra`` in hash order give one more.
    """
    cell, keys = ["barcode", "split"], ["barcode", "split", "ccf_file"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("target", _target(targets))
    files = cut_lineage(sizes)
    # no more sizes per (class, split) than its target
    upward = Window.partitionBy(*cell).orderBy("size")
    laps = files.groupBy(*cell, "target", F.least("n", "target").alias("size")).agg(F.count(F.lit(1)).alias("files")).select(
        *cell, "target", "size",
        F.coalesce(F.sum(F.col("size") * F.col("files")).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"),
        F.sum("files").over(upward.rowsBetween(0, Window.unboundedFollowing)).alias("larger"),
    )
    open_ = F.col("target") - F.col("smaller")
    whole = F.floor((open_ - 1) / F.col("larger"))
    met = laps.where(F.col("size") * F.col("larger") >= open_)
    last = met.groupBy(*cell).agg(
        F.min(F.struct("size", whole.alias("whole"), (open_ - whole * F.col("larger")).alias("extra"))).alias("last")
    ).select(*cell, "last.whole", "last.extra")
    files = _join_null_safe(files, last, cell, "left")
    more = files.where(F.col("n") > F.col("whole")).withColumn("at_file", digest(seed, "group", F.col("ccf_file")))
    more = first_k(more, cell, ["at_file"], max(targets.values()), "nth", hot=True).where(F.col("nth") <= F.col("extra"))
    files = _join_null_safe(files, more.select(*keys, F.lit(1).alias("one")), keys, "left")
    share = F.coalesce(F.least("n", "whole"), F.col("n")) + F.coalesce("one", F.lit(0))
    return files.select(*keys, share.alias("share")).where("share > 0")


def first_files(
    manifest: DataFrame, *, files_per_class: int, reads_per_file: int, eval_reads: int, order: Sequence[str]
) -> DataFrame:
    """Tiny subset: first files and first reads per file for train, first reads per class for val and test."""
    train = manifest.where(F.col("split") == "train")
    names = train.select("barcode", "ccf_file").distinct()
    files = first_k(names, ["barcode"], ["ccf_file"], files_per_class, "file_rank").drop("file_rank")
    few = train.join(files, ["barcode", "ccf_file"], "left_semi")
    few = first_k(few, ["barcode", "ccf_file"], order, reads_per_file, "nth")
    held_out = first_k(
        manifest.where(F.col("split").isin("val", "test")), ["split", "barcode"], order, eval_reads, "nth", hot=True
    )
    return few.unionByName(held_out).drop("nth")


def class_position(classes: Sequence[str], name: Column) -> Column:
    """Position of a class in an ordered list, NULL when it is not in the list."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), name) - 1
    return F.when(at >= 0, at).cast("int")


def subset_classes(manifest: DataFrame, ordered: Sequence[str]) -> DataFrame:
    """Rows of the listed classes; the label becomes the position in the list."""
    return manifest.where(F.col("barcode").isin(*ordered)).withColumn("label", class_position(ordered, F.col("barcode")))


def nested_subsets(manifest: DataFrame, ordered: Sequence[str], k_min: int) -> DataFrame:
    """Every subset of the first k classes, k from ``k_min`` up, tagged with ``class_count``.

    A row is repeated once per subset that contains its class.
    """
    at = class_position(ordered, F.col("barcode"))
    smallest = F.greatest(F.lit(k_min), F.col("label") + 1)
    return (
        manifest.withColumn("label", at)
        .where("label IS NOT NULL")
        .withColumn("class_count", F.explode(F.sequence(smallest, F.lit(len(ordered)))))
    )


def subset_audit(manifest: DataFrame, ordered: Sequence[str], k_min: int) -> DataFrame:
    """Rows per split, and reads and files shared between splits, of every nested subset."""
    rows = nested_subsets(manifest, ordered, k_min)

    def parts(keys: Sequence[str], name: str, sizes: bool) -> DataFrame:
        n = [F.sum((F.col("split") == s).cast("long")).alias(s) for s in SPLITS] if sizes else []
        per_key = rows.groupBy("class_count", *keys).agg(crosses_splits("split").alias("crosses"), *n)
        totals = [F.sum(s).alias(f"{s}_rows") for s in SPLITS] if sizes else []
        return per_key.groupBy("class_count").agg(F.sum(F.col("crosses").cast("long")).alias(name), *totals)

    return merge_rows(
        [
            parts(["read_id"], "read_overlap", False),
            parts(["barcode", "ccf_file"], "file_overlap", True),
        ],
        ["class_count"],
    )


def greedy_order(distances: DataFrame, anchors: tuple[str, str]) -> DataFrame:
    """Anchors first, then always the class farthest (max-min) from those already chosen; ties to the larger name.

    ``distances`` has one (src, dst, distance) row per ordered class pair, so the classes^2 table fits in one row and the
    loop is a fold inside it.
    """
    if anchors[0] == anchors[1]:
        raise ValueError("anchors must differ")
    matrix = distances.agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("src", "dst"), "distance"))).alias("m"),
        F.array_sort(F.collect_set("src")).alias("classes"),
    )

    def farthest(chosen: Column) -> Column:
        rest = F.array_except(F.col("classes"), chosen)
        scored = F.transform(
            rest,
            lambda c: F.struct(
                F.array_min(F.transform(chosen, lambda s: F.element_at("m", F.struct(c.alias("src"), s.alias("dst"))))).alias("d"),
                c.alias("name"),
            ),
        )
        return F.array_max(scored)["name"]

    start = F.array(F.lit(anchors[0]), F.lit(anchors[1]))
    steps = F.slice(F.col("classes"), 1, F.size("classes") - 2)
    order = F.aggregate(steps, start, lambda chosen, _: F.array_append(chosen, farthest(chosen)))
    return matrix.select(F.posexplode(order).alias("position", "barcode"))


def cross_file_pairs(
    rows: DataFrame, *, seed: int, order: Sequence[str], n_pairs: int | None = None
) -> DataFrame:
    """Seeded training pairs: same class, two different files, one read of each; half as many pairs as rows by default.

    Pair p takes the classes in turn. Rows are numbered once per class, file by file, so a file is a range of positions and a
    draw is one position: both sides of all pairs are looked up in one equi-join; no group is ever joined with itself.
    """
    numbered = with_row_number(
        rows.select(*dict.fromkeys(["barcode", "ccf_file", "read_id", *order])), ["barcode"], ["ccf_file", *order], "at"
    )
    numbered = cut_lineage(numbered.select("barcode", "ccf_file", "read_id", "at"))
    files = numbered.groupBy("barcode", "ccf_file").agg(F.count(F.lit(1)).alias("reads"), F.min("at").alias("first_at"))
    files = with_row_number(files, ["barcode"], ["ccf_file"], "file_at").withColumn("file_at", F.col("file_at") - 1)
    files = cut_lineage(files)
    per_class = files.groupBy("barcode").agg(F.count(F.lit(1)).alias("files"))
    message = F.concat(F.lit("class needs at least two files: "), F.col("barcode"))
    enough = F.when(F.col("files") < 2, F.raise_error(message).cast("long")).otherwise(F.col("files"))
    classes = cut_lineage(with_row_number(per_class.withColumn("files", enough), [], ["barcode"], "class_at"))
    n_classes = classes.count()
    if n_pairs is None:
        n_pairs = max(1, files.agg(F.sum("reads")).first()[0] // 2)
    first = hash_below(F.col("files"), seed, "left", F.col("pair"))
    step = 1 + hash_below(F.col("files") - 1, seed, "step", F.col("pair"))
    draws = (
        rows.sparkSession.range(n_pairs)
        .withColumnRenamed("id", "pair")
        .withColumn("class_at", F.col("pair") % n_classes + 1)
        .join(classes, "class_at")
        .withColumn("first", first)
        .withColumn("second", (F.col("first") + step) % F.col("files"))
    )
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("first").alias("file_at")),
        F.struct(F.lit("right").alias("side"), F.col("second").alias("file_at")),
    )
    picked = (
        draws.select("pair", "barcode", F.inline(sides))
        .join(files, ["barcode", "file_at"])
        .select("pair", "side", "barcode", (F.col("first_at") + hash_below(F.col("reads"), seed, F.col("side"), F.col("pair"))).alias("at"))
        .join(numbered, ["barcode", "at"])
    )
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    return picked.groupBy("pair").agg(
        F.first("barcode").alias("barcode"),
        *[of(side, column).alias(f"{side}_{name}") for side in ("left", "right") for column, name in (("ccf_file", "file"), ("read_id", "read"))],
    )
