"""Ranks and running sums that do not put a group into one task.

A window function sends every row of its partition to one task. That is fine for groups of a known small size and wrong
for a class, a file or a whole table. Here the rows are range-sorted by (keys, order), which spreads a hot key over many
tasks; each task knows the position of its rows; and one small row per (key, task) carries the totals of the tasks
before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

# Spark keeps only the first k rows of each group on the map side when k is at most this
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000
# Tasks that share the map tasks' rows of a hot group, near the square root of the map tasks of a large job.
SALTS = 64


def _sorted_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rows = df.orderBy(*[F.col(k) for k in keys], *order)
    return cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_block", F.shiftright("_at", 33)
    )


def _join_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    right = blocks.withColumnsRenamed({**names, "_block": "_block_r"})
    condition = rows["_block"] == right["_block_r"]
    for k, renamed in names.items():
        condition = condition & rows[k].eqNullSafe(right[renamed])
    return rows.join(right, condition).drop("_block_r", *names.values())


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based rank of every row inside its group; ``order`` must be total within a group."""
    rows = _sorted_blocks(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys, "_block")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        _join_blocks(rows, blocks, keys)
        .withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_at", "_block", "_first", "_before")
    )


def with_running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str | Column]
) -> DataFrame:
    """Running totals (own row included) of several columns; ``order`` must be total within a group."""
    rows = _sorted_blocks(
        df.withColumns({f"_v_{out}": F.col(v) if isinstance(v, str) else v for out, v in sums.items()}), keys, order
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in sums])
    blocks = totals.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in sums],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_in_{out}": F.sum(f"_v_{out}").over(inside) for out in sums})
    out = _join_blocks(local, blocks, keys).withColumns(
        {out: F.col(f"_in_{out}") + F.col(f"_before_{out}") for out in sums}
    )
    return out.drop("_at", "_block", *[f"_{p}_{o}" for o in sums for p in ("v", "in", "before")])


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str, *, hot: bool = False
) -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1 in ``name``.

    For small ``k`` each map task drops all but its own first ``k`` rows per group before the shuffle, so the shuffle is
    bounded by tasks x groups x k whatever the group sizes are. Larger ``k`` uses the distributed rank.

    ``hot`` is for few large groups, such as classes, whose rows come from every map task: the survivors of the map tasks first meet
    in ``SALTS`` tasks per group, which keep ``k`` rows each, so that no task gets more than tasks / SALTS x k or SALTS x k
    rows of a group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if k > MAP_SIDE_LIMIT:
        ranked = with_row_number(df, keys, order, name)
    elif hot:
        salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        some = salted.withColumn("_in_salt", F.row_number().over(part)).where(F.col("_in_salt") <= k).drop("_salt", "_in_salt")
        ranked = some.withColumn(name, F.row_number().over(window).cast("long"))
    else:
        ranked = df.withColumn(name, F.row_number().over(window).cast("long"))
    return ranked.where(F.col(name) <= k)
