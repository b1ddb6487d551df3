from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.session import cut_lineage
from sigspark.operators.prefix import MAP_SIDE_LIMIT, first_k, with_row_number, with_running_sums


def skewed(n, seed=0):
    """(key, order, value) with a third of all rows in one key, and NULL as a key."""
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 1 / 3 else rng.choice(["a", "b", "c", None]) for _ in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    return [(k, o, rng.randint(-5, 9)) for k, o in zip(keys, order)]


def ranks(rows):
    groups = defaultdict(list)
    for k, o, v in rows:
        groups[k].append((o, v))
    out = {}
    for k, members in groups.items():
        total = 0
        for i, (o, v) in enumerate(sorted(members), 1):
            total += v
            out[(k, o)] = (i, total)
    return out


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_row_number_and_running_sum_do_not_depend_on_partitions(spark, parts):
    rows = skewed(4000)
    expected = ranks(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(parts)
    numbered = with_row_number(df, ["k"], ["o"], "n")
    assert {(r.k, r.o): r.n for r in numbered.collect()} == {key: v[0] for key, v in expected.items()}
    sums = with_running_sums(df, ["k"], ["o"], {"total": "v", "n": F.lit(1).cast("long")})
    assert {(r.k, r.o): (r.n, r.total) for r in sums.collect()} == expected


def test_a_hot_key_is_spread_over_tasks(spark):
    from sigspark.operators.prefix import _sorted_blocks

    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in _sorted_blocks(df, ["k"], ["o"]).groupBy("_block").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 200_000 / 8


def test_running_sum_over_the_whole_table(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), F.lit(2).alias("v"))
    last = with_running_sums(df, [], [F.desc("o")], {"total": "v"}).orderBy("o").first()
    assert last.o == 0 and last.total == 2000


@pytest.mark.parametrize("k", [3, MAP_SIDE_LIMIT + 200])
def test_first_k_small_and_large(spark, k):
    rows = skewed(6000, seed=1)
    expected = {key: n for key, (n, _) in ranks(rows).items() if n <= k}
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = {(r.k, r.o): r.n for r in first_k(df, ["k"], ["o"], k, "n").collect()}
    assert got == expected


def test_a_hot_group_is_limited_by_several_tasks(spark, monkeypatch):
    """90 % of the rows are in one class; no reduce task reads more than a share of what the map tasks keep."""
    from sigspark.operators import prefix

    monkeypatch.setattr(prefix, "SALTS", 8)
    rows = spark.range(64_000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("k"), F.xxhash64("id").alias("o"))
    rows = cut_lineage(rows.repartition(64, "o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    k, most = 200, {}
    try:
        for hot in (False, True):
            before = last_stage(spark)
            most[hot] = sorted((r.k, r.o, r.n) for r in first_k(rows, ["k"], ["o"], k, "n", hot=hot).collect()), largest_read(spark, before)
    finally:
        for c in ("adaptive.coalescePartitions.enabled", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{c}")
    assert most[False][0] == most[True][0] and len(most[True][0]) == 2 * k
    # 64 files with rows of both classes, each cut to k; with salts, some 8 files to a salt and then 8 salts
    assert most[False][1] >= 64 * k and most[True][1] <= 64 * k / 2


def _stages(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, new = context._gateway.jvm, context._gateway.new_array
    return context._jsc.sc().statusStore(), context._jsc.sc().statusStore().stageList(
        jvm.java.util.ArrayList(), False, False, new(jvm.double, 0), jvm.java.util.ArrayList()
    )


def last_stage(spark):
    _, stages = _stages(spark)
    return max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)


def largest_read(spark, after):
    """Most shuffle records that one task of a later stage read."""
    store, stages = _stages(spark)
    most = 0
    for i in range(stages.size()):
        stage = stages.apply(i)
        if stage.stageId() > after and stage.status().toString() == "COMPLETE":
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            for j in range(tasks.size()):
                metrics = tasks.apply(j).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_small_limits_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = first_k(df, ["k"], ["o"], 5, "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
