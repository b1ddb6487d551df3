"""Where the errors are: coarse groups, confusions, files and class pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.metrics import class_name, confusion_counts, is_correct, merge_rows, ratio, summarize
from sigspark.session import cut_lineage


def coarse_label(label: Column, merged: Sequence[tuple[str, str]], classes: Sequence[str]) -> Column:
    """Label in which both members of a merged pair carry the lower of their two labels."""
    out = label
    for a, b in merged:
        i, j = classes.index(a), classes.index(b)
        out = F.when(label.isin(i, j), F.lit(min(i, j))).otherwise(out)
    return out.cast("int")


def coarse_metrics(pred: DataFrame, merged: Sequence[tuple[str, str]], classes: Sequence[str]) -> DataFrame:
    """Accuracy and macro-F1 before and after merging confusable classes, averaged over the observed labels."""
    fine = confusion_counts(pred)
    both = {c: coarse_label(F.col(c), merged, classes) for c in ("true_label", "predicted_label")}
    coarse = (
        fine.withColumns(both)
        .groupBy("true_label", "predicted_label")
        .agg(F.sum("n").alias("n"), F.sum("confidence_sum").alias("confidence_sum"))
    )
    parts = [
        summarize(counts, None).select(
            "n", F.col("accuracy").alias(f"accuracy_{name}"), F.col("macro_f1").alias(f"macro_f1_{name}")
        )
        for name, counts in (("fine", fine), ("coarse", coarse))
    ]
    return merge_rows([parts[0], parts[1].drop("n")])


def _pairs(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return confusion_counts(pred, keys).where(~is_correct()).select(*keys, "true_label", "predicted_label", "n")


def top_confusions(pred: DataFrame, k: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent wrong (true, predicted) pairs and their share of all errors of the key."""
    by_key = Window.partitionBy(*keys)
    order = by_key.orderBy(F.desc("n"), "true_label", "predicted_label")
    ranked = _pairs(pred, keys).select(
        "*", F.row_number().over(order).alias("rank"), F.sum("n").over(by_key).alias("errors")
    )
    return ranked.where(F.col("rank") <= k).select(
        *keys, "rank", "true_label", "predicted_label", "n", (F.col("n") / F.col("errors")).alias("fraction_of_errors")
    )


def file_diagnostics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-file size, accuracy and confidence, next to the range over the files of the key (a method or a run)."""
    files = pred.groupBy(*keys, "ccf_file").agg(
        F.min("true_label").alias("label"),
        F.count(F.lit(1)).alias("n"),
        F.avg(is_correct().cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
    )
    # one row per file, used twice
    files = cut_lineage(files)
    ranges = files.groupBy(*keys).agg(
        F.min("accuracy").alias("min_file_accuracy"),
        F.max("accuracy").alias("max_file_accuracy"),
        F.avg("accuracy").alias("mean_file_accuracy"),
    )
    return files.join(ranges, list(keys))


def pair_errors(pred: DataFrame, left: int, right: int, keys: Sequence[str] = ()) -> DataFrame:
    """Errors inside one named class pair and their share of all errors."""
    inside = F.col("true_label").isin(left, right) & F.col("predicted_label").isin(left, right)
    counts = _pairs(pred, keys).groupBy(*keys).agg(
        F.sum("n").alias("errors"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("pair_errors")
    )
    return counts.withColumn("pair_share", ratio(F.col("pair_errors"), F.col("errors")))


def confusable_pairs(pred: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Symmetric errors of every pair of declared classes, also of pairs that were never confused.

    One pass over the count table: each true class tells its errors to the pairs it erred with and its support to all its
    pairs, which gives about two rows per pair and key.
    """
    n = len(classes)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    declared = [F.col(c).between(0, n - 1) for c in ("true_label", "predicted_label")]
    by_class = confusion_counts(pred, keys).where(declared[0] & declared[1]).groupBy(*keys, "true_label").agg(
        F.collect_list(F.struct("predicted_label", "n")).alias("cells"), F.sum("n").alias("support")
    )
    found = by_class.groupBy(*keys).agg(F.collect_list(F.struct("true_label", "support", "cells")).alias("found"))
    absent = F.array_except(every, F.transform("found", lambda r: r["true_label"]))
    nobody = F.array().cast("array<struct<predicted_label:int,n:bigint>>")
    zeros = F.transform(
        absent, lambda i: F.struct(i.alias("true_label"), F.lit(0).cast("long").alias("support"), nobody.alias("cells"))
    )
    rows = found.select(*keys, F.explode(F.concat("found", zeros)).alias("r")).select(*keys, "r.*")

    def tell(other: Column, errors: Column, support: Column) -> Column:
        own = F.col("true_label")
        return F.struct(
            F.least(own, other).alias("left"),
            F.greatest(own, other).alias("right"),
            errors.alias("errors"),
            support.alias("support"),
        )

    nothing = F.lit(0).cast("long")
    told = F.concat(
        F.transform("cells", lambda c: tell(c["predicted_label"], c["n"], nothing)),
        F.transform(every, lambda i: tell(i, nothing, F.col("support"))),
    )
    counts = (
        rows.select(*keys, F.explode(told).alias("p"))
        .select(*keys, "p.*")
        .where(F.col("left") < F.col("right"))
        .groupBy(*keys, "left", "right")
        .agg(F.sum("errors").alias("symmetric_errors"), F.sum("support").alias("support"))
    )
    return counts.select(
        *keys,
        class_name(F.col("left"), classes).alias("left_class"),
        class_name(F.col("right"), classes).alias("right_class"),
        "symmetric_errors",
        ratio(F.col("symmetric_errors"), F.col("support")).alias("symmetric_error_rate"),
    )


def hard_pairs(pred: DataFrame, classes: Sequence[str], k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most confusable pairs as one string ``a:b,c:d``."""
    order = F.struct(
        (-F.col("symmetric_error_rate")).alias("rate"),
        (-F.col("symmetric_errors")).alias("errors"),
        "left_class",
        "right_class",
    )
    best = confusable_pairs(pred, classes, keys).groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best")
    )
    names = F.transform("best", lambda p: F.concat_ws(":", p.left_class, p.right_class))
    return best.select(*keys, F.array_join(names, ",").alias("hard_pairs"))
