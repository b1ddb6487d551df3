"""Comparison of runs: metrics per (run, split), gates, candidate selection and reproducibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.diagnostics import hard_pairs
from sigspark.operators.metrics import (
    class_summary,
    confusion_counts,
    group_accuracy,
    group_summary,
    merge_rows,
    per_label,
)

RUN = ["run_id", "split"]


def run_metrics(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Classification and file-robustness metrics of every (run, split), all runs in one pass each."""
    groups = group_summary(group_accuracy(pred, RUN), RUN)
    return merge_rows([class_summary(pred, classes, RUN), groups], RUN)


def wide_metrics(metrics: DataFrame) -> DataFrame:
    """One row per run with validation and test accuracy and macro-F1."""
    part = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c))).alias(f"{split}_{c}")
    names = [(s, c) for s in ("val", "test") for c in ("accuracy", "macro_f1")]
    return metrics.groupBy("run_id").agg(*[part(s, c) for s, c in names], part("val", "p10_group_accuracy"))


def compare_to_baseline(
    wide: DataFrame, baseline: int | str, *, min_score: float, min_gain: float, smoke: bool = False
) -> DataFrame:
    """Gain of every run over a baseline run on validation macro-F1, and whether both gates are passed.

    The best run (the first on ties) carries the decision; a smoke run decides nothing.
    """
    # one row per run
    base = F.max(F.when(F.col("run_id") == baseline, F.col("val_macro_f1"))).over(Window.partitionBy())
    rows = wide.withColumn("base", base).where(F.col("run_id") != baseline)
    gain = F.col("val_macro_f1") - F.col("base")
    scale = (F.col("val_macro_f1") >= min_score) & (gain >= min_gain)
    best = Window.orderBy(F.desc("val_macro_f1"), "run_id")
    decision = F.when(F.lit(smoke), "smoke_only").when(scale, "scale").otherwise("do_not_scale")
    return rows.select(
        "run_id",
        "val_accuracy",
        "val_macro_f1",
        "test_accuracy",
        "test_macro_f1",
        gain.alias("val_gain"),
        (F.row_number().over(best) == 1).alias("is_best"),
        decision.alias("decision"),
    )


def select_candidate(wide: DataFrame) -> DataFrame:
    """Rank of every run by validation macro-F1 only; ties go to the smaller run id. One row per run."""
    order = Window.orderBy(F.desc("val_macro_f1"), "run_id")
    return wide.select("run_id", "val_accuracy", "val_macro_f1", F.row_number().over(order).alias("rank"))


def candidate_hard_pairs(pred: DataFrame, wide: DataFrame, classes: Sequence[str], k: int = 3) -> DataFrame:
    """The selected run with its most confusable validation class pairs."""
    best = wide.orderBy(F.desc("val_macro_f1"), "run_id").select("run_id").first().run_id
    rows = pred.where((F.col("run_id") == best) & (F.col("split") == "val"))
    return hard_pairs(rows, classes, k, ["run_id"])


def robustness_gate(
    wide: DataFrame, baseline: int | str, candidate: int | str, *, min_f1_gain: float, min_p10_gain: float
) -> DataFrame:
    """Promote the candidate only if validation macro-F1 and the 10th percentile of file accuracy both gain enough."""
    pick = lambda run, c: F.max(F.when(F.col("run_id") == run, F.col(c)))
    both = wide.where(F.col("run_id").isin(baseline, candidate)).agg(
        pick(baseline, "val_macro_f1").alias("baseline_val_macro_f1"),
        pick(candidate, "val_macro_f1").alias("candidate_val_macro_f1"),
        pick(baseline, "val_p10_group_accuracy").alias("baseline_p10"),
        pick(candidate, "val_p10_group_accuracy").alias("candidate_p10"),
    )
    f1_gain = F.col("candidate_val_macro_f1") - F.col("baseline_val_macro_f1")
    p10_gain = F.col("candidate_p10") - F.col("baseline_p10")
    promote = (f1_gain >= min_f1_gain) & (p10_gain >= min_p10_gain)
    return both.withColumns(
        {
            "val_macro_f1_gain": f1_gain,
            "p10_gain": p10_gain,
            "promote_to_test": promote,
            "decision": F.when(promote, "promote_candidate").otherwise("freeze_baseline"),
        }
    )


def reproducibility(wide: DataFrame) -> DataFrame:
    """Spread of test macro-F1 over runs that have test rows (population standard deviation)."""
    value = F.col("test_macro_f1")
    return wide.agg(
        F.count(F.lit(1)).alias("n_completed"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_population"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def tagged_union(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Candidate tables of several stages as one, tagged with ``stage``; missing columns become NULL."""
    out = None
    for stage, rows in stages.items():
        part = rows.select(F.lit(stage).alias("stage"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def final_summary(wide: DataFrame, *, threshold: float) -> DataFrame:
    """The run with the best validation macro-F1, its test scores and whether they reach ``threshold``."""
    best = wide.orderBy(F.desc("val_macro_f1"), "run_id").limit(1)
    return best.select(
        "run_id",
        F.col("val_macro_f1").alias("selected_val_macro_f1"),
        "test_accuracy",
        "test_macro_f1",
        (F.col("test_macro_f1") >= threshold).alias("update_recommended"),
    )


def class_count_scaling(pred: DataFrame, ordered: Sequence[str], runs: Mapping[int, int]) -> DataFrame:
    """Validation and test metrics of the run trained for each class count, with the class list of that count.

    ``runs`` maps run id to class count; only rows whose true class belongs to the subset are in such a run.
    """
    count = F.lit(None).cast("int")
    for run, k in runs.items():
        count = F.when(F.col("run_id") == run, F.lit(k)).otherwise(count)
    rows = pred.withColumn("class_count", count).where("class_count IS NOT NULL AND true_label < class_count")
    keys = ["class_count", "split"]
    counts = confusion_counts(rows, ["class_count", "split"])
    # every subset has its own label domain, so labels at or beyond the class count must not enter the average
    labels = per_label(counts, len(ordered), ["class_count", "split"])
    inside = F.col("label") < F.col("class_count")
    scores = labels.groupBy("class_count", "split").agg(
        F.avg(F.when(inside, F.col("f1"))).alias("macro_f1"),
        (F.sum("true_positive") / F.sum("support")).alias("accuracy"),
    )
    part = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    names = F.array(*[F.lit(c) for c in ordered])
    return (
        scores.groupBy("class_count")
        .agg(*[part(s, c) for s in ("val", "test") for c in ("accuracy", "macro_f1")])
        .withColumn("classes", F.array_join(F.slice(names, F.lit(1), F.col("class_count")), ";"))
    )
