"""Classification metrics computed from one (true, predicted) count table.

The rows are shuffled once, after map-side counting; whatever follows works on at most classes^2 rows per key. ``keys``
(a run, a split, a method) extend every grouping, so all runs are measured in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.prefix import with_running_sums


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0/0 = 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def f1_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def class_table(spark: SparkSession, classes: Sequence[str]) -> DataFrame:
    """(label, class_name) of the declared classes; the position is the label."""
    return spark.range(len(classes)).select(
        F.col("id").cast("int").alias("label"), class_name(F.col("id"), classes).alias("class_name")
    )


def class_name(label: Column, classes: Sequence[str]) -> Column:
    """Name of a label, ``class_<i>`` for labels that are not declared."""
    names = F.array(*[F.lit(c) for c in classes])
    known = (label >= 0) & (label < len(classes))
    return F.when(known, F.get(names, label.cast("int"))).otherwise(F.concat(F.lit("class_"), label.cast("string")))


def is_correct() -> Column:
    return F.col("true_label") == F.col("predicted_label")


def declared_or_other(label: Column, n_classes: int) -> Column:
    """The label if it is declared, else -1, so that stray labels cannot make a small table large."""
    return F.when(label.between(0, n_classes - 1), label).otherwise(F.lit(-1))


def confusion_counts(pred: DataFrame, keys: Sequence[str] = (), accepted: Column | None = None) -> DataFrame:
    """One row per observed (true, predicted) pair with its count, accepted count and confidence sum."""
    taken = F.lit(True) if accepted is None else accepted
    return pred.groupBy(*keys, "true_label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(taken.cast("long")).alias("accepted"),
        F.sum("confidence").alias("confidence_sum"),
    )


def per_label(
    counts: DataFrame,
    n_classes: int | None,
    keys: Sequence[str] = (),
    weights: Sequence[str] = ("n",),
    carry: Mapping[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """Support, predicted and true-positive counts with precision, recall and F1 of every label.

    With ``n_classes`` every declared label appears, also with zero counts, and ``declared`` marks it; all other labels share
    the label -1. Without it the domain is what was observed as true or predicted label. Several ``weights`` (all rows, accepted rows) are counted
    side by side; columns of every further weight end in its name. ``carry`` aggregates more columns of ``counts`` by true
    label. Everything follows from one pass over ``counts``.
    """
    carry = dict(carry or {})
    suffixes = ["" if i == 0 else f"_{w}" for i, w in enumerate(weights)]
    zero = F.lit(0).cast("long")
    measures = [f"{m}{x}" for x in suffixes for m in ("support", "predicted", "true_positive")]

    def part(label: Column, values: Sequence[Column], carried: Sequence[Column]) -> Column:
        fields = [v.cast("long").alias(m) for m, v in zip(measures, values)]
        if n_classes is not None:
            label = declared_or_other(label, n_classes)
        return F.struct(label.cast("int").alias("label"), *fields, *[c.alias(n) for n, c in zip(carry, carried)])

    hit = is_correct().cast("long")
    as_true = [v for w in weights for v in (F.col(w), zero, hit * F.col(w))]
    as_predicted = [v for w in weights for v in (zero, F.col(w), zero)]
    types = dict(counts.dtypes)
    nothing = [F.lit(None).cast(types[c]) for c in carry]
    parts = F.array(
        part(F.col("true_label"), as_true, [F.col(c) for c in carry]),
        part(F.col("predicted_label"), as_predicted, nothing),
    )
    labels = (
        counts.select(*keys, F.explode(parts).alias("p"))
        .groupBy(*keys, F.col("p.label").alias("label"))
        .agg(*[F.sum(f"p.{m}").alias(m) for m in measures], *[f(f"p.{c}").alias(c) for c, f in carry.items()])
    )
    declared = F.lit(True)
    if n_classes is not None:
        # at most n_classes + 1 entries per key
        found = labels.groupBy(*keys).agg(F.collect_list(F.struct("label", *measures, *carry)).alias("found"))
        absent = F.array_except(
            F.sequence(F.lit(0), F.lit(n_classes - 1)), F.transform("found", lambda r: r["label"])
        )
        zeros = F.transform(absent, lambda i: part(i, [zero] * len(measures), nothing))
        labels = found.select(*keys, F.explode(F.concat("found", zeros)).alias("p")).select(*keys, "p.*")
        declared = F.col("label").between(0, n_classes - 1)
    rates = {}
    for x in suffixes:
        rates[f"precision{x}"] = ratio(F.col(f"true_positive{x}"), F.col(f"predicted{x}"))
        rates[f"recall{x}"] = ratio(F.col(f"true_positive{x}"), F.col(f"support{x}"))
        rates[f"f1{x}"] = f1_score(rates[f"precision{x}"], rates[f"recall{x}"])
    return labels.withColumns({"declared": declared, **rates})


def class_metrics(pred: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every declared class."""
    return (
        per_label(confusion_counts(pred, keys), len(classes), keys)
        .where("declared")
        .select(*keys, "label", class_name(F.col("label"), classes).alias("class_name"), "precision", "recall", "f1",
                "support")
    )


def class_summary(pred: DataFrame, classes: Sequence[str] | None, keys: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, balanced accuracy, macro-F1 and mean confidence per key.

    Averages run over the declared classes (an absent class counts as 0) or, with ``classes=None``, over the observed
    labels.
    """
    return summarize(confusion_counts(pred, keys), classes, keys)


def summarize(counts: DataFrame, classes: Sequence[str] | None, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`class_summary` from a count table."""
    labels = per_label(counts, None if classes is None else len(classes), keys, carry={"confidence_sum": F.sum})
    mean = lambda c: F.avg(F.when(F.col("declared"), F.col(c)))
    n = F.sum("support")
    return labels.groupBy(*keys).agg(
        n.alias("n"),
        F.try_divide(F.sum("true_positive"), n).alias("accuracy"),
        mean("recall").alias("balanced_accuracy"),
        mean("f1").alias("macro_f1"),
        F.try_divide(F.sum("confidence_sum"), n).alias("mean_confidence"),
    )


def merge_rows(parts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Put the columns of several tables with one row per key side by side, without a join."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def confusion_matrix(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Dense long confusion matrix of the declared classes."""
    n = len(classes)
    grid = pred.sparkSession.range(n * n).select(
        F.expr(f"CAST(id div {n} AS INT)").alias("true_label"), F.expr(f"CAST(id % {n} AS INT)").alias("predicted_label")
    )
    counts = confusion_counts(pred).select("true_label", "predicted_label", "n")
    return grid.join(counts, ["true_label", "predicted_label"], "left").select(
        "true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def confusion_wide(pred: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per true class, one ``pred_<i>`` column per predicted class."""
    labels = list(range(len(classes)))
    dense = confusion_matrix(pred, classes).groupBy("true_label").pivot("predicted_label", labels).agg(F.sum("n"))
    return dense.select("true_label", *[F.col(str(i)).alias(f"pred_{i}") for i in labels])


def composition(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Reads and fraction of every declared class from (label, reads) rows."""
    zeros = class_table(counts.sparkSession, classes).select("label", F.lit(0).cast("long").alias("reads"))
    label = declared_or_other(F.col("label"), len(classes)).alias("label")
    totals = counts.unionByName(zeros).groupBy(label).agg(F.sum("reads").alias("reads"))
    # one row per class from here on
    whole = totals.agg(F.collect_list(F.struct("label", "reads")).alias("rows"), F.sum("reads").alias("total"))
    rows = whole.select(F.explode("rows").alias("r"), "total").where(F.col("r.label").between(0, len(classes) - 1))
    return rows.select(
        "r.label",
        class_name(F.col("r.label"), classes).alias("class_name"),
        "r.reads",
        (F.col("r.reads") / F.greatest("total", F.lit(1))).alias("fraction_of_accepted"),
    )


def group_accuracy(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of every source file; a file with more than one true label is an error."""
    mixed = F.min("true_label") != F.max("true_label")
    message = F.concat(F.lit("file contains multiple labels: "), F.col("ccf_file"))
    return (
        pred.groupBy(*keys, "ccf_file")
        .agg(
            F.min("true_label").alias("label"),
            mixed.alias("mixed"),
            F.count(F.lit(1)).alias("n_reads"),
            F.avg(is_correct().cast("double")).alias("accuracy"),
        )
        .withColumn("label", F.when(F.col("mixed"), F.raise_error(message).cast("int")).otherwise(F.col("label")))
        .drop("mixed")
    )


def exact_quantiles(rows: DataFrame, value: str, quantiles: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles per key with linear interpolation, one column per name; NULL values do not count.

    Rows are counted per value before they are sorted, and the sort is by range, so neither a key nor the whole table is gathered
    in a task: a running count says which values stand at the two positions around a quantile.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_running_sums(counts, keys, [value], {"_upto": "_n"})
    totals = placed.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    if keys:
        placed = placed.join(totals, list(keys))
    else:
        placed = placed.withColumn("_total", F.lit(totals.first()["_total"]).cast("long"))
    columns = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        # the first value whose running count passes a position stands there
        low, high = (F.min(F.when(F.col("_upto") > at, F.col(value))) for at in (F.floor(position), F.ceil(position)))
        share = F.max(position - F.floor(position))
        columns.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*keys).agg(*columns)


def group_summary(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst, 10th percentile, median, mean and best file accuracy (linear interpolation)."""
    basic = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("accuracy").alias("worst_group_accuracy"),
        F.avg("accuracy").alias("mean_group_accuracy"),
        F.max("accuracy").alias("best_group_accuracy"),
    )
    names = {"p10_group_accuracy": 0.1, "median_group_accuracy": 0.5}
    order = ["n_groups", *[f"{n}_group_accuracy" for n in ("worst", "p10", "median", "mean", "best")]]
    return merge_rows([basic, exact_quantiles(groups, "accuracy", names, keys)], keys).select(*keys, *order)


def auroc(pred: DataFrame) -> DataFrame:
    """How well confidence ranks correct rows above wrong ones (ties share a rank); NULL with one outcome only."""
    per_confidence = pred.groupBy("confidence").agg(
        F.sum(is_correct().cast("long")).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    ranked = with_running_sums(per_confidence, [], ["confidence"], {"upto": "n"})
    positives = F.sum("hits").cast("double")
    negatives = (F.sum("n") - F.sum("hits")).cast("double")
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    rank_sum = F.sum(F.col("hits") * mean_rank)
    return ranked.agg(
        F.when(
            (positives > 0) & (negatives > 0),
            (rank_sum - positives * (positives + 1) / 2) / (positives * negatives),
        ).alias("auroc")
    )


def aurc(pred: DataFrame, order_col: str) -> DataFrame:
    """Area under the risk-coverage curve; ties in confidence keep the order of ``order_col``.

    All steps have width 1/n and the curve starts at (0, 0), so the trapezoids add up to
    (2 * sum of risks - last risk) / 2n.
    """
    ranked = with_running_sums(
        pred.select("confidence", order_col, (~is_correct()).cast("long").alias("error")),
        [],
        [F.desc("confidence"), order_col],
        {"errors": "error", "position": F.lit(1).cast("long")},
    )
    risk = F.col("errors") / F.col("position")
    n = F.max("position")
    return ranked.agg(((2 * F.sum(risk) - F.max_by(risk, F.col("position"))) / (2 * n)).alias("aurc"))


def confidence_hist(pred: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of confidence on [0, 1]; the last bin is closed, values outside are left out.

    Rows are split by correctness, or kept together (``correct`` is NULL) when the true label is unknown.
    """
    outcome = is_correct() if "true_label" in pred.columns else F.lit(None).cast("boolean")
    step = 1.0 / bins
    c = F.col("confidence")
    guess = F.floor(c * bins)
    exact = (
        F.when(guess * F.lit(step) > c, guess - 1)
        .when(((guess + 1) * F.lit(step) <= c) & (guess + 1 < bins), guess + 1)
        .otherwise(guess)
    )
    counts = (
        pred.where(c.between(0, 1))
        .groupBy(outcome.alias("correct"), F.least(exact, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("reads"))
    )
    # at most 2 x bins rows from here on
    rows = counts.groupBy("correct").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "reads"))).alias("by_bin"), F.sum("reads").alias("n")
    )
    return rows.select(
        "correct", "n", "by_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "correct",
        "bin",
        F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)).alias("reads"),
        (F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)) / (F.col("n") * F.lit(step))).alias("density"),
    )
