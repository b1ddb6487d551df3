"""Training of light heads with Spark ML, and the table-level parts of the training objectives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import l2_normalize
from sigspark.functions.hashing import digest, uniform
from sigspark.operators.metrics import class_summary
from sigspark.operators.prefix import with_row_number
from sigspark.session import cut_lineage


@dataclass(frozen=True)
class FittedHead:
    name: str
    model: Model
    candidates: DataFrame


def _features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector))).withColumn("label", F.col("label").cast("double"))


def predict(model: Model, rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Predictions in the columns of the prediction table, with logits kept for a student."""
    scored = model.transform(_features(rows, vector))
    return scored.select(
        *[c for c in rows.columns if c not in (vector, "label")],
        F.col("label").cast("int").alias("true_label"),
        F.col("prediction").cast("int").alias("predicted_label"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
        vector_to_array("probability").alias("probabilities"),
        vector_to_array("rawPrediction").alias("logits"),
    )


def fit_head(
    train: DataFrame, val: DataFrame, estimators: Mapping[str, Estimator], classes: Sequence[str], vector: str = "vector"
) -> FittedHead:
    """Fit every candidate on train and keep the one with the best validation macro-F1 (first name on ties).

    All candidates score the validation rows in one pass, counted per candidate.
    """
    data = cut_lineage(_features(train, vector).select("features", "label"))
    fitted = {name: estimator.fit(data) for name, estimator in estimators.items()}
    scored, entries = _features(val, vector).select("features", "label"), []
    for i, (name, model) in enumerate(fitted.items()):
        # a copy that writes columns of its own
        own = model.copy({model.predictionCol: f"_predicted{i}", model.probabilityCol: f"_probability{i}", model.rawPredictionCol: f"_raw{i}"})
        scored = own.transform(scored)
        confidence = F.array_max(vector_to_array(f"_probability{i}"))
        entries.append(F.struct(F.lit(name).alias("candidate"), F.col(f"_predicted{i}").cast("int").alias("predicted_label"), confidence.alias("confidence")))
    rows = scored.select(F.col("label").cast("int").alias("true_label"), F.explode(F.array(*entries)).alias("c")).select("true_label", "c.*")
    scores = cut_lineage(class_summary(rows, classes, ["candidate"]).select("candidate", "accuracy", "macro_f1"))
    best = scores.orderBy(F.desc("macro_f1"), "candidate").first()
    return FittedHead(best.candidate, fitted[best.candidate], scores)


def class_balance(model: Model, rows: DataFrame, classes: Sequence[str], vector: str = "vector") -> DataFrame:
    """(label, reads, mean_probability, gradient): the loss's derivative by each class's intercept, in one pass.

    It is the mean probability of the class less its share of the rows, and 0 where an unpenalised fit has ended.
    """
    scored = predict(model, rows.select(vector, "label"), vector)
    per_class = [
        F.struct(
            F.lit(i).alias("label"),
            F.sum((F.col("true_label") == i).cast("long")).alias("reads"),
            F.avg(F.col("probabilities")[i]).alias("mean_probability"),
        )
        for i in range(len(classes))
    ]
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.array(*per_class).alias("c")).select("n", F.inline("c"))
    return sums.select("label", "reads", "mean_probability", (F.col("mean_probability") - F.col("reads") / F.col("n")).alias("gradient"))


def group_reweight(losses: DataFrame, weights: DataFrame, step: float) -> DataFrame:
    """One step of group weights: groups with a larger mean loss gain weight.

    ``losses`` has (group_id, loss) rows, ``weights`` one (group_id, weight) row per group. The growth factor is capped
    at 10 000; all weights are renormalised, and ``active_weight`` renormalises once more over the groups with rows.
    """
    means = losses.groupBy("group_id").agg(F.avg("loss").alias("group_loss"))
    # least() skips NULL, so groups without rows need their own branch
    growth = F.when(F.col("group_loss").isNull(), 1.0).otherwise(
        F.least(F.exp(F.lit(step) * F.col("group_loss")), F.lit(1e4))
    )
    updated = weights.join(means, "group_id", "left").withColumn("weight", F.col("weight") * growth)
    active = F.when(F.col("group_loss").isNotNull(), F.col("weight"))
    # one partial sum per task; no window over all groups
    totals = updated.agg(F.sum("weight").alias("total"), F.sum(active).alias("active_total")).first()
    total = max(totals.total, 1e-12)
    active_total = max(totals.active_total / total, 1e-12)
    return updated.select(
        "group_id",
        "group_loss",
        (F.col("weight") / total).alias("weight"),
        F.when(F.col("group_loss").isNotNull(), F.col("weight") / total / active_total).alias("active_weight"),
    )


def weighted_loss(reweighted: DataFrame) -> DataFrame:
    return reweighted.agg(F.sum(F.col("active_weight") * F.col("group_loss")).alias("loss"))


def mixing_table(alpha: float, size: int = 1024) -> list[float]:
    """Upper halves of Beta(alpha, alpha): the larger share at the middle of each of ``size`` equally likely steps.

    Below one half, x = t ** (1 / alpha) turns the density into a smooth function of t, which is summed and inverted.
    """
    t = np.linspace(0.0, 0.5**alpha, (1 << 16) + 1)
    density = (1 - t ** (1 / alpha)) ** (alpha - 1)
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    lower = np.interp((np.arange(size) + 0.5) / size, mass / mass[-1], t) ** (1 / alpha)
    return (1 - lower).tolist()


def mixup_rows(
    rows: DataFrame, *, seed: int, epoch: int, alpha: float, batch_size: int, n_classes: int, vector: str = "vector"
) -> DataFrame:
    """Mix every row with a partner of its seeded batch: unit-length lam * a + (1 - lam) * b, and soft targets.

    Rows are put in hash order and cut into batches; the partner is the next row of the batch, cyclically, so a window
    never holds more than ``batch_size`` rows. lam follows Beta(alpha, alpha), folded to one half and more; it is looked up in
    :func:`mixing_table` by a hash of the row.
    """
    hashed = rows.withColumn("_at", digest(seed, F.lit(epoch), F.col("read_id")))
    numbered = with_row_number(hashed, [], ["_at", "read_id"], "_n").withColumn(
        "batch", F.expr(f"(_n - 1) div {batch_size}")
    )
    by_batch = Window.partitionBy("batch")
    following = by_batch.orderBy("_n")
    own = F.struct("read_id", "label", F.col(vector).alias("vector"))
    first = F.first(own).over(following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    paired = numbered.withColumn("_p", F.coalesce(F.lead(own).over(following), first))

    table = mixing_table(alpha)
    step = F.floor(uniform(seed, "lam", F.lit(epoch), F.col("read_id")) * len(table)).cast("int")
    mixed = paired.withColumn("lam", F.element_at(F.lit(table), step + 1))
    blend = F.zip_with(
        vector, "_p.vector", lambda a, b: F.col("lam") * a.cast("double") + (1 - F.col("lam")) * b.cast("double")
    )

    def target(i: Column) -> Column:
        one = lambda c: F.when(F.col(c) == i, 1.0).otherwise(0.0)
        return F.col("lam") * one("label") + (1 - F.col("lam")) * one("_p.label")

    return mixed.select(
        "batch",
        "read_id",
        F.col("_p.read_id").alias("partner_id"),
        "lam",
        l2_normalize(blend).alias("vector"),
        F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), target).alias("target"),
    )
