"""Classification metrics, calibration and selective reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import calibration as cal
from sigspark.operators import diagnostics as diag
from sigspark.operators import metrics as met
from sigspark.plans.bridge import CLASSES, predictions
from sigspark.plans.registry import query, sql
from sigspark.sources import predictions as src

LABELS = "(SELECT CAST(i AS INTEGER) AS label FROM range(9) t(i))"


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


@query("predictions_read", sql(["predictions"], "SELECT read_id, true_label, predicted_label, confidence FROM predictions"))
def _(spark, d):
    return src.normalize_predictions(predictions(spark, d).withColumnRenamed("predicted_label", "pred_label")).select(
        "read_id", "true_label", "predicted_label", "confidence"
    )


@query("predictions_named", sql(["predictions"], """
SELECT read_id, CASE WHEN true_label < 8 THEN 'c' ELSE 'class_' END || CAST(true_label AS VARCHAR) AS true_species,
       CASE WHEN predicted_label < 8 THEN 'c' || CAST(predicted_label AS VARCHAR)
            ELSE 'class_' || CAST(predicted_label AS VARCHAR) END AS predicted_species,
       CAST(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS INTEGER) AS correct
FROM predictions"""))
def _(spark, d):
    # class 8 is left undeclared to show the fallback name
    return src.name_predictions(predictions(spark, d), CLASSES[:8]).select("read_id", "true_species", "predicted_species", "correct")


@query("class_metrics", sql(["predictions"], f"""
SELECT l.label, 'c' || CAST(l.label AS VARCHAR) AS class_name, round(tp / greatest(p, 1), 6) AS "precision",
       round(tp / greatest(s, 1), 6) AS recall,
       round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END, 6) AS f1,
       CAST(s AS BIGINT) AS support
FROM {LABELS} l, LATERAL (
  SELECT count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp,
         count(*) FILTER (predicted_label = l.label) AS p, count(*) FILTER (true_label = l.label) AS s
  FROM predictions)"""))
def _(spark, d):
    return met.class_metrics(predictions(spark, d), CLASSES).withColumns(r6("precision", "recall", "f1"))


_PER_CLASS = f"""
per_class AS (
  SELECT l.label, count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp,
         count(*) FILTER (predicted_label = l.label) AS p, count(*) FILTER (true_label = l.label) AS s
  FROM {LABELS} l, predictions GROUP BY l.label),
scored AS (
  SELECT *, tp / greatest(s, 1) AS recall, tp / greatest(p, 1) AS prec,
         CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END AS f1 FROM per_class)"""


@query("class_summary", sql(["predictions"], f""", {_PER_CLASS}
SELECT (SELECT count(*) FROM predictions) AS n,
       round((SELECT avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) FROM predictions), 6) AS accuracy,
       round(avg(recall), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1,
       round((SELECT avg(confidence) FROM predictions), 6) AS mean_confidence
FROM scored"""))
def _(spark, d):
    return met.class_summary(predictions(spark, d), CLASSES).withColumns(
        r6("accuracy", "balanced_accuracy", "macro_f1", "mean_confidence")
    )


@query("confusion_matrix", sql(["predictions"], f"""
SELECT a.label AS true_label, b.label AS predicted_label, count(p.read_id) AS n
FROM {LABELS} a CROSS JOIN {LABELS} b
LEFT JOIN predictions p ON p.true_label = a.label AND p.predicted_label = b.label GROUP BY 1, 2"""))
def _(spark, d):
    return met.confusion_matrix(predictions(spark, d), CLASSES)


@query("confusion_wide", sql(["predictions"], "SELECT true_label, " + ", ".join(
    f"count(*) FILTER (predicted_label = {i}) AS pred_{i}" for i in range(9)) + " FROM predictions GROUP BY true_label"))
def _(spark, d):
    return met.confusion_wide(predictions(spark, d), CLASSES)


@query("group_accuracy", sql(["predictions"], """
SELECT ccf_file, min(true_label) AS label, count(*) AS n_reads,
       round(avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM predictions GROUP BY ccf_file"""))
def _(spark, d):
    pred = predictions(spark, d)
    groups = pred.select("read_id", "ccf_file")
    joined = src.attach_groups(pred.drop("ccf_file"), groups)
    return met.group_accuracy(joined).withColumns(r6("accuracy"))


_GROUPS = """g AS (SELECT ccf_file, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS a
FROM predictions WHERE split = 'val' GROUP BY ccf_file)"""


@query("group_summary", sql(["predictions"], f""", {_GROUPS}
SELECT count(*) AS n_groups, round(min(a), 6) AS worst_group_accuracy, round(quantile_cont(a, 0.1), 6) AS p10_group_accuracy,
       round(median(a), 6) AS median_group_accuracy, round(avg(a), 6) AS mean_group_accuracy,
       round(max(a), 6) AS best_group_accuracy FROM g"""))
def _(spark, d):
    names = [f"{n}_group_accuracy" for n in ("worst", "p10", "median", "mean", "best")]
    return met.group_summary(met.group_accuracy(predictions(spark, d, "val"))).withColumns(r6(*names))


@query("auroc", sql(["predictions"], """
, c AS (SELECT confidence, count(*) FILTER (true_label = predicted_label) AS p,
               count(*) FILTER (true_label <> predicted_label) AS n FROM predictions GROUP BY confidence)
SELECT round(sum(CASE WHEN a.confidence > b.confidence THEN 1.0 WHEN a.confidence = b.confidence THEN 0.5 ELSE 0 END
                 * a.p * b.n) / (sum(a.p * b.n)), 6) AS auroc
FROM c a CROSS JOIN c b"""))
def _(spark, d):
    return met.auroc(predictions(spark, d)).withColumns(r6("auroc"))


@query("aurc", sql(["predictions"], """
, r AS (SELECT row_number() OVER o AS i, sum(CASE WHEN true_label = predicted_label THEN 0 ELSE 1 END) OVER o AS e
        FROM predictions WINDOW o AS (ORDER BY confidence DESC, event_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT i, e / i AS risk, coalesce(lag(e / i) OVER (ORDER BY i), 0) AS previous FROM r)
SELECT round(sum((risk + previous) / 2) / count(*), 6) AS aurc FROM q"""))
def _(spark, d):
    return met.aurc(predictions(spark, d), "event_id").withColumns(r6("aurc"))


@query("confidence_hist", sql(["predictions"], """
, e AS (SELECT i, i * (1 / CAST(30 AS DOUBLE)) AS low FROM range(0, 30) t(i)),
b AS (SELECT true_label = predicted_label AS correct, (SELECT max(i) FROM e WHERE low <= confidence) AS bin
      FROM predictions WHERE confidence BETWEEN 0 AND 1)
SELECT c.correct, CAST(e.i AS INTEGER) AS bin, count(b.bin) AS reads, round(count(b.bin) * 30 / any_value(c.n), 6) AS density
FROM (SELECT correct, count(*) AS n FROM b GROUP BY correct) c CROSS JOIN e
LEFT JOIN b ON b.correct = c.correct AND b.bin = e.i GROUP BY c.correct, e.i"""))
def _(spark, d):
    return met.confidence_hist(predictions(spark, d)).withColumns(r6("density"))


def _curve_sql(grid: int) -> str:
    return f""", v AS (SELECT * FROM predictions WHERE split = 'val'),
conf AS (SELECT confidence, row_number() OVER (ORDER BY confidence DESC) - 1 AS b FROM (SELECT DISTINCT confidence FROM v)),
cnt AS (SELECT count(*) AS m FROM conf),
kept AS (SELECT confidence FROM conf, cnt WHERE m <= {grid} OR b IN (
  SELECT CASE WHEN i = {grid - 1} THEN m - 1 ELSE CAST(floor(i * ((m - 1) / CAST({grid - 1} AS DOUBLE))) AS BIGINT) END
  FROM range({grid}) g(i), cnt)),
cells AS (
  SELECT k.confidence, l.label, count(*) FILTER (v.true_label = l.label) AS s,
         count(*) FILTER (v.predicted_label = l.label) AS p,
         count(*) FILTER (v.true_label = l.label AND v.predicted_label = l.label) AS tp
  FROM kept k JOIN v ON v.confidence >= k.confidence CROSS JOIN {LABELS} l GROUP BY 1, 2),
tot AS (SELECT true_label AS label, count(*) AS t FROM v GROUP BY 1),
points AS (
  SELECT CASE WHEN sum(s) = (SELECT count(*) FROM v) THEN 0 ELSE c.confidence END AS threshold,
         CAST(sum(s) AS BIGINT) AS accepted_reads, sum(s) / (SELECT count(*) FROM v) AS coverage,
         sum(tp) / sum(s) AS accepted_accuracy,
         avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END) AS accepted_macro_f1,
         1 - sum(tp) / sum(s) AS selective_risk, min(s / t) AS min_per_class_coverage,
         max(s / t) FILTER (label = 0) AS coverage_c0, max(s / t) FILTER (label = 8) AS coverage_c8
  FROM cells c JOIN tot USING (label) GROUP BY c.confidence),
curve AS (SELECT p.*, p.accepted_accuracy - full_.accepted_accuracy AS accuracy_gain, p.accepted_macro_f1 - full_.accepted_macro_f1 AS macro_f1_gain
  FROM points p, (SELECT * FROM points WHERE threshold = 0) full_)"""


_CURVE_COLUMNS = ("threshold", "coverage", "accepted_accuracy", "accepted_macro_f1", "selective_risk",
                  "min_per_class_coverage", "accuracy_gain", "macro_f1_gain")


def _curve(grid: int):
    def run(spark, d):
        curve = cal.risk_coverage(predictions(spark, d, "val"), CLASSES, grid)
        return curve.select(
            "accepted_reads",
            *[F.round(c, 6).alias(c) for c in _CURVE_COLUMNS],
            *[F.round(F.col("coverage_by_class")[c], 6).alias(f"coverage_{c}") for c in ("c0", "c8")],
        )

    return run


_CURVE_SELECT = "SELECT accepted_reads, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in (*_CURVE_COLUMNS, "coverage_c0", "coverage_c8")) + " FROM curve"
query("risk_coverage", sql(["predictions"], _curve_sql(1001) + _CURVE_SELECT))(_curve(1001))
query("risk_coverage_grid", sql(["predictions"], _curve_sql(64) + _CURVE_SELECT))(_curve(64))

_BASE = """, base AS (SELECT accepted_accuracy AS a, accepted_macro_f1 AS f FROM curve WHERE threshold = 0),
best AS (SELECT curve.* FROM curve, base WHERE coverage >= 0.5 AND min_per_class_coverage >= 0.5
  AND accepted_accuracy >= 0.9 AND accepted_accuracy - a >= 0.01
  ORDER BY coverage DESC, min_per_class_coverage DESC, accepted_macro_f1 DESC, threshold LIMIT 1)"""


@query("calibrate", sql(["predictions"], _curve_sql(1001) + _BASE + """
SELECT CASE WHEN (SELECT count(*) FROM best) > 0 THEN 'target_met' ELSE 'no_feasible_selective_operating_point' END AS selection_status,
       (SELECT count(*) FROM best) > 0 AS threshold_enabled, round(threshold, 6) AS threshold, accepted_reads,
       round(coverage, 6) AS coverage, round(accepted_accuracy, 6) AS accepted_accuracy,
       round(accepted_macro_f1, 6) AS accepted_macro_f1, round(accepted_accuracy - a, 6) AS accuracy_gain,
       round(accepted_macro_f1 - f, 6) AS macro_f1_gain FROM best, base"""))
def _(spark, d):
    chosen = cal.calibrate(predictions(spark, d, "val"), CLASSES)
    return chosen.select(
        "selection_status", "threshold_enabled", "accepted_reads",
        *[F.round(c, 6).alias(c) for c in ("threshold", "coverage", "accepted_accuracy", "accepted_macro_f1",
                                           "accuracy_gain", "macro_f1_gain")],
    )


@query("calibrate_infeasible", sql(["predictions"], """
SELECT 'no_feasible_selective_operating_point' AS selection_status, false AS threshold_enabled,
       CAST(0 AS DOUBLE) AS threshold, count(*) AS accepted_reads FROM predictions WHERE split = 'val'"""))
def _(spark, d):
    flat = predictions(spark, d, "val").withColumn("confidence", F.lit(0.8))
    return cal.calibrate(flat, CLASSES, target_accuracy=0.95).select(
        "selection_status", "threshold_enabled", "threshold", "accepted_reads"
    )


_TEST = _curve_sql(1001) + _BASE + """, t AS (
  SELECT p.*, confidence >= (SELECT threshold FROM best) AS accepted FROM predictions p WHERE split = 'test')"""


def _frozen(spark, d):
    return cal.threshold_spec(cal.calibrate(predictions(spark, d, "val"), CLASSES))


@query("abundance", sql(["predictions"], _TEST + f"""
SELECT l.label, 'c' || CAST(l.label AS VARCHAR) AS class_name, count(t.read_id) AS reads,
       round(count(t.read_id) / greatest(1, (SELECT count(*) FROM t WHERE accepted)), 6) AS fraction_of_accepted
FROM {LABELS} l LEFT JOIN t ON t.predicted_label = l.label AND t.accepted GROUP BY l.label"""))
def _(spark, d):
    return cal.abundance(predictions(spark, d, "test"), CLASSES, _frozen(spark, d)).withColumns(
        r6("fraction_of_accepted")
    )


_SIDES = f""", sides AS (
  SELECT l.label, a.accepted_only, count(*) FILTER (true_label = l.label) AS s,
         count(*) FILTER (predicted_label = l.label) AS p,
         count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp
  FROM {LABELS} l CROSS JOIN (SELECT unnest([true, false]) AS accepted_only) a CROSS JOIN t
  WHERE t.accepted OR NOT a.accepted_only GROUP BY 1, 2),
rated AS (SELECT *, tp / greatest(p, 1) AS prec, tp / greatest(s, 1) AS rec,
                 CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END AS f1 FROM sides)"""


@query("per_class_selective", sql(["predictions"], _TEST + _SIDES + """
SELECT f.label, 'c' || CAST(f.label AS VARCHAR) AS class_name,
       round(f.prec, 6) AS full_precision, round(f.rec, 6) AS full_recall, round(f.f1, 6) AS full_f1,
       round(a.prec, 6) AS accepted_precision, round(a.rec, 6) AS accepted_recall, round(a.f1, 6) AS accepted_f1,
       f.s AS total_reads, a.s AS accepted_reads, round(a.s / greatest(1, f.s), 6) AS acceptance_rate
FROM rated f JOIN rated a ON a.label = f.label AND a.accepted_only AND NOT f.accepted_only"""))
def _(spark, d):
    rows = cal.per_class_selective(predictions(spark, d, "test"), CLASSES, _frozen(spark, d))
    return rows.withColumns(r6(*[c for c in rows.columns if c.split("_")[-1] in ("precision", "recall", "f1", "rate")]))


@query("selective_report", sql(["predictions"], _TEST + _SIDES + """
SELECT (SELECT count(*) FROM t) AS total_reads, (SELECT count(*) FROM t WHERE accepted) AS accepted_reads,
       (SELECT count(*) FROM t WHERE NOT accepted) AS abstained_reads,
       round((SELECT avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) FROM t), 6) AS accepted_rate, true AS threshold_enabled,
       round((SELECT threshold FROM best), 6) AS threshold,
       round((SELECT avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) FROM t), 6) AS full_accuracy,
       round(avg(f1) FILTER (NOT accepted_only), 6) AS full_macro_f1,
       round((SELECT avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) FROM t WHERE accepted), 6)
         AS accepted_accuracy,
       round(avg(f1) FILTER (accepted_only), 6) AS accepted_macro_f1,
       round(avg(rec) FILTER (NOT accepted_only), 6) AS full_balanced_accuracy, round(avg(rec) FILTER (accepted_only), 6) AS accepted_balanced_accuracy,
       round((SELECT avg(confidence) FROM t), 6) AS full_mean_confidence, round((SELECT avg(confidence) FROM t WHERE accepted), 6) AS accepted_mean_confidence
FROM rated"""))
def _(spark, d):
    sides = [f"{side}_{m}" for side in ("full", "accepted") for m in ("accuracy", "macro_f1", "balanced_accuracy", "mean_confidence")]
    return cal.selective_report(predictions(spark, d, "test"), CLASSES, _frozen(spark, d)).withColumns(
        r6("accepted_rate", "threshold", *sides)
    )


_COARSE = """, named AS (
  SELECT predicted_label AS p9, true_label AS t9,
         CASE WHEN predicted_label IN (0, 1) THEN 'c0_c1_group' ELSE 'c' || CAST(predicted_label AS VARCHAR) END AS p8,
         CASE WHEN true_label IN (0, 1) THEN 'c0_c1_group' ELSE 'c' || CAST(true_label AS VARCHAR) END AS t8
  FROM predictions WHERE split = 'test')"""


def _macro_sql(t: str, p: str) -> str:
    return f"""(SELECT avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (s + q) END) FROM (
      SELECT l, count(*) FILTER ({t} = l AND {p} = l) AS tp, count(*) FILTER ({t} = l) AS s, count(*) FILTER ({p} = l) AS q
      FROM (SELECT DISTINCT {t} AS l FROM named UNION SELECT DISTINCT {p} FROM named), named GROUP BY l))"""


@query("coarse_metrics", sql(["predictions"], _COARSE + f"""
SELECT count(*) AS n, round(avg(CASE WHEN t9 = p9 THEN 1.0 ELSE 0.0 END), 6) AS accuracy_fine,
       round({_macro_sql('t9', 'p9')}, 6) AS macro_f1_fine,
       round(avg(CASE WHEN t8 = p8 THEN 1.0 ELSE 0.0 END), 6) AS accuracy_coarse,
       round({_macro_sql('t8', 'p8')}, 6) AS macro_f1_coarse
FROM named"""))
def _(spark, d):
    return diag.coarse_metrics(predictions(spark, d, "test"), [("c0", "c1")], CLASSES).withColumns(
        r6("accuracy_fine", "macro_f1_fine", "accuracy_coarse", "macro_f1_coarse")
    )


@query("top_confusions", sql(["run_predictions"], """
, pairs AS (SELECT run_id, true_label, predicted_label, count(*) AS n FROM run_predictions
            WHERE true_label <> predicted_label GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, true_label, predicted_label) AS rank,
                  sum(n) OVER (PARTITION BY run_id) AS errors FROM pairs)
SELECT run_id, CAST(rank AS INTEGER) AS rank, true_label, predicted_label, n,
       round(n / errors, 6) AS fraction_of_errors FROM ranked WHERE rank <= 5"""))
def _(spark, d):
    from sigspark.plans.bridge import run_predictions

    return diag.top_confusions(run_predictions(spark, d), 5, ["run_id"]).withColumns(r6("fraction_of_errors"))


@query("file_diagnostics", sql(["run_predictions"], """
, f AS (SELECT run_id, ccf_file, min(true_label) AS label, count(*) AS n,
               avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS accuracy,
               avg(confidence) AS mean_confidence FROM run_predictions GROUP BY ALL)
SELECT run_id, ccf_file, label, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence,
       round(min(accuracy) OVER (PARTITION BY run_id), 6) AS min_file_accuracy,
       round(max(accuracy) OVER (PARTITION BY run_id), 6) AS max_file_accuracy,
       round(avg(accuracy) OVER (PARTITION BY run_id), 6) AS mean_file_accuracy
FROM f"""))
def _(spark, d):
    from sigspark.plans.bridge import run_predictions

    return diag.file_diagnostics(run_predictions(spark, d), ["run_id"]).withColumns(
        r6("accuracy", "mean_confidence", "min_file_accuracy", "max_file_accuracy", "mean_file_accuracy")
    )


@query("pair_errors", sql(["run_predictions"], """
SELECT run_id, count(*) AS errors,
       count(*) FILTER (least(true_label, predicted_label) = 3 AND greatest(true_label, predicted_label) = 4) AS pair_errors,
       round(count(*) FILTER (least(true_label, predicted_label) = 3 AND greatest(true_label, predicted_label) = 4)
             / count(*), 6) AS pair_share
FROM run_predictions WHERE true_label <> predicted_label GROUP BY run_id"""))
def _(spark, d):
    from sigspark.plans.bridge import run_predictions

    return diag.pair_errors(run_predictions(spark, d), 3, 4, ["run_id"]).withColumns(r6("pair_share"))


_PAIRS = f""", v AS (SELECT * FROM predictions WHERE split = 'val'),
pairs AS (SELECT a.label AS l, b.label AS r,
  (SELECT count(*) FROM v WHERE (true_label = a.label AND predicted_label = b.label)
                             OR (true_label = b.label AND predicted_label = a.label)) AS e,
  (SELECT count(*) FROM v WHERE true_label IN (a.label, b.label)) AS s
  FROM {LABELS} a JOIN {LABELS} b ON a.label < b.label)"""


@query("confusable_pairs", sql(["predictions"], _PAIRS + """
SELECT 'c' || CAST(l AS VARCHAR) AS left_class, 'c' || CAST(r AS VARCHAR) AS right_class, e AS symmetric_errors,
       round(CASE WHEN s > 0 THEN e / s ELSE 0 END, 6) AS symmetric_error_rate FROM pairs"""))
def _(spark, d):
    return diag.confusable_pairs(predictions(spark, d, "val"), CLASSES).withColumns(r6("symmetric_error_rate"))


@query("hard_pairs", sql(["predictions"], _PAIRS + """
SELECT string_agg('c' || CAST(l AS VARCHAR) || ':c' || CAST(r AS VARCHAR), ',' ORDER BY e / s DESC, e DESC, l, r) AS hard_pairs
FROM (SELECT * FROM pairs ORDER BY e / s DESC, e DESC, l, r LIMIT 3)"""))
def _(spark, d):
    return diag.hard_pairs(predictions(spark, d, "val"), CLASSES, 3)
