"""Comparison of runs and the gates between experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import runs
from sigspark.plans.bridge import CLASSES, run_predictions
from sigspark.plans.metric_queries import LABELS, r6
from sigspark.plans.registry import query, sql

_RUNS = f""", cell AS (
  SELECT run_id, split, l.label, count(*) FILTER (true_label = l.label) AS s, count(*) FILTER (predicted_label = l.label) AS p,
         count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp
  FROM run_predictions CROSS JOIN {LABELS} l GROUP BY 1, 2, 3),
f1 AS (SELECT run_id, split, avg(tp / greatest(s, 1)) AS balanced_accuracy,
              avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END) AS macro_f1 FROM cell GROUP BY 1, 2),
acc AS (SELECT run_id, split, count(*) AS n, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS accuracy,
               avg(confidence) AS mean_confidence FROM run_predictions GROUP BY 1, 2),
g AS (SELECT run_id, split, ccf_file, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS a
      FROM run_predictions GROUP BY 1, 2, 3),
gs AS (SELECT run_id, split, count(*) AS n_groups, min(a) AS worst, quantile_cont(a, 0.1) AS p10, median(a) AS median,
              avg(a) AS mean, max(a) AS best FROM g GROUP BY 1, 2),
m AS (SELECT * FROM acc JOIN f1 USING (run_id, split) JOIN gs USING (run_id, split)),
wide AS (SELECT v.run_id, v.accuracy AS val_accuracy, v.macro_f1 AS val_macro_f1, t.accuracy AS test_accuracy,
                t.macro_f1 AS test_macro_f1, v.p10 AS val_p10
         FROM m v JOIN m t ON v.run_id = t.run_id AND v.split = 'val' AND t.split = 'test')"""


def _metrics(spark, d):
    return runs.run_metrics(run_predictions(spark, d), CLASSES)


def _wide(spark, d):
    return runs.wide_metrics(_metrics(spark, d))


@query("run_metrics", sql(["run_predictions"], _RUNS + """
SELECT run_id, split, n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
       round(macro_f1, 6) AS macro_f1, round(mean_confidence, 6) AS mean_confidence, n_groups,
       round(worst, 6) AS worst_group_accuracy, round(p10, 6) AS p10_group_accuracy, round(median, 6) AS median_group_accuracy,
       round(mean, 6) AS mean_group_accuracy, round(best, 6) AS best_group_accuracy FROM m"""))
def _(spark, d):
    rows = _metrics(spark, d)
    return rows.withColumns(r6(*[c for c in rows.columns if c not in ("run_id", "split", "n", "n_groups")]))


_GATE = """
SELECT w.run_id, round(w.val_accuracy, 6) AS val_accuracy, round(w.val_macro_f1, 6) AS val_macro_f1,
       round(w.test_accuracy, 6) AS test_accuracy, round(w.test_macro_f1, 6) AS test_macro_f1,
       round(w.val_macro_f1 - b.val_macro_f1, 6) AS val_gain,
       row_number() OVER (ORDER BY w.val_macro_f1 DESC, w.run_id) = 1 AS is_best,
       CASE WHEN w.val_macro_f1 >= 0.82 AND w.val_macro_f1 - b.val_macro_f1 >= 0.02 THEN 'scale' ELSE 'do_not_scale' END AS decision
FROM wide w JOIN wide b ON b.run_id = 0 WHERE w.run_id <> 0"""


@query("gate_compare", sql(["run_predictions"], _RUNS + _GATE))
def _(spark, d):
    rows = runs.compare_to_baseline(_wide(spark, d), 0, min_score=0.82, min_gain=0.02)
    return rows.withColumns(r6("val_accuracy", "val_macro_f1", "test_accuracy", "test_macro_f1", "val_gain"))


@query("select_candidate", sql(["run_predictions"], _RUNS + """
SELECT run_id, round(val_accuracy, 6) AS val_accuracy, round(val_macro_f1, 6) AS val_macro_f1,
       CAST(row_number() OVER (ORDER BY val_macro_f1 DESC, run_id) AS INTEGER) AS rank FROM wide"""))
def _(spark, d):
    return runs.select_candidate(_wide(spark, d)).withColumns(r6("val_accuracy", "val_macro_f1"))


@query("candidate_hard_pairs", sql(["run_predictions"], _RUNS + f"""
, best AS (SELECT run_id FROM wide ORDER BY val_macro_f1 DESC, run_id LIMIT 1),
v AS (SELECT * FROM run_predictions WHERE split = 'val' AND run_id = (SELECT run_id FROM best)),
pairs AS (SELECT a.label AS l, b.label AS r,
  (SELECT count(*) FROM v WHERE (true_label = a.label AND predicted_label = b.label)
                             OR (true_label = b.label AND predicted_label = a.label)) AS e,
  (SELECT count(*) FROM v WHERE true_label IN (a.label, b.label)) AS s
  FROM {LABELS} a JOIN {LABELS} b ON a.label < b.label)
SELECT (SELECT run_id FROM best) AS run_id,
       string_agg('c' || CAST(l AS VARCHAR) || ':c' || CAST(r AS VARCHAR), ',' ORDER BY e / s DESC, e DESC, l, r) AS hard_pairs
FROM (SELECT * FROM pairs ORDER BY e / s DESC, e DESC, l, r LIMIT 3)"""))
def _(spark, d):
    return runs.candidate_hard_pairs(run_predictions(spark, d), _wide(spark, d), CLASSES)


@query("gate_robust", sql(["run_predictions"], _RUNS + """
SELECT round(b.val_macro_f1, 6) AS baseline_val_macro_f1, round(c.val_macro_f1, 6) AS candidate_val_macro_f1,
       round(b.val_p10, 6) AS baseline_p10, round(c.val_p10, 6) AS candidate_p10,
       round(c.val_macro_f1 - b.val_macro_f1, 6) AS val_macro_f1_gain, round(c.val_p10 - b.val_p10, 6) AS p10_gain,
       c.val_macro_f1 - b.val_macro_f1 >= 0.005 AND c.val_p10 - b.val_p10 >= 0.02 AS promote_to_test,
       CASE WHEN c.val_macro_f1 - b.val_macro_f1 >= 0.005 AND c.val_p10 - b.val_p10 >= 0.02 THEN 'promote_candidate'
            ELSE 'freeze_baseline' END AS decision
FROM wide b, wide c WHERE b.run_id = 0 AND c.run_id = 3"""))
def _(spark, d):
    row = runs.robustness_gate(_wide(spark, d), 0, 3, min_f1_gain=0.005, min_p10_gain=0.02)
    return row.withColumns(r6(*[c for c in row.columns if c not in ("promote_to_test", "decision")]))


@query("reproducibility", sql(["run_predictions"], _RUNS + """
SELECT count(*) AS n_completed, round(avg(test_macro_f1), 6) AS mean, round(stddev_pop(test_macro_f1), 6) AS std_population,
       round(min(test_macro_f1), 6) AS min, round(max(test_macro_f1), 6) AS max FROM wide"""))
def _(spark, d):
    return runs.reproducibility(_wide(spark, d)).withColumns(r6("mean", "std_population", "min", "max"))


@query("tagged_union", sql(["run_predictions"], _RUNS + """
SELECT CASE WHEN run_id < 2 THEN 'head' ELSE 'objective' END AS stage, run_id, round(val_macro_f1, 6) AS val_macro_f1,
       CASE WHEN run_id < 2 THEN NULL ELSE round(val_accuracy, 6) END AS val_accuracy FROM wide"""))
def _(spark, d):
    wide = _wide(spark, d).withColumns(r6("val_macro_f1", "val_accuracy"))
    head = wide.where("run_id < 2").select("run_id", "val_macro_f1")
    objective = wide.where("run_id >= 2").select("run_id", "val_macro_f1", "val_accuracy")
    return runs.tagged_union({"head": head, "objective": objective})


@query("final_summary", sql(["run_predictions"], _RUNS + """
SELECT run_id, round(val_macro_f1, 6) AS selected_val_macro_f1, round(test_accuracy, 6) AS test_accuracy,
       round(test_macro_f1, 6) AS test_macro_f1, test_macro_f1 >= 0.82 AS update_recommended
FROM wide ORDER BY val_macro_f1 DESC, run_id LIMIT 1"""))
def _(spark, d):
    row = runs.final_summary(_wide(spark, d), threshold=0.82)
    return row.withColumns(r6("selected_val_macro_f1", "test_accuracy", "test_macro_f1"))


@query("class_count_scaling", sql(["run_predictions"], f"""
, k AS (SELECT * FROM (VALUES (0, 5), (1, 6), (2, 7), (3, 9)) v(run_id, class_count)),
r AS (SELECT p.*, class_count FROM run_predictions p JOIN k USING (run_id) WHERE true_label < class_count),
cell AS (SELECT class_count, split, l.label, count(*) FILTER (true_label = l.label) AS s,
                count(*) FILTER (predicted_label = l.label) AS p,
                count(*) FILTER (true_label = l.label AND predicted_label = l.label) AS tp
         FROM r JOIN {LABELS} l ON l.label < class_count GROUP BY 1, 2, 3),
f AS (SELECT class_count, split, avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / s) / (tp / p + tp / s) END) AS f FROM cell GROUP BY 1, 2),
a AS (SELECT class_count, split, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS a FROM r GROUP BY 1, 2)
SELECT class_count, round(max(a) FILTER (split = 'val'), 6) AS val_accuracy, round(max(f) FILTER (split = 'val'), 6) AS val_macro_f1,
       round(max(a) FILTER (split = 'test'), 6) AS test_accuracy, round(max(f) FILTER (split = 'test'), 6) AS test_macro_f1,
       array_to_string(['c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8'][1:class_count], ';') AS classes
FROM f JOIN a USING (class_count, split) GROUP BY class_count"""))
def _(spark, d):
    rows = runs.class_count_scaling(run_predictions(spark, d), CLASSES, {0: 5, 1: 6, 2: 7, 3: 9})
    return rows.withColumns(r6("val_accuracy", "val_macro_f1", "test_accuracy", "test_macro_f1"))
