from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import calibration as cal
from sigspark.operators import diagnostics as diag
from sigspark.operators import metrics as met
from sigspark.operators import runs
from sigspark.sources.predictions import attach_groups, name_predictions, normalize_predictions

CLASSES = [f"c{i}" for i in range(9)]
SCHEMA = "read_id string, true_label int, predicted_label int, confidence double, at long"


def predictions(spark, rows):
    return spark.createDataFrame([(f"r{i}", t, p, float(c), i) for i, (t, p, c) in enumerate(rows)], SCHEMA)


def random_rows(n, seed, classes=9, levels=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # one class holds a third of all rows
        t = 0 if rng.random() < 1 / 3 else rng.randrange(classes)
        p = t if rng.random() < 0.7 else rng.randrange(classes)
        rows.append((t, p, rng.randrange(levels) / levels + (0.02 if p == t else 0)))
    return rows


def f1_of(rows, c):
    tp = sum(t == p == c for t, p, _ in rows)
    s, q = sum(t == c for t, _, _ in rows), sum(p == c for _, p, _ in rows)
    return 2 * tp / (s + q) if s + q and tp else 0.0


def test_summary_against_brute_force(spark):
    rows = random_rows(700, 1, classes=7)
    r = met.class_summary(predictions(spark, rows), CLASSES).first()
    assert r.n == 700 and r.accuracy == pytest.approx(np.mean([t == p for t, p, _ in rows]))
    assert r.macro_f1 == pytest.approx(np.mean([f1_of(rows, c) for c in range(9)]))
    recalls = []
    for c in range(9):
        own = [t == p for t, p, _ in rows if t == c]
        recalls.append(np.mean(own) if own else 0.0)
    assert r.balanced_accuracy == pytest.approx(np.mean(recalls))
    observed = met.class_summary(predictions(spark, rows), None).first()
    assert observed.macro_f1 == pytest.approx(np.mean([f1_of(rows, c) for c in range(7)]))


def test_metrics_of_an_empty_table(spark):
    empty = predictions(spark, [(0, 0, 0.5)]).where("false")
    assert [r.support for r in met.class_metrics(empty, CLASSES).collect()] == [0] * 9
    assert met.class_summary(empty, CLASSES).first().n == 0
    assert sum(r.n for r in met.confusion_matrix(empty, CLASSES).collect()) == 0


def test_undeclared_labels_count_in_totals_only(spark):
    rows = random_rows(200, 11, classes=4) + [(77, 5000 + i, 0.5) for i in range(40)] + [(9, 9, 0.5)]
    pred = predictions(spark, rows)
    r = met.class_summary(pred, CLASSES[:4]).first()
    assert r.n == 241 and r.accuracy == pytest.approx(np.mean([t == p for t, p, _ in rows]))
    assert r.macro_f1 == pytest.approx(np.mean([f1_of(rows, c) for c in range(4)]))
    assert met.class_metrics(pred, CLASSES[:4]).count() == 4
    shares = cal.abundance(pred, CLASSES[:4], cal.ThresholdSpec(0.0, False)).collect()
    assert len(shares) == 4 and sum(x.reads for x in shares) == 200
    assert sum(x.fraction_of_accepted for x in shares) == pytest.approx(200 / 241)
    assert diag.confusable_pairs(pred, CLASSES[:4]).count() == 6


def test_auroc_against_all_pairs(spark):
    rows = random_rows(300, 2)
    hit = [c for t, p, c in rows if t == p]
    miss = [c for t, p, c in rows if t != p]
    expected = np.mean([[(a > b) + 0.5 * (a == b) for b in miss] for a in hit])
    assert met.auroc(predictions(spark, rows)).first().auroc == pytest.approx(expected)
    assert met.auroc(predictions(spark, [(0, 0, 0.1), (1, 1, 0.9)])).first().auroc is None


def test_aurc_against_the_trapezoid(spark):
    rows = random_rows(300, 3)
    order = sorted(range(300), key=lambda i: (-rows[i][2], i))
    errors = np.cumsum([rows[i][0] != rows[i][1] for i in order])
    risk = np.r_[0.0, errors / np.arange(1, 301)]
    expected = np.sum((risk[1:] + risk[:-1]) / 2) / 300
    assert met.aurc(predictions(spark, rows), "at").first().aurc == pytest.approx(expected)


def test_histogram_matches_numpy(spark):
    rows = random_rows(400, 4, levels=30) + [(0, 0, 1.0), (0, 1, 0.0), (0, 0, 0.3), (0, 1, 0.7)]
    rows = [(t, p, min(c, 1.0)) for t, p, c in rows]
    edges = np.linspace(0, 1, 31)
    for r_correct in (True, False):
        values = [c for t, p, c in rows if (t == p) == r_correct]
        counts, _ = np.histogram(values, bins=edges)
        got = met.confidence_hist(predictions(spark, rows)).where(F.col("correct") == r_correct).orderBy("bin").collect()
        assert [r.reads for r in got] == counts.tolist()
        assert sum(r.density for r in got) / 30 == pytest.approx(1.0)


def brute_curve(rows, grid):
    n = len(rows)
    totals = Counter(t for t, _, _ in rows)
    levels = sorted({c for _, _, c in rows}, reverse=True)
    if len(levels) > grid:
        levels = [levels[i] for i in np.unique(np.linspace(0, len(levels) - 1, grid, dtype=np.int64))]
    out = []
    for level in levels:
        taken = [r for r in rows if r[2] >= level]
        coverage = [sum(t == c for t, _, _ in taken) / totals[c] for c in range(9)]
        out.append((0.0 if len(taken) == n else level, len(taken), np.mean([t == p for t, p, _ in taken]),
                    np.mean([f1_of(taken, c) for c in range(9)]), min(coverage)))
    return out


@pytest.mark.parametrize("grid", [2, 3, 7, 16, 1001])
def test_curve_against_brute_force(spark, grid):
    rows = random_rows(500, 5)
    points = cal.risk_coverage(predictions(spark, rows), CLASSES, grid).orderBy("accepted_reads").collect()
    got = [(r.threshold, r.accepted_reads, r.accepted_accuracy, r.accepted_macro_f1, r.min_per_class_coverage) for r in points]
    np.testing.assert_allclose(np.array(got), np.array(brute_curve(rows, grid)))
    assert all(r.coverage == pytest.approx(r.accepted_reads / 500) for r in points)
    assert min(points[-1].coverage_by_class.values()) == 1.0


@pytest.mark.parametrize("n", [1, 2, 65, 154, 1000])
def test_grid_follows_linspace(spark, n):
    pred = spark.range(n).select((F.col("id") / 1000).alias("confidence")).repartition(5)
    levels = [i / 1000 for i in range(n)][::-1]
    for grid in (2, 3, 16, 64):
        expected = levels if n <= grid else [levels[i] for i in np.linspace(0, n - 1, grid, dtype=np.int64)]
        assert cal.operating_thresholds(pred, grid) == expected
        located = pred.select("confidence", cal._bucket(F.col("confidence"), expected).alias("b")).collect()
        assert all(r.b == min(i for i, t in enumerate(expected) if r.confidence >= t) for r in located)


def test_empty_predictions_cannot_be_calibrated(spark):
    with pytest.raises(ValueError, match="empty"):
        cal.risk_coverage(predictions(spark, [(0, 0, 0.5)]).where("false"), CLASSES)


def ninety(confidence=None):
    rows = []
    for i in range(90):
        ok = i % 5 != 0
        rows.append((i % 9, i % 9 if ok else (i % 9 + 1) % 9, confidence or (0.9 if ok else 0.2)))
    return rows


def test_feasible_calibration_and_report(spark):
    pred = predictions(spark, ninety())
    r = cal.calibrate(pred, CLASSES).first()
    assert r.selection_status == "target_met" and r.threshold_enabled and r.threshold > 0.2
    assert r.accepted_accuracy >= 0.9 and r.min_per_class_coverage >= 0.5
    spec = cal.threshold_spec(cal.calibrate(pred, CLASSES))
    s = cal.selective_report(pred, CLASSES, spec).first()
    assert (s.total_reads, s.accepted_reads, s.abstained_reads) == (90, 72, 18) and s.accepted_accuracy == 1.0
    assert sum(x.reads for x in cal.abundance(pred, CLASSES, spec).collect()) == 72


def test_infeasible_calibration_switches_abstention_off(spark):
    pred = predictions(spark, ninety(0.8))
    r = cal.calibrate(pred, CLASSES, target_accuracy=0.95).first()
    assert (r.selection_status, r.threshold_enabled, r.threshold) == ("no_feasible_selective_operating_point", False, 0.0)
    spec = cal.ThresholdSpec(0.0, False)
    assert cal.selective_report(pred, CLASSES, spec).first().accepted_reads == 90


def test_calibration_needs_every_class_and_valid_limits(spark):
    pred = predictions(spark, ninety()).where("true_label <> 3")
    with pytest.raises(Exception, match="predictions do not contain class c3"):
        cal.calibrate(pred, CLASSES).collect()
    for bad in ({"min_coverage": 0}, {"target_accuracy": 1.5}, {"min_per_class_coverage": -1}, {"min_accuracy_gain": -0.1}):
        with pytest.raises(ValueError):
            cal.calibrate(pred, CLASSES, **bad)
    with pytest.raises(ValueError, match=r"min_coverage = nan .*min_accuracy_gain = -1"):
        cal.Limits(min_coverage=float("nan"), min_accuracy_gain=-1)
    assert cal.Limits(target_accuracy=None, min_per_class_coverage=0).target_accuracy is None
    with pytest.raises(ValueError, match="grid_size"):
        cal.risk_coverage(pred, CLASSES, 1)


def test_only_validation_thresholds_may_be_frozen():
    with pytest.raises(ValueError, match="validation"):
        cal.ThresholdSpec(0.5, True, "test")


def test_nothing_accepted(spark):
    s = cal.selective_report(predictions(spark, ninety()), CLASSES, cal.ThresholdSpec(0.99, True)).first()
    assert s.accepted_reads == 0 and s.accepted_accuracy is None and s.accepted_macro_f1 is None


def test_group_accuracy_of_two_files(spark):
    rows = [("a", 0, 0, "f0"), ("b", 0, 1, "f0"), ("c", 1, 1, "f1"), ("d", 1, 1, "f1")]
    df = spark.createDataFrame(rows, "read_id string, true_label int, predicted_label int, ccf_file string")
    groups = met.group_accuracy(df)
    assert {r.ccf_file: (r.label, r.n_reads, r.accuracy) for r in groups.collect()} == {"f0": (0, 2, 0.5), "f1": (1, 2, 1.0)}
    s = met.group_summary(groups).first()
    assert (s.n_groups, s.worst_group_accuracy, s.best_group_accuracy) == (2, 0.5, 1.0)
    assert s.p10_group_accuracy == pytest.approx(0.55)
    with pytest.raises(Exception, match="file contains multiple labels: f0"):
        met.group_accuracy(df.withColumn("ccf_file", F.lit("f0"))).collect()


def test_reads_without_a_file_are_an_error(spark):
    pred = predictions(spark, ninety())
    manifest = pred.select("read_id", F.lit("f").alias("ccf_file"))
    assert attach_groups(pred, manifest).count() == 90
    with pytest.raises(Exception, match="read is missing from the manifest: r0"):
        attach_groups(pred, manifest.where("read_id <> 'r0'")).collect()
    with pytest.raises(Exception, match="read has several files in the manifest: r0"):
        attach_groups(pred, manifest.union(spark.createDataFrame([("r0", "g")], manifest.schema))).collect()


def test_confusable_pairs_cover_unseen_classes(spark):
    pred = predictions(spark, [(0, 1, 0.1), (1, 0, 0.1), (0, 0, 0.1), (2, 0, 0.2)])
    rows = {(r.left_class, r.right_class): (r.symmetric_errors, r.symmetric_error_rate) for r in diag.confusable_pairs(pred, CLASSES).collect()}
    assert len(rows) == 36
    assert rows[("c0", "c1")] == (2, pytest.approx(2 / 3)) and rows[("c0", "c2")] == (1, pytest.approx(1 / 3))
    assert rows[("c7", "c8")] == (0, 0.0)
    assert diag.hard_pairs(pred, CLASSES).first().hard_pairs.startswith("c0:c1,c0:c2,")


def test_undeclared_labels_get_a_fallback_name(spark):
    row = name_predictions(predictions(spark, [(0, 9, 0.5)]), CLASSES).first()
    assert (row.true_species, row.predicted_species, row.correct) == ("c0", "class_9", 0)


def test_prediction_columns_are_checked(spark):
    df = predictions(spark, ninety()).withColumnRenamed("predicted_label", "pred_label")
    assert "predicted_label" in normalize_predictions(df).columns
    with pytest.raises(ValueError, match="missing columns"):
        normalize_predictions(df.drop("confidence"))
    with pytest.raises(ValueError, match="missing columns"):
        normalize_predictions(df.drop("true_label"))
    normalize_predictions(df.drop("true_label"), require_truth=False)


def test_metrics_do_not_depend_on_partitions(spark):
    rows = random_rows(600, 8)
    a, b = (predictions(spark, rows).repartition(n) for n in (1, 13))
    for f in (lambda p: met.auroc(p), lambda p: met.aurc(p, "at"), lambda p: cal.calibrate(p, CLASSES, target_accuracy=0.7)):
        left, right = f(a).first().asDict(), f(b).first().asDict()
        assert left == pytest.approx(right) if not any(isinstance(v, str) for v in left.values()) else left == right


def test_gates(spark):
    wide = spark.createDataFrame(
        [(0, 0.8, 0.80, 0.79, 0.78, 0.5), (1, 0.9, 0.86, 0.8, 0.84, 0.6), (2, 0.9, 0.86, 0.8, 0.83, 0.4)],
        "run_id int, val_accuracy double, val_macro_f1 double, test_accuracy double, test_macro_f1 double, val_p10_group_accuracy double",
    )
    rows = {r.run_id: r for r in runs.compare_to_baseline(wide, 0, min_score=0.85, min_gain=0.05).collect()}
    assert rows[1].is_best and not rows[2].is_best and rows[1].decision == "scale"
    assert {r.decision for r in runs.compare_to_baseline(wide, 0, min_score=0.9, min_gain=0.05).collect()} == {"do_not_scale"}
    smoke = runs.compare_to_baseline(wide, 0, min_score=0.85, min_gain=0.05, smoke=True)
    assert {r.decision for r in smoke.collect()} == {"smoke_only"}
    assert [r.run_id for r in runs.select_candidate(wide).orderBy("rank").collect()] == [1, 2, 0]
    gate = lambda c: runs.robustness_gate(wide, 0, c, min_f1_gain=0.05, min_p10_gain=0.0).first()
    assert gate(1).promote_to_test and not gate(2).promote_to_test and gate(2).decision == "freeze_baseline"
    rep = runs.reproducibility(wide).first()
    assert rep.n_completed == 3 and rep.std_population == pytest.approx(np.std([0.78, 0.84, 0.83]))
    assert runs.final_summary(wide, threshold=0.82).first().update_recommended


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_exact_quantiles_equal_numpy(spark, keys):
    rng = np.random.default_rng(4)
    rows = [(("hot", "a", "b")[int(rng.integers(0, 9)) // 4 if i % 7 else 2], None if i % 50 == 0 else float(rng.integers(0, 40)) / 7) for i in range(3000)]
    rows.append(("lone", 2.5))
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.1, "mid": 0.5, "all": 1.0, "none": 0.0, "odd": 0.333}
    found = {tuple(r[k] for k in keys): r for r in met.exact_quantiles(df, "v", wanted, keys).collect()}
    for key in {r[0] for r in rows} if keys else {None}:
        values = [v for k, v in rows if v is not None and key in (None, k)]
        got = found[(key,) if keys else ()]
        for name, q in wanted.items():
            assert got[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_a_summary_of_files_has_no_single_task_percentile(spark):
    groups = spark.createDataFrame([(0.5,), (0.25,), (1.0,)], "accuracy double")
    plan = met.group_summary(groups)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan.replace("median_group", "")
