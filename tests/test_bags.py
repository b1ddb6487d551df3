from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from sigspark.functions import arrays as arr
from sigspark.operators import bags as bag
from sigspark.operators import training

DIM = 6
CLASSES = ["a", "b", "c"]


def chunks(spark, seed=0, reads=40, hot=True):
    """Bags of different sizes; one read may hold a third of all chunks."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 6, reads)
    if hot:
        sizes[0] = sizes.sum() // 2
    rows = [(f"r{i}", j, i % 3, rng.normal(size=DIM).astype(np.float32).tolist()) for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "read_id string, chunk_index int, label int, embedding array<float>")
    by_read = {}
    for r, _, _, e in rows:
        by_read.setdefault(r, []).append(np.array(e, dtype=np.float32).astype(np.float64))
    return df.repartition(5), {k: np.stack(v) for k, v in by_read.items()}


def params(seed=1):
    rng = np.random.default_rng(seed)
    return bag.AttentionParams(
        rng.normal(size=(4, DIM)), rng.normal(size=(4, DIM)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=4), 0.3
    )


def test_mean_pooling(spark):
    df, expected = chunks(spark)
    rows = bag.pool_mean(df, ["read_id"], DIM).collect()
    assert {r.read_id: r.n_chunks for r in rows} == {k: len(v) for k, v in expected.items()}
    for r in rows:
        np.testing.assert_allclose(r.vector, expected[r.read_id].mean(axis=0), atol=1e-12)


def test_attention_pooling_equals_a_softmax_per_bag(spark):
    df, expected = chunks(spark)
    p = params()
    for r in bag.pool_attention(df, p, ["read_id"]).collect():
        h = expected[r.read_id]
        score = (np.tanh(h @ p.v.T + p.v0) / (1 + np.exp(-(h @ p.u.T + p.u0)))) @ p.w + p.w0
        weight = np.exp(score - score.max())
        pooled = (weight / weight.sum()) @ h
        np.testing.assert_allclose(r.vector, pooled / np.linalg.norm(pooled), atol=1e-9)
    with pytest.raises(ValueError, match="too large"):
        bag.pool_attention(df, bag.AttentionParams(p.v, p.u, p.w * 1e4), ["read_id"])


@pytest.mark.parametrize("layout", ["sorted", "mixed", "one"])
def test_pooling_of_small_batches_and_hot_keys(spark, layout):
    """A run of one key over many batches becomes one partial row, and partitioning does not matter."""
    rng = np.random.default_rng(8)
    n = 3000
    reads = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n)) if layout != "one" else np.zeros(n, dtype=int)
    reads = np.sort(reads) if layout == "sorted" else reads
    values = rng.normal(size=(n, DIM))
    rows = [(None if r == 5 else f"r{r}", int(r) % 2, v.tolist()) for r, v in zip(reads, values)]
    df = spark.createDataFrame(rows, "read_id string, part int, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.read_id: r for r in bag.pool_mean(df, ["read_id", "part"], DIM).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(reads))
    for r in set(reads):
        row = got[None if r == 5 else f"r{r}"]
        assert row.n_chunks == (reads == r).sum() and row.part == r % 2
        np.testing.assert_allclose(row.vector, values[reads == r].mean(axis=0), atol=1e-12)


def test_runs_are_summed_across_batches():
    batches = [pa.RecordBatch.from_pydict({"k": ["a"] * 5}), pa.RecordBatch.from_pydict({"k": ["a", "a", "b", "a"]})]
    ones = lambda b: (np.ones(b.num_rows), np.ones(b.num_rows), np.ones((b.num_rows, 2)))
    out = [(c[0].to_pylist(), n.tolist()) for c, n, _, _ in bag._sum_by_key(iter(batches), ["k"], ones)]
    assert out == [(["b"], [1.0]), (["a"], [8.0])]


def test_scoring_equals_numpy(spark):
    df, expected = chunks(spark)
    rng = np.random.default_rng(2)
    head = bag.LinearHead(rng.normal(size=(3, DIM)), rng.normal(size=3))
    for r in bag.score_bags(df, head, CLASSES, dim=DIM).collect():
        z = head.weights @ expected[r.read_id].mean(axis=0) + head.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        np.testing.assert_allclose(r.probabilities, p)
        assert r.predicted_label == int(p.argmax()) and r.confidence == pytest.approx(p.max())
        assert r.predicted_species == CLASSES[r.predicted_label]


def test_ties_take_the_lowest_label(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>").select(arr.argmax(arr.softmax(F.col("z"))).alias("p"))
    assert df.first().p == 1


def test_softmax_survives_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 999.0],)], "z array<double>").select(arr.softmax(F.col("z")).alias("p"))
    np.testing.assert_allclose(df.first().p, [1 / (1 + np.exp(-1)), 1 / (1 + np.e)])


def test_encoder_output_is_averaged_over_time(spark):
    rows = [(f"r{i}", 0, [float(i + j) for j in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "read_id string, chunk_index int, chunk array<double>")

    def make():
        return lambda batch: np.stack([batch, 3 * batch], axis=1)

    for r in bag.encode_chunks(df, make, chunk_size=4, batch_size=7).collect():
        np.testing.assert_allclose(r.embedding, [2 * (int(r.read_id[1:]) + j) for j in range(4)])


def test_centroids(spark):
    rows = [(f"r{i}", i % 3, [float(v) for v in np.eye(DIM)[i % 3] + 0.1 * (i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "read_id string, label int, vector array<double>")
    head = bag.fit_centroids(df, CLASSES, DIM)
    np.testing.assert_allclose(np.linalg.norm(head.weights, axis=1), 1)
    got = bag.score_vectors(df.withColumnRenamed("label", "true_label"), head, CLASSES)
    assert got.where("true_label <> predicted_label").count() == 0


def test_agreement_of_equal_and_disturbed_embeddings(spark):
    df, _ = chunks(spark, hot=False)
    details, summary = bag.embedding_agreement(df, df)
    assert summary.first().status == "pass" and summary.first().maximum_abs_error == 0
    flipped = df.withColumn("embedding", F.transform("embedding", lambda v: -v))
    assert bag.embedding_agreement(df, flipped)[1].first().minimum_cosine == pytest.approx(-1)
    assert details.count() == 40
    few = bag.first_read_per_class(df, 2, ["chunk_index"])
    assert {(r.label, r.read_id) for r in few.collect()} == {(0, "r0"), (1, "r1"), (2, "r11")}
    assert few.agg(F.max("chunk_index")).first()[0] <= 1


def test_distillation_terms(spark):
    rng = np.random.default_rng(4)
    n, t, eps = 50, 2.5, 0.1
    s, z, a, b = (rng.normal(size=(n, d)) for d in (3, 3, 5, 5))
    y = rng.integers(0, 3, n)
    rows = [(int(y[i]), s[i].tolist(), z[i].tolist(), a[i].tolist(), b[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(
        rows, "label int, student_logits array<double>, teacher_logits array<double>, student_embedding array<double>, teacher_embedding array<double>"
    )
    log = lambda x: x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    ce = np.mean(-(1 - eps) * log(s)[np.arange(n), y] - eps / 3 * log(s).sum(axis=1))
    kd = np.mean((np.exp(log(z / t)) * (log(z / t) - log(s / t))).sum(axis=1)) * t * t
    align = np.mean(1 - (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)))
    r = bag.distill_terms(df, temperature=t, label_smoothing=eps, n_classes=3).first()
    assert (r.ce, r.kd, r.alignment) == pytest.approx((ce, kd, align))


def test_worst_group_gains_weight(spark):
    losses = spark.createDataFrame(list(enumerate([0.1, 0.2, 1.5, 0.3])), "group_id long, loss double")
    weights = spark.createDataFrame([(i, 0.2) for i in range(5)], "group_id long, weight double")
    rows = {r.group_id: r for r in training.group_reweight(losses, weights, 0.1).collect()}
    w = np.array([0.2 * np.exp(0.1 * v) for v in (0.1, 0.2, 1.5, 0.3)] + [0.2])
    w /= w.sum()
    assert [rows[i].weight for i in range(5)] == pytest.approx(w.tolist())
    active = w[:4] / w[:4].sum()
    assert [rows[i].active_weight for i in range(4)] == pytest.approx(active.tolist()) and rows[4].active_weight is None
    assert rows[2].weight == max(r.weight for r in rows.values())
    total = training.weighted_loss(training.group_reweight(losses, weights, 0.1)).first().loss
    assert total == pytest.approx(float(active @ np.array([0.1, 0.2, 1.5, 0.3])))


def test_huge_losses_are_clamped(spark):
    losses = spark.createDataFrame([(0, 1e6), (1, 0.0)], "group_id long, loss double")
    weights = spark.createDataFrame([(0, 0.5), (1, 0.5)], "group_id long, weight double")
    rows = {r.group_id: r.weight for r in training.group_reweight(losses, weights, 1.0).collect()}
    assert rows[0] == pytest.approx(1e4 / (1e4 + 1))


def test_mixup(spark):
    df, _ = chunks(spark, hot=False)
    rows = df.where("chunk_index = 0").select("read_id", "label", F.col("embedding").alias("vector"))
    mixed = training.mixup_rows(rows, seed=1, epoch=0, alpha=0.4, batch_size=8, n_classes=3).collect()
    source = {r.read_id: (r.label, np.array(r.vector)) for r in rows.collect()}
    assert len(mixed) == 40 and sorted(r.partner_id for r in mixed) == sorted(source)
    for r in mixed:
        assert r.partner_id != r.read_id and 0.5 <= r.lam <= 1
        v = r.lam * source[r.read_id][1] + (1 - r.lam) * source[r.partner_id][1]
        np.testing.assert_allclose(r.vector, v / np.linalg.norm(v), atol=1e-6)
        t = np.zeros(3)
        t[source[r.read_id][0]] += r.lam
        t[source[r.partner_id][0]] += 1 - r.lam
        np.testing.assert_allclose(r.target, t)


def test_training_picks_the_candidate_that_is_best_on_validation(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 3))
        rows.append((f"r{i}", label, (np.eye(DIM)[label] * 3 + rng.normal(size=DIM) * 0.3).tolist()))
    df = spark.createDataFrame(rows, "read_id string, label int, vector array<double>")
    parts = [df.where(F.expr(f"CAST(substr(read_id, 2) AS INT) % 3 = {i}")) for i in range(3)]
    estimators = {"flat": LogisticRegression(maxIter=1, regParam=1e6), "good": LogisticRegression(maxIter=20)}
    fitted = training.fit_head(parts[0], parts[1], estimators, CLASSES)
    assert fitted.name == "good" and fitted.candidates.count() == 2
    test = training.predict(fitted.model, parts[2])
    assert test.where("true_label = predicted_label").count() / test.count() > 0.95


def test_teacher_must_know_every_read(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "read_id string")
    teacher = spark.createDataFrame([("a", [0.0], [1.0])], "read_id string, logits array<double>, embedding array<double>")
    assert bag.teacher_join(rows.where("read_id = 'a'"), teacher).count() == 1
    with pytest.raises(Exception, match="teacher has no output for read b"):
        bag.teacher_join(rows, teacher).collect()


def test_ragged_vectors_are_an_error():
    import pyarrow as pa

    from sigspark.operators.bags import _matrix

    with pytest.raises(ValueError, match="2 of 3 vectors"):
        _matrix(pa.array([[1.0, 2.0, 3.0], [4.0], [5.0, 6.0]]), 3, 2)
    with pytest.raises(ValueError):
        _matrix(pa.array([[1.0, 2.0], None]), 2, 2)


def test_classes_without_a_common_kmer_have_distance_one(spark):
    from sigspark.operators.kmers import kmer_distance

    rows = spark.createDataFrame([("a", "r1", "aaaaaaaa"), ("b", "r2", "cccccccc")], "barcode string, read_id string, seq string")
    found = {(r.src, r.dst): round(r.distance, 9) for r in kmer_distance(rows, 5, ["a", "b", "absent"]).collect()}
    assert {k: v for k, v in found.items() if "absent" not in k} == {("a", "a"): 0.0, ("b", "b"): 0.0, ("a", "b"): 1.0, ("b", "a"): 1.0}
    assert len(found) == 9 and all(v == 1.0 for k, v in found.items() if "absent" in k)
    plan = kmer_distance(rows, 5, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("alpha", [0.2, 0.4, 1.0, 3.0])
def test_mixing_table_follows_the_beta_distribution(alpha):
    table = np.array(training.mixing_table(alpha))
    draws = np.random.default_rng(0).beta(alpha, alpha, 400_000)
    folded = np.maximum(draws, 1 - draws)
    assert np.all(np.diff(table) <= 0) and table[0] <= 1 and table[-1] >= 0.5
    expected = np.quantile(folded, 1 - (np.arange(1024) + 0.5) / 1024)
    assert np.abs(table - expected).max() < 0.01


def test_gradient_of_a_finished_fit_is_zero_per_class(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(2)
    rows = [([float(v) for v in rng.normal(size=3) + i % 3], i % 3) for i in range(240)]
    train = spark.createDataFrame(rows, "vector array<double>, label int")
    done, stopped = (training.fit_head(train, train, {"one": LogisticRegression(maxIter=n, tol=1e-9)}, CLASSES[:3]) for n in (200, 0))
    assert max(abs(r.gradient) for r in training.class_balance(done.model, train, CLASSES[:3]).collect()) < 1e-5
    assert done.candidates.count() == 1 and stopped.candidates.first().accuracy <= done.candidates.first().accuracy
