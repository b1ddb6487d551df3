"""Pooling, scoring, k-mers and training."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from sigspark.functions.arrays import argmax, norm, softmax, sum_of
from sigspark.operators import bags as bag
from sigspark.operators import chunks as ch
from sigspark.operators import kmers, splits, training
from sigspark.plans.bridge import bags, predictions, sequences, signals
from sigspark.plans.registry import query, sql
from sigspark.plans.signal_queries import MAD_SQL, picks_sql
from sigspark.sources.predictions import wide_probabilities
from sigspark.sources.signals import select_reads

DIM = 64
CLASSES = tuple(f"c{i}" for i in range(10))
KMER = 6

# a fixed head, written the same way in SQL
HEAD = bag.LinearHead(
    np.array([[((c * 31 + j * 17) % 13 - 6) / 2 for j in range(DIM)] for c in range(10)]),
    np.array([c / 10 for c in range(10)]),
)

_LONG = """, long AS (SELECT read_id, chunk_index, label, split, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM bags),
pooled AS (SELECT read_id, any_value(split) AS split, pos, avg(v) AS v FROM long GROUP BY read_id, pos)"""


def pooled(spark, d):
    rows = bags(spark, d)
    return bag.pool_mean(rows, ["read_id"], DIM)


def labelled(spark, d):
    """Chunk-level vectors as one-chunk reads, because the labels of a test bag differ from chunk to chunk."""
    rows = bags(spark, d)
    return rows.select(
        F.concat("read_id", F.lit("-"), "chunk_index").alias("read_id"), "label", "split",
        F.transform("embedding", lambda v: v.cast("double")).alias("vector"),
    )


@query("bag_scan", sql(["bags"], """
SELECT read_id, count(*) AS n, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk, min(len(embedding)) AS dim
FROM bags WHERE read_id IN (SELECT read_id FROM bags WHERE chunk_index = 0 AND label < 5) GROUP BY 1"""))
def _(spark, d):
    rows = bags(spark, d)
    return select_reads(rows, rows.where("chunk_index = 0 AND label < 5"), ["read_id"]).groupBy("read_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"),
        F.min(F.size("embedding")).cast("long").alias("dim"),
    )


@query("bag_mean_pool", sql(["bags"], _LONG + "SELECT read_id, pos, round(v, 5) AS value FROM pooled"))
def _(spark, d):
    return pooled(spark, d).select("read_id", F.posexplode("vector").alias("pos", "value")).select(
        "read_id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value")
    )


# attention weights by formula: V[a][j], U[a][j], w[a] for 4 gates
ATTENTION = bag.AttentionParams(
    v=np.array([[((a * 7 + j * 5) % 11 - 5) / 5 for j in range(DIM)] for a in range(4)]),
    u=np.array([[((a * 3 + j * 13) % 9 - 4) / 4 for j in range(DIM)] for a in range(4)]),
    w=np.array([1.0, -2.0, 0.5, 1.5]),
)


@query("bag_attention_pool", sql(["bags"], _LONG + """
, gates AS (SELECT read_id, chunk_index, a, tanh(sum(v * ((a * 7 + pos * 5) % 11 - 5) / 5))
              / (1 + exp(-sum(v * ((a * 3 + pos * 13) % 9 - 4) / 4))) AS g
            FROM long CROSS JOIN range(4) t(a) GROUP BY 1, 2, 3),
score AS (SELECT read_id, chunk_index, exp(sum(g * [1.0, -2.0, 0.5, 1.5][a + 1])) AS e FROM gates GROUP BY 1, 2),
raw AS (SELECT read_id, pos, sum(v * e) / sum(e) AS v FROM long JOIN score USING (read_id, chunk_index) GROUP BY 1, 2)
SELECT read_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY read_id)), 5) AS value FROM raw"""))
def _(spark, d):
    rows = bag.pool_attention(bags(spark, d), ATTENTION, ["read_id"])
    return rows.select("read_id", F.posexplode("vector").alias("pos", "value")).select(
        "read_id", F.col("pos").cast("long").alias("pos"), F.round("value", 5).alias("value")
    )


_SCORED = _LONG + """
, logits AS (SELECT read_id, c, sum(v * ((c * 31 + pos * 17) % 13 - 6) / 2) + c / 10 AS z FROM pooled CROSS JOIN range(10) t(c) GROUP BY 1, 2),
probs AS (SELECT read_id, c, exp(z) / sum(exp(z)) OVER (PARTITION BY read_id) AS p, row_number() OVER (PARTITION BY read_id ORDER BY z DESC, c) AS r FROM logits)"""


@query("score_bags", sql(["bags"], _SCORED + """
SELECT read_id, CAST(c AS INTEGER) AS predicted_label, 'c' || CAST(c AS VARCHAR) AS predicted_species, round(p, 5) AS confidence
FROM probs WHERE r = 1"""))
def _(spark, d):
    return bag.score_bags(bags(spark, d), HEAD, CLASSES, dim=DIM).select(
        "read_id", "predicted_label", "predicted_species", F.round("confidence", 5).alias("confidence")
    )


@query("predictions_wide", sql(["bags"], _SCORED + "\nSELECT read_id, " + ", ".join(
    f"round(max(p) FILTER (c = {i}), 5) AS prob_{i}, round(max(p) FILTER (c = {i}), 5) AS prob_c{i}" for i in range(10))
    + " FROM probs GROUP BY read_id"))
def _(spark, d):
    wide = wide_probabilities(bag.score_bags(bags(spark, d), HEAD, CLASSES, dim=DIM), CLASSES)
    names = [f"prob_{x}" for i in range(10) for x in (i, f"c{i}")]
    return wide.select("read_id", *[F.round(c, 5).alias(c) for c in names])


@query("softmax_predict", sql(["bags"], """
, z AS (SELECT vec_id, unnest(range(9)) AS c, unnest(list_transform(embedding[1:9], lambda v: CAST(v AS DOUBLE) * 10)) AS z FROM bags),
p AS (SELECT vec_id, c, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, c) AS r FROM z)
SELECT vec_id, CAST(c AS INTEGER) AS predicted_label, round(p, 6) AS confidence FROM p WHERE r = 1"""))
def _(spark, d):
    logits = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double") * 10)
    return bags(spark, d).withColumn("p", softmax(logits)).select(
        "vec_id", argmax(F.col("p")).alias("predicted_label"), F.round(F.array_max("p"), 6).alias("confidence")
    )


@query("centroid_predict", sql(["bags"], """
, long AS (SELECT read_id || '-' || CAST(chunk_index AS VARCHAR) AS read_id, label, split, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM bags),
c AS (SELECT label, pos, avg(v) AS v FROM long WHERE split = 'train' GROUP BY 1, 2),
cn AS (SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM c),
s AS (SELECT t.read_id, any_value(t.label) AS true_label, cn.label AS c, sum(t.v * cn.v) AS d FROM long t JOIN cn USING (pos) WHERE t.split = 'test' GROUP BY 1, 3)
SELECT read_id, true_label, CAST(c AS INTEGER) AS predicted_label FROM s QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY d DESC, c) = 1"""))
def _(spark, d):
    rows = labelled(spark, d)
    head = bag.fit_centroids(rows.where("split = 'train'"), CLASSES, DIM)
    test = rows.where("split = 'test'").withColumnRenamed("label", "true_label")
    return bag.score_vectors(test, head, CLASSES).select("read_id", "true_label", "predicted_label")


_AGREE = """, pairs AS (SELECT a.read_id, a.chunk_index, unnest(a.embedding) AS x, unnest(list_transform(a.embedding, lambda v: round(v, 2))) AS y FROM bags a),
c AS (SELECT read_id, chunk_index, sum(CAST(x AS DOUBLE) * y) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(CAST(y AS DOUBLE) * y))) AS cosine,
             max(abs(CAST(x AS DOUBLE) - y)) AS gap FROM pairs GROUP BY 1, 2)"""


@query("embedding_agreement", sql(["bags"], _AGREE + """
SELECT count(*) AS n_chunks, round(min(cosine), 5) AS minimum_cosine, round(avg(cosine), 5) AS mean_cosine,
       round(max(gap), 5) AS maximum_abs_error, CASE WHEN min(cosine) >= 0.999 THEN 'pass' ELSE 'fail' END AS status FROM c"""))
def _(spark, d):
    rows = bags(spark, d)
    stored = rows.withColumn("embedding", F.transform("embedding", lambda v: F.round(v, 2)))
    return bag.embedding_agreement(rows, stored)[1].withColumns(
        {c: F.round(c, 5) for c in ("minimum_cosine", "mean_cosine", "maximum_abs_error")}
    )


@query("distill_terms", sql(["bags"], """
, l AS (SELECT vec_id, label, unnest(range(10)) AS c, unnest(list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 8)) AS s,
               unnest(list_transform(embedding[11:20], lambda v: CAST(v AS DOUBLE) * 8)) AS t FROM bags),
q AS (SELECT vec_id, label, c, s - ln(sum(exp(s)) OVER w) AS ls, s / 2 - ln(sum(exp(s / 2)) OVER w) AS s2, t / 2 - ln(sum(exp(t / 2)) OVER w) AS t2
      FROM l WINDOW w AS (PARTITION BY vec_id)),
r AS (SELECT vec_id, -0.9 * max(ls) FILTER (c = label) - 0.01 * sum(ls) AS ce, 4 * sum(exp(t2) * (t2 - s2)) AS kd FROM q GROUP BY 1),
e AS (SELECT vec_id, unnest(embedding[1:32]) AS a, unnest(embedding[33:64]) AS b FROM bags),
al AS (SELECT vec_id, 1 - sum(CAST(a AS DOUBLE) * b) / (sqrt(sum(CAST(a AS DOUBLE) * a)) * sqrt(sum(CAST(b AS DOUBLE) * b))) AS g FROM e GROUP BY 1)
SELECT count(*) AS n, round(avg(ce), 5) AS ce, round(avg(kd), 5) AS kd, round(avg(g), 5) AS alignment FROM r JOIN al USING (vec_id)"""))
def _(spark, d):
    scaled = lambda start: F.transform(F.slice("embedding", start, 10), lambda v: v.cast("double") * 8)
    rows = bags(spark, d).select(
        "label", scaled(1).alias("student_logits"), scaled(11).alias("teacher_logits"),
        F.slice("embedding", 1, 32).alias("student_embedding"), F.slice("embedding", 33, 32).alias("teacher_embedding"),
    )
    terms = bag.distill_terms(rows, temperature=2.0, label_smoothing=0.1, n_classes=10)
    return terms.withColumns({c: F.round(c, 5) for c in ("ce", "kd", "alignment")})


@query("teacher_join", sql(["bags"], """
SELECT read_id, chunk_index, label, round(CAST(embedding[1] AS DOUBLE) * 2, 5) AS first_logit, CAST(len(embedding) AS INTEGER) AS dim FROM bags WHERE split = 'train'"""))
def _(spark, d):
    rows = labelled(spark, d)
    teacher = rows.select(
        "read_id", F.transform("vector", lambda v: v * 2).alias("logits"), F.col("vector").alias("embedding")
    )
    joined = bag.teacher_join(rows.where("split = 'train'").select("read_id", "label"), teacher)
    return joined.select(
        F.split_part("read_id", F.lit("-"), F.lit(1)).alias("read_id"),
        F.split_part("read_id", F.lit("-"), F.lit(2)).cast("int").alias("chunk_index"), "label",
        F.round(F.get("logits", 0), 5).alias("first_logit"), F.size("teacher_embedding").alias("dim"),
    )


@query("group_reweight", sql(["predictions"], """
, l AS (SELECT ccf_file, avg(1 - confidence) AS g FROM predictions WHERE split = 'val' AND true_label < 8 GROUP BY 1),
w AS (SELECT a.ccf_file, g, 1.0 / count(*) OVER () * CASE WHEN g IS NULL THEN 1 ELSE least(exp(0.5 * g), 10000) END AS u
      FROM (SELECT DISTINCT ccf_file FROM predictions) a LEFT JOIN l USING (ccf_file))
SELECT ccf_file AS group_id, round(g, 6) AS group_loss, round(u / sum(u) OVER (), 6) AS weight,
       round(CASE WHEN g IS NOT NULL THEN u / sum(u) FILTER (g IS NOT NULL) OVER () END, 6) AS active_weight FROM w"""))
def _(spark, d):
    pred = predictions(spark, d)
    losses = pred.where("split = 'val' AND true_label < 8").select(
        F.col("ccf_file").alias("group_id"), (1 - F.col("confidence")).alias("loss")
    )
    groups = pred.select(F.col("ccf_file").alias("group_id")).distinct()
    weights = groups.withColumn("weight", F.lit(1.0 / groups.count()))
    rows = training.group_reweight(losses, weights, 0.5)
    return rows.withColumns({c: F.round(c, 6) for c in ("group_loss", "weight", "active_weight")})


_GRAMS = """, grams AS (SELECT read_id, barcode, substr(seq, i, {k}) AS g FROM sequences, LATERAL (SELECT unnest(range(1, greatest(length(seq) - {k} + 2, 1))) AS i)),
canon AS (SELECT read_id, barcode, least(g, reverse(translate(g, 'acgt', 'tgca'))) AS kmer FROM grams)"""


@query("kmer_counts", sql(["sequences"], _GRAMS.format(k=KMER) + """
SELECT read_id, count(*) AS n_kmers, count(DISTINCT kmer) AS n_distinct FROM canon GROUP BY 1"""))
def _(spark, d):
    rows = kmers.read_kmers(sequences(spark, d), KMER)
    return rows.groupBy("read_id").agg(F.sum("n").alias("n_kmers"), F.count(F.lit(1)).alias("n_distinct"))


@query("kmer_vectors", sql(["sequences"], _GRAMS.format(k=3) + """
SELECT s.read_id, """ + ", ".join(f"count(*) FILTER (kmer = '{m}') AS {m}" for m in ("aaa", "acg", "tca")) + """,
       count(kmer) AS n_kmers FROM sequences s LEFT JOIN canon USING (read_id) GROUP BY 1"""))
def _(spark, d):
    rows = kmers.kmer_vectors(sequences(spark, d), 3)
    at = {m: kmers.canonical_rank(3)[1].index(m) for m in ("aaa", "acg", "tca")}
    total = F.aggregate("kmers", F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "read_id", *[F.get("kmers", i).cast("long").alias(m) for m, i in at.items()], total.cast("long").alias("n_kmers")
    )


@query("kmer_spectrum", sql(["sequences"], _GRAMS.format(k=KMER) + "SELECT barcode, kmer, count(*) AS n FROM canon GROUP BY 1, 2"))
def _(spark, d):
    return kmers.kmer_counts(sequences(spark, d), KMER, ["barcode"])


_DIST = _GRAMS.format(k=5) + """
, v AS (SELECT barcode, kmer, CAST(count(*) AS DOUBLE) AS n FROM canon GROUP BY 1, 2),
norms AS (SELECT barcode, sqrt(sum(n * n)) AS norm FROM v GROUP BY 1),
dist AS (SELECT a.barcode AS src, b.barcode AS dst, 1 - sum(a.n * b.n) / (any_value(x.norm) * any_value(y.norm)) AS distance
  FROM v a JOIN v b USING (kmer) JOIN norms x ON x.barcode = a.barcode JOIN norms y ON y.barcode = b.barcode GROUP BY 1, 2)"""


LANGS = ["de", "en", "es", "fr"]


@query("kmer_distance", sql(["sequences"], _DIST + "SELECT src, dst, round(distance, 6) + 0.0 AS distance FROM dist"))
def _(spark, d):
    return kmers.kmer_distance(sequences(spark, d), 5, LANGS).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query("distance_unpivot", sql(["sequences"], _DIST + "SELECT src, dst, round(distance, 6) + 0.0 AS distance FROM dist"))
def _(spark, d):
    from sigspark.sources.tables import unpivot_distances

    wide = (
        kmers.kmer_distance(sequences(spark, d), 5, LANGS)
        .groupBy(F.concat("src", F.lit(" genome")).alias("label"))
        .pivot("dst", LANGS)
        .agg(F.first("distance"))
        .withColumnsRenamed({c: f"{c} genome" for c in LANGS})
    )
    return unpivot_distances(wide).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query("greedy_order", sql(["sequences"], _DIST + """
, s3 AS (SELECT src AS name FROM dist WHERE dst IN ('de', 'en') AND src NOT IN ('de', 'en') GROUP BY src
         ORDER BY min(distance) DESC, src DESC LIMIT 1),
s4 AS (SELECT src AS name FROM dist WHERE src NOT IN ('de', 'en') AND src NOT IN (SELECT name FROM s3) GROUP BY src)
SELECT CAST(0 AS INTEGER) AS position, 'de' AS barcode UNION ALL SELECT 1, 'en' UNION ALL SELECT 2, name FROM s3 UNION ALL SELECT 3, name FROM s4"""))
def _(spark, d):
    return splits.greedy_order(kmers.kmer_distance(sequences(spark, d), 5, LANGS), ("de", "en"))


PROFILE = ch.SignalProfile("mad", discard_first=5, chunk_size=20, overlap=10, max_chunks=4)
RAW_DIM = 16
RAW_HEAD = bag.LinearHead(HEAD.weights[:, :RAW_DIM], HEAD.bias)


def formula_encoder():
    """Fixed linear encoder, written the same way in SQL."""
    weights = np.array([[((j * 7 + k * 3) % 11 - 5) / 10 for k in range(RAW_DIM)] for j in range(PROFILE.chunk_size)])
    return lambda batch: batch.astype(np.float64) @ weights


# samples reach the encoder, and vectors leave it, as 32-bit floats
ENCODED_SQL = MAD_SQL + picks_sql(4) + f"""
, encoded AS (SELECT p.read_id, x.source_file, chunk_index, k,
   CAST(sum(CAST(CAST(x AS FLOAT) AS DOUBLE) * (((pos - 5 - 10 * window_index) * 7 + k * 3) % 11 - 5) / 10) AS FLOAT) AS v
   FROM picks p JOIN normal x ON x.read_id = p.read_id AND pos BETWEEN 5 + 10 * window_index AND 24 + 10 * window_index
   CROSS JOIN range({RAW_DIM}) t(k) GROUP BY 1, 2, 3, 4)"""
RAW_SCORES_SQL = ENCODED_SQL + f"""
, pooled AS (SELECT read_id, source_file, k, count(*) AS n_chunks, avg(CAST(v AS DOUBLE)) AS v FROM encoded GROUP BY 1, 2, 3),
logits AS (SELECT read_id, source_file, c, any_value(n_chunks) AS n_chunks, sum(v * ((c * 31 + k * 17) % 13 - 6) / 2) + c / 10 AS z
  FROM pooled CROSS JOIN range(10) t(c) GROUP BY 1, 2, 3),
probs AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY read_id) AS p, row_number() OVER (PARTITION BY read_id ORDER BY z DESC, c) AS r FROM logits)
SELECT read_id, source_file, n_chunks, CAST(c AS INTEGER) AS predicted_label, round(p, 4) AS confidence FROM probs WHERE r = 1"""
LONG_SQL = ENCODED_SQL + " SELECT read_id, source_file, chunk_index, k AS pos, round(CAST(v AS DOUBLE), 4) AS value FROM encoded"


def encoded(spark, d):
    chunks = ch.build_chunks(signals(spark, d), PROFILE)
    return bag.encode_chunks(chunks, formula_encoder, chunk_size=PROFILE.chunk_size)


def embedding_values(rows):
    return rows.select("read_id", "source_file", "chunk_index", F.posexplode("embedding").alias("pos", "value")).select(
        "read_id", "source_file", "chunk_index", F.col("pos").cast("long").alias("pos"),
        F.round(F.col("value").cast("double"), 4).alias("value"),
    )


def read_scores(rows):
    return rows.select(
        "read_id", "source_file", "n_chunks", "predicted_label", F.round("confidence", 4).alias("confidence")
    )


@query("encode_chunks", sql(["samples", "physical"], LONG_SQL))
def _(spark, d):
    return embedding_values(encoded(spark, d))


@query("score_raw", sql(["samples", "physical"], RAW_SCORES_SQL))
def _(spark, d):
    return read_scores(bag.score_bags(encoded(spark, d), RAW_HEAD, CLASSES, dim=RAW_DIM, keys=["read_id", "source_file"]))


@query("mixup_rows", sql(["bags"], f"""
, t AS (SELECT read_id || '-' || CAST(chunk_index AS VARCHAR) AS read_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM bags WHERE split = 'train'),
h AS (SELECT *, row_number() OVER (ORDER BY sha256('42|1|' || read_id), read_id) AS n,
  list_extract(CAST({training.mixing_table(0.4)} AS DOUBLE[]), 1 + CAST(floor(CAST('0x' || substr(sha256('42|lam|1|' || read_id), 1, 8) AS BIGINT) / 4194304) AS BIGINT)) AS lam FROM t),
b AS (SELECT *, (n - 1) // 32 AS batch, struct_pack(r := read_id, l := label, v := vec) AS own FROM h),
p AS (SELECT *, coalesce(lead(own) OVER w, first_value(own) OVER w) AS partner FROM b WINDOW w AS (PARTITION BY batch ORDER BY n)),
m AS (SELECT *, list_transform(list_zip(vec, partner.v), lambda z: lam * z[1] + (1 - lam) * z[2]) AS mix FROM p)
SELECT batch, read_id, partner.r AS partner_id, round(lam, 6) AS lam,
  round(mix[1] / sqrt(list_sum(list_transform(mix, lambda x: x * x))), 5) AS first_value,
  round(list_sum(list_transform(mix, lambda x, i: x * i)) / sqrt(list_sum(list_transform(mix, lambda x: x * x))), 4) AS weighted,
  round(CASE WHEN label = partner.l THEN CAST(1 AS DOUBLE) ELSE lam END, 6) AS own_target, CAST(1 AS DOUBLE) AS target_sum FROM m"""))
def _(spark, d):
    rows = labelled(spark, d).where("split = 'train'")
    mixed = training.mixup_rows(rows, seed=42, epoch=1, alpha=0.4, batch_size=32, n_classes=10)
    weighted = F.aggregate(F.transform("vector", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return mixed.join(rows.select("read_id", "label"), "read_id").select(
        "batch", "read_id", "partner_id", F.round("lam", 6).alias("lam"), F.round(F.col("vector")[0], 5).alias("first_value"),
        F.round(weighted, 4).alias("weighted"), F.round(F.col("target")[F.col("label")], 6).alias("own_target"),
        F.round(sum_of(F.col("target")), 6).alias("target_sum"),
    )


def _estimators(steps: int):
    return {
        "ridge_small": LogisticRegression(maxIter=steps, regParam=0.01, tol=1e-9),
        "ridge_large": LogisticRegression(maxIter=steps, regParam=0.3, tol=1e-9),
    }


@query("train_head")
def _(spark, d):
    rows = labelled(spark, d)
    part = lambda s: rows.where(F.col("split") == s)
    fitted = training.fit_head(part("train"), part("val"), _estimators(15), CLASSES)
    return training.predict(fitted.model, part("test")).select("read_id", "true_label", "predicted_label", "confidence")


@query("train_head_balance", sql(["bags"], """
, t AS (SELECT label FROM bags WHERE split = 'train')
SELECT label, count(*) AS reads, round(count(*) / (SELECT count(*) FROM t), 4) AS mean_probability FROM t GROUP BY label"""))
def _(spark, d):
    """What a fit that ended at its optimum satisfies: the mean probability of a class is the share of its reads."""
    rows = labelled(spark, d)
    part = lambda s: rows.where(F.col("split") == s)
    fitted = training.fit_head(part("train"), part("val"), _estimators(300), CLASSES)
    found = training.class_balance(fitted.model, part("train"), CLASSES)
    return found.where("reads > 0").select("label", "reads", F.round("mean_probability", 4).alias("mean_probability"))


@query("train_kmer")
def _(spark, d):
    rows = kmers.kmer_vectors(sequences(spark, d), 4, relative=True).withColumnRenamed("kmers", "vector")
    rows = rows.withColumn("label", splits.class_position(LANGS, F.col("barcode"))).withColumn(
        "split", F.expr("CASE WHEN CAST(substr(read_id, 2) AS BIGINT) % 5 < 3 THEN 'train' WHEN CAST(substr(read_id, 2) AS BIGINT) % 5 = 3 THEN 'val' ELSE 'test' END")
    )
    part = lambda s: rows.where(F.col("split") == s)
    size = len(kmers.canonical_rank(4)[1])
    estimators = {"mlp": MultilayerPerceptronClassifier(layers=[size, 32, len(LANGS)], maxIter=20, seed=42)}
    fitted = training.fit_head(part("train"), part("val"), estimators, LANGS)
    return training.predict(fitted.model, rows).select("split", "read_id", "true_label", "predicted_label", "confidence", "logits")
