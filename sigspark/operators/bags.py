"""Pooling the chunk embeddings of a read, encoding chunks and scoring reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.functions.arrays import argmax, cosine, dot, l2_normalize, let, softmax, sum_of
from sigspark.operators.metrics import class_name


def encode_chunks(
    chunks: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], *, chunk_size: int,
    batch_size: int = 64,
) -> DataFrame:
    """Replace ``chunk`` by ``embedding`` with a user encoder that is built once per Python worker.

    The encoder maps a (batch, samples) matrix to (batch, dim), or to (batch, time, dim), which is averaged over time.
    """

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        encoder = make_encoder()

        def predict(batch: np.ndarray) -> np.ndarray:
            out = np.asarray(encoder(batch), dtype=np.float32)
            return out.mean(axis=1) if out.ndim == 3 else out

        return predict

    encode = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[chunk_size]],
    )
    return chunks.withColumn("embedding", encode(F.col("chunk").cast("array<float>"))).drop("chunk")


def random_projection(chunk_size: int, dim: int, seed: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Weight-free stand-in for an encoder: a fixed random projection."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        weights = np.random.default_rng(seed).standard_normal((chunk_size, dim)) / np.sqrt(chunk_size)
        return lambda batch: batch @ weights

    return make


def _sum_by_key(
    batches: Iterator[pa.RecordBatch],
    keys: Sequence[str],
    load: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch and key the sums of (count, weight, vector).

    The key of the last row is held back and joined with the next batch, so a run of equal keys gives one row however many
    batches it spans; sorted input therefore gives every key once.
    """
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k) for k in keys]
        n, weight, vectors = load(batch)
        if held is not None:
            columns = [pa.concat_arrays([h, c]) for h, c in zip(held[0], columns)]
            n, weight, vectors = (np.concatenate([h, v]) for h, v in zip(held[1:], (n, weight, vectors)))
        ids = pa.RecordBatch.from_arrays(columns, names=list(keys)).to_pandas()
        group = ids.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        # the held key comes last
        group = np.where(group == group[-1], len(group), group)
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        first = pa.array(order[start])
        columns = [c.take(first) for c in columns]
        n, weight, vectors = (np.add.reduceat(v[order], start, axis=0) for v in (n, weight, vectors))
        held = ([c[-1:] for c in columns], n[-1:], weight[-1:], vectors[-1:])
        if len(start) > 1:
            yield [c[:-1] for c in columns], n[:-1], weight[:-1], vectors[:-1]
    if held is not None:
        yield held


def _matrix(column: pa.ListArray, rows: int, dim: int) -> np.ndarray:
    """The vectors as rows; one that is null, of another length or with a null component is an error, never a shift."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(lengths != dim)
    if len(wrong):
        raise ValueError(f"{len(wrong)} of {rows} vectors do not have {dim} components, the first at row {wrong[0]} of its batch")
    if column.flatten().null_count:
        raise ValueError(f"vectors of {dim} components hold nulls")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, dim).astype(np.float64)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def _pool(
    rows: DataFrame, keys: Sequence[str], dim: int, value: str, weigh: Callable[[np.ndarray], np.ndarray] | None
) -> DataFrame:
    """(keys, n_chunks, vector) with the weighted mean vector of every key.

    Batches are summed as matrices before the shuffle and the partial sums after it, so a hot key costs no more than any
    other and no row is multiplied by the dimension.
    """
    keys = list(keys)
    types = dict(rows.dtypes)
    key_schema = "".join(f"`{k}` {types[k]}, " for k in keys)

    def chunks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = _matrix(batch.column(value), batch.num_rows, dim)
        weight = np.ones(batch.num_rows) if weigh is None else weigh(vectors)
        return np.ones(batch.num_rows, dtype=np.int64), weight, vectors * weight[:, None]

    def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, weight = (batch.column(c).to_numpy() for c in ("n", "weight"))
        return n, weight, _matrix(batch.column("sums"), batch.num_rows, dim)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "n", "weight", "sums"]
        for columns, n, weight, vectors in _sum_by_key(batches, keys, chunks):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(weight), _lists(vectors)], names=names)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "n_chunks", "vector"]
        for columns, n, weight, vectors in _sum_by_key(batches, keys, sums):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), _lists(vectors / weight[:, None])], names=names)

    partial = rows.select(*keys, value).mapInArrow(before, f"{key_schema}n long, weight double, sums array<double>")
    sorted_ = partial.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(after, f"{key_schema}n_chunks long, vector array<double>")


def pool_mean(rows: DataFrame, keys: Sequence[str], dim: int, value: str = "embedding") -> DataFrame:
    """Mean vector and row count per key."""
    return _pool(rows, keys, dim, value, None)


@dataclass(frozen=True)
class AttentionParams:
    """Gated attention: score = w . (tanh(V h + v0) * sigmoid(U h + u0)) + w0."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    v0: np.ndarray | float = 0.0
    u0: np.ndarray | float = 0.0
    w0: float = 0.0

    @property
    def bound(self) -> float:
        """No score exceeds this, because each gate lies in (-1, 1)."""
        return float(np.abs(self.w).sum() + abs(self.w0))


def pool_attention(rows: DataFrame, params: AttentionParams, keys: Sequence[str], value: str = "embedding") -> DataFrame:
    """Softmax-weighted mean of the chunk vectors of each key, scaled to unit length.

    The scores are bounded by the weights, so the softmax needs no per-bag maximum and becomes a ratio of two sums that
    are combined on the map side; a bag is never gathered in one place.
    """
    if params.bound > 300:
        raise ValueError("attention weights are too large for a softmax without a per-bag maximum")
    dim = params.v.shape[1]

    def weigh(h: np.ndarray) -> np.ndarray:
        gate = np.tanh(h @ params.v.T + params.v0) / (1 + np.exp(-(h @ params.u.T + params.u0)))
        return np.exp(gate @ params.w + params.w0 - params.bound)

    pooled = _pool(rows, keys, dim, value, weigh)
    return pooled.withColumn("vector", l2_normalize(F.col("vector")))


@dataclass(frozen=True)
class LinearHead:
    """Class scores = weights @ vector + bias; ``normalize`` scales the vector to unit length first."""

    weights: np.ndarray
    bias: np.ndarray
    normalize: bool = False

    def logits(self, vector: Column) -> Column:
        weights, bias, unit = self.weights, self.bias, self.normalize

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if batch.empty:
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(batch.to_numpy()).astype(np.float64)
                if unit:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(x @ weights.T + bias))

        return score(vector)


def classify(rows: DataFrame, classes: Sequence[str], logits: str = "logits") -> DataFrame:
    """Softmax, label (lowest on ties), confidence and class name from a logits column."""
    return (
        rows.withColumn("probabilities", softmax(F.col(logits)))
        .withColumn("predicted_label", argmax(F.col("probabilities")))
        .withColumn("confidence", F.array_max("probabilities"))
        .withColumn("predicted_species", class_name(F.col("predicted_label"), classes))
        .drop(logits)
    )


def score_vectors(pooled: DataFrame, head: LinearHead, classes: Sequence[str]) -> DataFrame:
    return classify(pooled.withColumn("logits", head.logits(F.col("vector"))).drop("vector"), classes)


def score_bags(
    chunks: DataFrame, head: LinearHead, classes: Sequence[str], *, dim: int, keys: Sequence[str] = ("read_id",),
    attention: AttentionParams | None = None,
) -> DataFrame:
    """Pool the chunk embeddings of every read and classify it."""
    pooled = pool_attention(chunks, attention, keys) if attention else pool_mean(chunks, keys, dim)
    return score_vectors(pooled, head, classes)


def fit_centroids(train: DataFrame, classes: Sequence[str], dim: int) -> LinearHead:
    """Nearest-centroid head (cosine) from pooled training vectors; classes x dim numbers go to the driver."""
    means = pool_mean(train, ["label"], dim, value="vector").where(F.col("label").between(0, len(classes) - 1)).collect()
    weights = np.zeros((len(classes), dim))
    for row in means:
        centre = np.asarray(row.vector)
        weights[row.label] = centre / max(np.linalg.norm(centre), 1e-12)
    return LinearHead(weights, np.zeros(len(classes)), normalize=True)


def embedding_agreement(
    current: DataFrame, stored: DataFrame, *, minimum: float = 0.999
) -> tuple[DataFrame, DataFrame]:
    """Cosine and largest absolute difference of two embedding sets: per read, and one summary row."""
    pairs = current.select("read_id", "chunk_index", F.col("embedding").alias("a")).join(
        stored.select("read_id", "chunk_index", F.col("embedding").alias("b")), ["read_id", "chunk_index"]
    )
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    pairs = pairs.select("read_id", cosine(F.col("a"), F.col("b")).alias("cosine"), gap.alias("gap"))
    details = pairs.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("cosine").alias("minimum_cosine"),
        F.sum("cosine").alias("cosine_sum"),
        F.max("gap").alias("max_abs_error"),
    )
    summary = details.agg(
        F.sum("n_chunks").alias("n_chunks"),
        F.min("minimum_cosine").alias("minimum_cosine"),
        (F.sum("cosine_sum") / F.sum("n_chunks")).alias("mean_cosine"),
        F.max("max_abs_error").alias("maximum_abs_error"),
    ).withColumn("status", F.when(F.col("minimum_cosine") >= minimum, "pass").otherwise("fail"))
    details = details.withColumn("mean_cosine", F.col("cosine_sum") / F.col("n_chunks")).drop("cosine_sum")
    return details, summary


def first_read_per_class(chunks: DataFrame, n_chunks: int, order: Sequence[str]) -> DataFrame:
    """The first ``n_chunks`` chunks of the first read, in the given order, of every class."""
    first = chunks.groupBy("label").agg(F.min(F.struct(*order, "read_id"))["read_id"].alias("read_id"))
    return chunks.join(first, ["label", "read_id"], "left_semi").where(F.col("chunk_index") < n_chunks)


def distill_terms(
    rows: DataFrame, *, temperature: float, label_smoothing: float, n_classes: int
) -> DataFrame:
    """Mean cross entropy, temperature-scaled KL divergence and cosine misalignment of student against teacher."""
    def log_softmax(x: Column) -> Column:
        total = lambda m: F.log(sum_of(F.transform(x, lambda v: F.exp(v - m)))) + m
        return let(let(F.array_max(x), total), lambda z: F.transform(x, lambda v: v - z))

    tempered = lambda c: F.transform(c, lambda v: v.cast("double") / temperature)
    terms = rows.withColumns(
        {
            "_log": log_softmax(F.col("student_logits")),
            "_s": log_softmax(tempered("student_logits")),
            "_t": log_softmax(tempered("teacher_logits")),
        }
    ).select(
        (
            -(1 - label_smoothing) * F.get("_log", F.col("label"))
            - F.lit(label_smoothing / n_classes) * sum_of(F.col("_log"))
        ).alias("ce"),
        (dot(F.transform("_t", F.exp), F.zip_with("_t", "_s", lambda t, s: t - s)) * temperature**2).alias("kd"),
        (1 - cosine(F.col("student_embedding"), F.col("teacher_embedding"))).alias("alignment"),
    )
    return terms.agg(
        F.count(F.lit(1)).alias("n"), F.avg("ce").alias("ce"), F.avg("kd").alias("kd"), F.avg("alignment").alias("alignment")
    )


def teacher_join(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    """Training rows with the teacher's outputs; a read the teacher has not seen is an error at run time."""
    message = F.concat(F.lit("teacher has no output for read "), F.col("read_id"))
    bank = teacher.select("read_id", "logits", F.col("embedding").alias("teacher_embedding"))
    joined = rows.join(bank, "read_id", "left")
    return joined.withColumn(
        "logits", F.when(F.col("logits").isNull(), F.raise_error(message).cast("array<double>")).otherwise(F.col("logits"))
    )
