"""Toxicity: subword-bag embeddings averaged into a linear softmax, embeddings and softmax trained jointly in NumPy.

A word is the bag of its hashed character n-grams; its vector is the mean of their embeddings, a document's vector the mean
of its words' vectors, and a softmax layer on it separates two classes. Misspelt and inflected words that training never saw
share n-grams, and so vectors, with words that it saw.

The model is linear in the embeddings, so for scoring every n-gram is one number (embedding times class difference), a word
is the mean of its n-grams' numbers and a document the mean of its words' numbers: scoring is one pass in Arrow batches
without a shuffle, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import held_out, per_batch, sliced, texts, training_rows
from sigspark.session import cut_lineage

PUNCTUATION = ".,;:!?\"'()[]{}<>*#%&$|_-"


@dataclass(frozen=True)
class SubwordSettings:
    """``per_class`` bounds the labelled documents of each class that the fit sees and ``most_ngrams`` the embeddings; every
    text is scored whole."""

    bits: int = 16
    shortest: int = 3
    longest: int = 5
    dim: int = 4
    per_class: int = 5000
    least_z: float = 4.0
    most_ngrams: int = 4000
    epochs: int = 120
    rate: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class SubwordModel:
    settings: SubwordSettings
    weight: np.ndarray  # one number per n-gram bucket
    bias: float


def ngram_buckets(words: list[str], settings: SubwordSettings) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of every ``<word>`` and the index of the word each belongs to."""
    framed = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    word = np.repeat(np.arange(len(framed)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    buckets, owners = [], []
    hashed = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, settings.longest + 1):
        hashed = hashed[: len(chars) - n + 1] * np.uint64(1000003) + chars[n - 1 :]
        if n >= settings.shortest:
            inside = at[: len(hashed)] + n <= end[: len(hashed)]
            mixed = (hashed[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - settings.bits)).astype(np.int64))
            owners.append(word[: len(hashed)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def words_of(batch: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the word, per occurrence), the distinct words, words per text."""
    found: list[str] = []
    counts = np.zeros(len(batch), dtype=np.int64)
    for i, text in enumerate(batch):
        own = text.lower().split()
        counts[i] = len(own)
        found += own
    codes, distinct = pd.factorize(np.array(found, dtype=object)) if found else (np.zeros(0, int), [])
    return codes, [w.strip(PUNCTUATION) or w for w in distinct], counts


def word_numbers(words: list[str], model: SubwordModel, block: int = 50_000) -> np.ndarray:
    """The mean weight of each word's n-grams."""
    out = np.zeros(len(words))
    for i in range(0, len(words), block):
        part = words[i : i + block]
        bucket, owner = ngram_buckets(part, model.settings)
        total = np.bincount(owner, weights=model.weight[bucket], minlength=len(part))
        out[i : i + block] = total / np.maximum(np.bincount(owner, minlength=len(part)), 1)
    return out


def probability(batch: list[str], model: SubwordModel) -> np.ndarray:
    """Probability of class 1 for each text; a text without words has the model's bias only."""
    codes, distinct, counts = words_of(batch)
    per_word = word_numbers(distinct, model)
    owner = np.repeat(np.arange(len(batch)), counts)
    total = np.bincount(owner, weights=per_word[codes], minlength=len(batch)) if len(codes) else np.zeros(len(batch))
    logit = total / np.maximum(counts, 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def _shares(text: str, settings: SubwordSettings) -> np.ndarray:
    """The share of every bucket in the mean over a text's words."""
    codes, distinct, _ = words_of([text])
    dense = np.zeros(1 << settings.bits)
    if len(codes):
        bucket, owner = ngram_buckets(distinct, settings)
        grams = np.bincount(owner, minlength=len(distinct))
        share = np.bincount(codes, minlength=len(distinct)) / len(codes) / np.maximum(grams, 1)
        dense += np.bincount(bucket, weights=share[owner], minlength=len(dense))
    return dense


def _document_counts(batches: Iterator[pa.RecordBatch], settings: SubwordSettings) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts of each class every bucket occurs."""
    counts = np.zeros((2, 1 << settings.bits), dtype=np.int64)
    for batch in batches:
        for part in sliced(batch):
            for y, text in zip(part.column("y").to_pylist(), texts(part.column("text"))):
                counts[y] += _shares(text, settings) > 0
    some = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "n0", "n1"])


def _bags(batches: Iterator[pa.RecordBatch], chosen: np.ndarray, settings: SubwordSettings) -> Iterator[pa.RecordBatch]:
    """Per text, the places among ``chosen`` of its n-grams and their shares, both as bytes."""
    for batch in batches:
        for part in sliced(batch):
            places, shares = [], []
            for text in texts(part.column("text")):
                share = _shares(text, settings)[chosen]
                some = np.flatnonzero(share)
                places.append(some.astype("<u4").tobytes())
                shares.append(share[some].astype("<f4").tobytes())
            columns = [part.column("y"), pa.array(places, pa.binary()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "places", "shares"])


def train(
    y: np.ndarray, bags: np.ndarray, chosen: np.ndarray, counts: dict[int, int], settings: SubwordSettings
) -> SubwordModel:
    """Joint gradient descent on the embeddings of the ``chosen`` buckets and on the softmax; classes weigh as in the table.

    ``bags`` (texts x buckets) are scaled in place. Without both classes, or without a telling n-gram, the score is a constant: the
    share of class 1.
    """
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    weight = np.zeros(1 << settings.bits)
    if not len(chosen) or len(np.unique(y)) < 2:
        return SubwordModel(settings, weight, float(np.log(prior / (1 - prior))))
    importance = np.array([counts[k] / (y == k).sum() for k in (0, 1)])[y]
    importance = importance / importance.sum()
    # a common scale for rare and frequent n-grams
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", bags, bags, dtype=np.float64) / len(y)) + 1e-9)
    # single precision and in place: the bags are by far the largest thing on the driver
    inputs = np.multiply(bags, scale, out=bags, casting="same_kind")
    rng = np.random.default_rng(settings.seed)
    embedding = np.zeros((len(chosen), settings.dim))
    softmax = rng.normal(0, 1, (settings.dim, 2)) / np.sqrt(settings.dim)
    bias = np.log(np.array([1 - prior, prior]))
    parameters = [embedding, softmax, bias]
    momentum = [np.zeros_like(p) for p in parameters]
    target = np.eye(2)[y]
    for _ in range(settings.epochs):
        pooled = (inputs @ embedding.astype(inputs.dtype)).astype(np.float64)
        scores = pooled @ softmax + bias
        scores -= scores.max(1, keepdims=True)
        probabilities = np.exp(scores)
        probabilities /= probabilities.sum(1, keepdims=True)
        slope = (probabilities - target) * importance[:, None]
        gradients = [inputs.T @ (slope @ softmax.T).astype(inputs.dtype), pooled.T @ slope, slope.sum(0)]
        for parameter, gradient, moving in zip(parameters, gradients, momentum):
            moving *= 0.9
            moving += gradient
            parameter -= settings.rate * moving
    weight[chosen] = embedding @ (softmax[:, 1] - softmax[:, 0]) * scale
    return SubwordModel(settings, weight, float(bias[1] - bias[0]))


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0,
    settings: SubwordSettings = SubwordSettings(),
) -> SubwordModel:
    """Train on a bounded sample of labelled documents whose id does not leave ``remainder``.

    Only n-grams whose document frequencies differ between the classes by ``least_z`` standard errors get an embedding; the
    others would only learn noise. Frequencies are counted where the texts are. The driver gets at most ``most_ngrams``
    frequencies and, per sampled text, as many shares. No labels: a constant model.
    """
    rows, counts = training_rows(documents, labels, label, held_out("doc_id", modulus, remainder), settings.per_class)
    if len(counts) < 2:
        return train(np.zeros(0, int), np.zeros((0, 0)), np.zeros(0, int), counts, settings)
    rows = cut_lineage(rows)
    n0, n1 = (float(min(counts[y], settings.per_class)) for y in (0, 1))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    error = F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    telling = (
        rows.mapInArrow(lambda batches: _document_counts(batches, settings), "bucket long, n0 long, n1 long")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where("n0 + n1 >= 3")
        .withColumn("z", F.abs(F.col("n1") / n1 - F.col("n0") / n0) / error)
        .where(F.col("z") >= settings.least_z)
        .orderBy(F.desc("z"), "bucket")
        .limit(settings.most_ngrams)
        .select("bucket")
    )
    chosen = np.array(sorted(r.bucket for r in telling.collect()), dtype=np.int64)
    # sparse on the way; one order, so that reruns agree
    found = rows.mapInArrow(lambda batches: _bags(batches, chosen, settings), "y int, places binary, shares binary").collect()
    found.sort(key=lambda r: (r.y, bytes(r.places), bytes(r.shares)))
    bags = np.zeros((len(found), len(chosen)), dtype=np.float32)
    for i, r in enumerate(found):
        bags[i, np.frombuffer(r.places, "<u4")] = np.frombuffer(r.shares, "<f4")
    return train(np.array([r.y for r in found], dtype=np.int64), bags, chosen, counts, settings)


def score(documents: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row of ``documents``.

    Null and empty texts have the score of a text without words. Repeated rows are scored each. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probability(texts(batch.column("text")), model)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(per_batch(run), f"doc_id {kind}, score double, predicted int")


def keep_clean(documents: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` scored below ``threshold``, all columns as they were. One pass, no join back."""
    names = documents.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probability(texts(batch.column(names.index("text"))), model)
        return batch.filter(pa.array(p < threshold))

    return documents.mapInArrow(per_batch(run), documents.schema)


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.col("predicted"))
