"""Line quality by a linear-chain conditional random field, document quality by length-weighted marginals.

Every line of a text is one position of a chain with the states bad and good. A position sees features of its own line and
of the lines before and after it; a transition matrix lets good and bad stretches persist. Forward-backward gives each line
its marginal of being good, and the document is the mean of these weighted by line length, mapped to a probability by a
logistic curve fitted on the training documents.

Only documents carry labels. The field is first fitted with every line labelled as its document, then the lines of bad
documents that look good under the fit are relabelled (the worst line stays bad), and the field is fitted again.

Features of all lines of an Arrow batch are sums over byte classes, so the work per byte is a few NumPy passes; the chains of
a batch advance together, the longest first, so a very long document costs as many steps as it has lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import held_out, per_batch, texts, training_rows

# byte classes: lower case, upper case, digits, blanks, sentence marks, loud marks, other signs, bytes above ASCII
CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[128:] = 7
OWN = CLASSES + 5
WIDTH = 3 * OWN + 3


@dataclass(frozen=True)
class CrfSettings:
    """``per_class`` bounds the labelled documents of each class that the fit sees; every text is scored whole."""

    per_class: int = 1500
    steps: int = 80
    rate: float = 0.05
    penalty: float = 1e-3
    rounds: int = 2


@dataclass(frozen=True)
class CrfModel:
    mean: np.ndarray
    spread: np.ndarray
    emission: np.ndarray  # log-odds of good per feature, the last one is the constant
    transition: np.ndarray  # 2 x 2 log potentials
    slope: float
    offset: float


def line_features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes per line, lines per text). The empty text has one empty line."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in batch]
    lines = np.array([e.count(b"\n") + 1 for e in encoded], dtype=np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)
    kind = _CLASS[data]
    kind[ends] = 3
    share = np.empty((len(ends), OWN))
    for k in range(CLASSES):
        share[:, k] = np.add.reduceat((kind == k).astype(np.int32), starts) if len(data) else 0
    share[:, 3] -= 1  # the line end itself
    share[:, :CLASSES] /= np.maximum(length, 1)[:, None]
    # words: runs of anything but blanks, each with a hash of its bytes
    solid = kind != 3
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    last = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    line_of = np.searchsorted(ends, first)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    share[:, CLASSES] = np.log1p(length)
    share[:, CLASSES + 1] = length / np.maximum(words, 1) / 10
    share[:, CLASSES + 2 :] = 0
    if len(first):
        # bytes weighted by their place in the word; sums of a word are differences of running sums
        heads = first if first[0] == 0 else np.concatenate([[0], first])
        head = np.repeat(heads, np.diff(np.append(heads, len(data))))
        place = np.arange(len(data), dtype=np.uint64) - head.astype(np.uint64)
        mixed = (data.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        word = running[last] - running[first]
        for back in (1, 2):
            same = np.zeros(len(word))
            same[back:] = (word[back:] == word[:-back]) & (line_of[back:] == line_of[:-back])
            share[:, CLASSES + 1 + back] = np.bincount(line_of, weights=same, minlength=len(ends)) / np.maximum(words, 1)
        # a line that occurred before in its text; ties by hash of the line's words
        text_of = np.repeat(np.arange(len(batch)), lines)
        offsets = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
        order = np.arange(len(word)) - offsets[line_of]
        rotated = word * (order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(rotated, dtype=np.uint64)])
        line_hash = total[offsets[1:]] - total[offsets[:-1]]
        sort = np.lexsort((np.arange(len(ends)), line_hash, text_of))
        again = np.zeros(len(ends), dtype=bool)
        again[sort[1:]] = (line_hash[sort[1:]] == line_hash[sort[:-1]]) & (text_of[sort[1:]] == text_of[sort[:-1]])
        share[:, CLASSES + 4] = again & (words > 2)
    return share, length, lines


def chain_inputs(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features; lines beyond the text count as zeros, marked by two more columns."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    last = np.cumsum(lines) - 1
    out = np.zeros((len(own), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[last, 2 * OWN : 3 * OWN] = 0
    out[first, 3 * OWN] = 1
    out[last, 3 * OWN + 1] = 1
    out[:, -1] = 1
    return out


def forward_backward(odds: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected transition counts (2 x 2) and the log normaliser of all chains together.

    ``odds`` holds the potential of good at every line, bad being 0. Chains advance together; step t works on the chains
    longer than t.
    """
    order = np.argsort(-lines, kind="stable")
    sizes = lines[order]
    first = (np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64))[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left") if len(sizes) else np.zeros(0, int)
    shift = np.maximum(odds, 0)
    local = np.stack([np.exp(-shift), np.exp(odds - shift)], 1)
    move = np.exp(transition)
    alpha = np.empty_like(local)
    scale = np.empty(len(odds))
    for t in range(len(alive)):
        at = first[: alive[t]] + t
        now = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        scale[at] = now.sum(1)
        alpha[at] = now / scale[at][:, None]
    beta = np.ones_like(local)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ move.T
        pairs += (alpha[at].T @ ahead) * move
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, float(np.log(scale).sum() + shift.sum())


def _fit_field(
    inputs: np.ndarray, lines: np.ndarray, good: np.ndarray, weight: np.ndarray, settings: CrfSettings
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the line labels by Adam; ``weight`` is per line (that of its document)."""
    emission, transition = np.zeros(inputs.shape[1]), np.zeros((2, 2))
    ends = np.cumsum(lines) - 1
    inner = np.ones(len(good), dtype=bool)
    inner[ends] = False
    step_of = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[step_of], good[step_of + 1]), 1.0)
    parameters = [emission, transition]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, settings.steps + 1):
        marginal, pairs, _ = forward_backward(inputs @ emission, transition, lines)
        gradients = [
            inputs.T @ ((marginal - good) * weight) / weight.sum() + settings.penalty * emission,
            (pairs - seen) / len(good) + settings.penalty * transition,
        ]
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= settings.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return emission, transition


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _weighted(marginal: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(lines)), lines)
    weight = length + 1
    return np.bincount(owner, marginal * weight, len(lines)) / np.bincount(owner, weight, len(lines))


def train(own: np.ndarray, length: np.ndarray, lines: np.ndarray, y: np.ndarray, counts: dict[int, int],
          settings: CrfSettings) -> CrfModel:
    """Fit on documents with class ``y``; without both classes the score is a constant, the share of class 1."""
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if len(np.unique(y)) < 2:
        return CrfModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(_logit(np.array(prior))))
    inputs = chain_inputs(own, lines)
    mean, spread = inputs.mean(0), inputs.std(0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    inputs = (inputs - mean) / spread
    owner = np.repeat(np.arange(len(lines)), lines)
    weight = (1 / lines)[owner]  # every document weighs the same
    good = y[owner].astype(np.int64)
    for turn in range(settings.rounds):
        emission, transition = _fit_field(inputs, lines, good, weight, settings)
        marginal, _, _ = forward_backward(inputs @ emission, transition, lines)
        if turn + 1 < settings.rounds:
            worst = np.full(len(lines), np.inf)
            np.minimum.at(worst, owner, marginal)
            bad = (y[owner] == 0) & ((marginal < 0.5) | (marginal <= worst[owner]))
            good = np.where(bad, 0, 1)
    x = _logit(_weighted(marginal, length, lines))
    importance = np.array([counts[k] / (y == k).sum() for k in (0, 1)])[y]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, slightly ridged
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        r = importance * (p - y)
        h = importance * p * (1 - p)
        g = np.array([(r * x).sum() + 1e-2 * slope, r.sum()])
        hessian = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return CrfModel(mean, spread, emission, transition, float(slope), float(offset))


def line_marginals(batch: list[str], model: CrfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability that a line is good, bytes per line, lines per text)."""
    own, length, lines = line_features(batch)
    inputs = (chain_inputs(own, lines) - model.mean) / model.spread
    marginal, _, _ = forward_backward(inputs @ model.emission, model.transition, lines)
    return marginal, length, lines


def document_scores(batch: list[str], model: CrfModel) -> np.ndarray:
    marginal, length, lines = line_marginals(batch, model)
    x = model.slope * _logit(_weighted(marginal, length, lines)) + model.offset
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in texts(batch.column("text")):
        own, length, _ = line_features([text])
        rows.append(np.column_stack([own, length]).astype(np.float32).tobytes())
    return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.binary())], ["y", "lines"])


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2,
    settings: CrfSettings = CrfSettings(),
) -> CrfModel:
    """Train on a bounded sample of labelled documents whose id does not leave ``remainder``.

    Features are computed where the texts are; the driver gets the line features of at most ``per_class`` documents a class.
    """
    rows, counts = training_rows(documents, labels, label, held_out("doc_id", modulus, remainder), settings.per_class)
    found = sorted((r.y, bytes(r.lines)) for r in rows.mapInArrow(per_batch(_pack), "y int, lines binary").collect())
    matrices = [np.frombuffer(b, np.float32).reshape(-1, OWN + 1).astype(np.float64) for _, b in found]
    lines = np.array([len(m) for m in matrices], dtype=np.int64)
    stacked = np.concatenate(matrices) if matrices else np.zeros((0, OWN + 1))
    return train(stacked[:, :OWN], stacked[:, OWN], lines, np.array([y for y, _ in found], dtype=np.int64), counts, settings)


def score(documents: DataFrame, model: CrfModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, n_lines, n_bad_lines for every row of ``documents``.

    Null and empty texts are one empty line. Repeated rows are scored each. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marginal, length, lines = line_marginals(texts(batch.column("text")), model)
        x = model.slope * _logit(_weighted(marginal, length, lines)) + model.offset
        p = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        bad = np.bincount(np.repeat(np.arange(len(lines)), lines), marginal < 0.5, len(lines)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(lines), pa.array(bad)],
            ["doc_id", "score", "predicted", "n_lines", "n_bad_lines"],
        )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        per_batch(run), f"doc_id {kind}, score double, predicted int, n_lines long, n_bad_lines long"
    )


def quality_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(documents, fit(documents, labels))
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", F.col("n_lines"), F.col("n_bad_lines")
    )
