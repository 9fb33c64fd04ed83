"""Quality classifier: naive-Bayes support vectors.

Indicators of hashed character n-grams (and of the share of repeated word triples, in tenths) are scaled by the logarithm
of the ratio of their smoothed frequencies in the classes; on them a linear hinge-loss model is fitted by dual coordinate
descent; its margins become probabilities by a logistic curve fitted on margins of rows left out, under the real shares
of the classes. It learns from at most PER_CLASS different labelled rows of each class, however many rows an id has; every
row is scored.

Null and empty texts have no indicators and get the score of the model's intercept. Without labels of both classes the
score is the share of label 1, or one half. Repeated rows score alike; an empty table gives an empty one; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import code_points, gram_hashes, hashed_texts, sampled_texts
from .shared import map_batches, texts_of

#: Labelled rows of each class to learn from; bits of a feature; the longest n-gram.
PER_CLASS, BITS, LONGEST = 1500, 16, 3


def indicators(text: str) -> np.ndarray:
    """The sorted features that the text has."""
    flags = np.zeros((1 << BITS) + 16, bool)
    flags[gram_hashes(code_points(text), LONGEST, BITS)] = True
    words = text.split()
    if len(words) > 2:
        triples = list(zip(words, words[1:], words[2:], strict=False))
        flags[(1 << BITS) + int(10 * (1 - len(set(triples)) / len(triples)))] = True
    return np.flatnonzero(flags).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    size = (1 << BITS) + 16
    counts = [1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c] or [np.empty(0, np.int64)]), minlength=size) for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, c: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + c * sum of hinge losses, with a constant feature for the intercept."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    y = np.where(labels == 1, 1.0, -1.0)
    norms = [float(v @ v) + 1.0 for v in values]
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class Model:
    """Scores texts: the ratios times the weights, the intercept, and the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weights[r].sum() / np.sqrt(max(1, len(r))) + self.bias for r in rows])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """`share`: that of label 1 among all labelled rows."""
    size = (1 << BITS) + 16
    if len(set(labels.tolist())) < 2:
        p = min(0.99, max(0.01, share))
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))

    def train(use: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in use]
        ratios = log_count_ratios(some, labels[use])
        w, b = dual_coordinate_descent(some, [ratios[r] / np.sqrt(max(1, len(r))) for r in some], labels[use], size)
        return w * ratios, b

    out = np.arange(len(rows)) % 4 == 3
    w, b = train(np.flatnonzero(~out))
    margin = np.array([w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in np.flatnonzero(out)])
    y = labels[out].astype(float)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps on the weighted logistic loss, with a weak pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([(weight * (p - y) * margin).sum() + 1e-3 * (slope - 1), (weight * (p - y)).sum()])
        q = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = max(1e-3, slope - step[0]), shift - step[1]
    w, b = train(np.arange(len(rows)))
    return Model(w, b, slope, shift)


def train_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> Model:
    """Learns from the different texts of the labelled ids; null ids and labels teach nothing, an id with both is of both."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    hashed = hashed_texts(docs, id_column, text_column)
    texts = sampled_texts(hashed, hashed.select("id", "th").join(known.distinct(), "id"), PER_CLASS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.array([indicators(t) for t in texts_of(batch.column(2))], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["id", "y", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    table = map_batches(texts, run, f"id {kind}, y int, x array<int>").toArrow()
    rows = sorted(zip(table["id"].to_pylist(), table["y"].to_pylist(), (x.values.to_numpy() if x.values is not None else np.empty(0, np.int32) for x in table["x"]), strict=True), key=lambda r: (r[0], r[1], len(r[2])))
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), share)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id and `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.score([indicators(t) for t in texts_of(batch.column(1))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_batches(rows, run, f"id {kind}, score double").withColumnRenamed("id", id_column)
