"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all rows to learn from. The regression is trained by follow-the-regularised-leader
steps with an elastic net, one document at a time, on at most PER_LANGUAGE different rows of each language; a fifth of them
is left out and sets the temperature of the probabilities.

Texts that are null or have no letter are `und` with score 0; so is every text if nothing can be learned. Ties go to the
first language in order. Repeated rows score alike; an empty table gives an empty one; only the id, text and language
columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import code_points, gram_hashes, hashed_texts, sampled_texts
from .shared import map_batches, short_batches, texts_of

#: Rows of each language to learn from; bits of a feature; the longest n-gram.
PER_LANGUAGE, BITS, LONGEST = 600, 14, 3


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the lower-cased text, what isn't a letter taken as a space, and their counts."""
    points = code_points(text.lower())
    letters = _is_letter(points)
    counts = np.bincount(gram_hashes(np.where(letters, points, 32).astype(np.uint32), LONGEST, BITS), minlength=1 << BITS)
    which = np.flatnonzero(counts)
    return which.astype(np.int32), counts[which].astype(np.int32)


_letter = np.array([chr(c).isalpha() for c in range(0x3000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Letters by a table; code points beyond it are asked for one by one, each once."""
    out = np.zeros(len(points), bool)
    low = points < len(_letter)
    out[low] = _letter[points[low]]
    if not low.all():
        high, back = np.unique(points[~low], return_inverse=True)
        out[~low] = np.array([chr(c).isalpha() for c in high.tolist()])[back]
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or bool(_is_letter(code_points(text)).any())


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of the column `text`, and in how many of them each feature is; tasks add theirs up before they are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for t in texts_of(batch.column(0)):
                total[features(t)[0]] += 1
                total[-1] += 1
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total[which])], names=["f", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in short_batches(texts).mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return int(out[-1]), out[:-1]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[which]
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def logits(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(which, counts) @ self.weights[which] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        z = self.logits(*features(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, rounds: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """FTRL-proximal: per weight the sum of shifted gradients z and of squared gradients n; l1 makes small weights zero."""
    size, k = 1 << BITS, len(languages)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    model = Model(languages, idf, np.zeros((size, k)), np.zeros(k))
    vectors = [(np.r_[which, size], np.r_[model.vector(which, counts), 1.0], y) for which, counts, y in rows]
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            at, v, y = vectors[i]
            w = weights(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    model.weights, model.bias = w[:-1], w[-1]
    return model


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature with the least log loss on rows left out, on a grid of factors."""
    if not rows:
        return 1.0
    z = np.array([model.logits(a, b) for a, b, _ in rows])
    y = np.array([c for _, _, c in rows])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min((2.0 ** (k / 4) for k in range(-16, 17)), key=loss)


def train_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Learns from all rows of docs whose language isn't null."""
    known = docs.where(F.col(lang_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("y"))
    total, df = document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    hashed = hashed_texts(known, "id", "text", F.col("y"))
    texts = sampled_texts(hashed, hashed, PER_LANGUAGE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["id", "y", "f", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    table = map_batches(texts, run, f"id {kind}, y string, f array<int>, n array<int>").toArrow()
    languages = sorted(set(table["y"].to_pylist()))
    plain = lambda x: np.array(x.as_py() or [], np.int64)
    rows = [(i, plain(f), plain(n), languages.index(y)) for i, y, f, n in zip(table["id"].to_pylist(), table["y"].to_pylist(), table["f"], table["n"], strict=True)]
    rows = [r[1:] for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], len(r[1])))]
    kept = [r for k, r in enumerate(rows) if k % 5]
    model = train(kept, languages, idf)
    model.temperature = calibrate(model, [r for k, r in enumerate(rows) if k % 5 == 0])
    model.weights = model.weights.astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, `lang_pred` and `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_batches(rows, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)
