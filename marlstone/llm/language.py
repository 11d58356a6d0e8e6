"""Language identification: multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc_remainder, map_texts, read_table, text_slices
from .sampling import sample_by_class

#: Hashed n-gram features, as a power of two; n-grams have one to three characters.
FEATURE_BITS = 15
#: Characters of a text that are turned into n-grams at one time.
PIECE = 1 << 19
UNKNOWN = "und"


@cache
def _folds() -> np.ndarray:
    """Code point to itself if it is a letter, to a space if not."""
    points = np.arange(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letters, points, 32)


def _points(text: str) -> Iterator[np.ndarray]:
    """The folded code points of a text with a space at both ends and one between words, piece by piece."""
    yield np.array([32], np.uint32)
    last, folds = 32, _folds()
    for i in range(0, len(text), PIECE):
        points = folds[np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le"), np.uint32)]
        points = points[(points != 32) | (np.r_[np.uint32(last), points[:-1]] != 32)]
        if len(points):
            last = int(points[-1])
            yield points
    if last != 32:
        yield np.array([32], np.uint32)


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of a whole text, each with 1 + log(count). No letter: no feature."""
    spread = lambda h: ((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - FEATURE_BITS)
    count, before, letters = np.zeros(1 << FEATURE_BITS, np.int64), np.empty(0, np.uint32), False
    for new in _points(raw.decode("utf-8", "replace")) if raw else ():
        letters = letters or bool((new != 32).any())
        points = np.r_[before, new]
        one = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
        k = len(before)  # n-grams that end in the points before are counted already
        grams = np.concatenate([spread(one[k:]), spread(two[max(k - 1, 0) :]), spread(three[max(k - 2, 0) :])])
        count += np.bincount(grams, minlength=1 << FEATURE_BITS)
        before = points[-2:]
    if not letters:
        return np.empty(0, np.int64), np.empty(0)
    at = np.flatnonzero(count)
    return at, 1 + np.log(count[at])


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; sums of all rows, one row for each feature and
    partition before the shuffle. FEATURE_BITS bounds what comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for batch in batches:
            for piece in text_slices(batch, 0):
                for raw in as_bytes(piece.column(0)):
                    seen[features(raw)[0]] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, seen[at]])], names=["feature", "n"])

    rows = docs.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << FEATURE_BITS, np.int64), 0
    for r in rows:
        if r.feature < 0:
            total = r.n
        else:
            out[r.feature] = r.n
    return out, total


class LanguageModel:
    """Weights of each feature and language, already times the feature's idf, with a temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights.astype(np.float32), bias, idf.astype(np.float32), temperature

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return (x / np.sqrt(x @ x)) @ self.weights[at] + self.bias

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        at, tf = features(raw)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, tf) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, one step for each row: (weights, bias). The L1 part keeps a weight at
    zero until its summed gradients pass it; the bias has neither penalty.
    """
    z, n = np.zeros((1 << FEATURE_BITS, n_classes)), np.zeros((1 << FEATURE_BITS, n_classes))
    bias, bias_n = np.zeros(n_classes), np.zeros(n_classes)
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = solve(z[at], n[at])
            error = _softmax(x @ w + bias)
            error[y] -= 1
            g = x[:, None] * error
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / alpha * w
            n[at] = after
            bias_n += error * error
            bias -= alpha / (beta + np.sqrt(bias_n)) * error
    return solve(z, n), bias


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm. A row's own language counts
    (n + 1) / (n + 2) and the rest goes to the others, so that few and clear rows don't end in certainty.
    """
    target = np.full(logits.shape, 1 / (len(y) + 2) / max(logits.shape[1] - 1, 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
    loss = lambda t: -(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_class: int = 600) -> LanguageModel:
    """A model from docs' labelled texts. Document frequencies are of all labelled rows; the weights are fitted on a
    sample of about per_class rows of each language (sample_by_class() bounds all rows together), a fifth of it kept for
    the temperature. From fewer than ten rows none is kept, and the temperature is fitted on the same rows.
    """
    docs = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    seen, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + seen)) + 1

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [features(raw) for raw in as_bytes(batch.column(2))]
        at = pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32()))
        tf = pa.array([t.astype(np.float32) for _, t in rows], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, tf], names=["label", "order", "at", "tf"])

    sample = sample_by_class(docs, key, label, per_class)
    order = F.xxhash64(F.col(key).cast("string"), F.lit(11))
    found = map_texts(sample.select(F.col(label).alias("label"), order.alias("order"), F.col(text).alias("text")), run, "label string, order long, at array<int>, tf array<float>").toPandas()
    found = found[found["at"].map(len) > 0].sort_values(["order", "label"])
    languages = sorted(found["label"].unique())
    if not languages:
        return LanguageModel([], np.zeros((1 << FEATURE_BITS, 0)), np.zeros(0), idf)
    rows = []
    for at, tf, name in zip(found["at"], found["tf"], found["label"], strict=True):
        x = np.asarray(tf, float) * idf[at]
        rows.append((np.asarray(at, np.int64), x / np.sqrt(x @ x), languages.index(name)))
    few = len(rows) < 10
    kept = rows if few else rows[::5]
    weights, bias = fit_ftrl([r for i, r in enumerate(rows) if few or i % 5], len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in kept]).reshape(-1, len(languages))
    return LanguageModel(languages, weights, bias, idf, fit_temperature(logits, np.array([y for *_, y in kept], int)))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text alone. score is the calibrated probability of lang_pred.
    Null texts, and texts without a letter, get `und` and 0; repeated rows stay; an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [model.predict(raw) for raw in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["key", "lang_pred", "score"])

    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(crc_remainder(F.col("doc_id"), 3) != 1))
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
