"""Toxicity severity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc_remainder, map_texts, read_table
from .sampling import sample_by_class

#: Lengths of a word's beginnings that are features beside the word itself.
STEMS = (4, 5)
#: Words that a worker remembers the features of, and the longest of them.
CACHE_WORDS, LONGEST_KEPT = 400_000, 64
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """64-bit numbers of a lower-case word and of its beginnings; a beginning is marked as one."""
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(f.encode()) for f in [word] + [f"{word[:n]}*" for n in STEMS if len(word) >= n]]


def words_of(raw: bytes | None) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower()) if raw else []


class OrdinalModel:
    """P(grade > k) = sigmoid(x . w - theta_k) for ordered thresholds theta, the same weights w for all of them. x marks
    which features a text has. Expected severity is the sum of those probabilities, from 0 to the highest grade.
    """

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def score(self, words: Iterable[str]) -> float:
        known, words = self._known, set(words)
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        found: set[int] = set()
        for w in words:
            if (own := known.get(w)) is None:
                own = tuple(f for f in word_features(w) if f in self.weights)
                if len(w) <= LONGEST_KEPT:
                    known[w] = own
            if own:
                found.update(own)
        return sum(self.weights[f] for f in sorted(found))

    def above(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def ordinal_gradient(x: np.ndarray, row: np.ndarray, column: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """The weighted mean cumulative-link log loss and its gradient. x: weights of features, the first threshold, and the
    logarithms of the gaps between thresholds; (row, column): which feature a row has; y: grades; weight sums to 1.
    """
    n, free = len(y), x[n_features:]
    widths = np.r_[1.0, np.exp(free[1:])]
    theta = np.cumsum(np.r_[free[0], widths[1:]])
    score = np.bincount(row, x[:n_features][column], n)
    p = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30))), np.zeros(n)]  # P(grade >= k)
    above, below = p[np.arange(n), y], p[np.arange(n), y + 1]
    mass = np.maximum(above - below, 1e-9)
    d_above, d_below = weight * above * (1 - above) / mass, weight * below * (1 - below) / mass
    d_theta = np.bincount(y, d_above, len(theta) + 2) - np.bincount(y + 1, d_below, len(theta) + 2)
    d_free = np.cumsum(d_theta[1:-1][::-1])[::-1] * widths
    return -float(weight @ np.log(mass)), np.r_[np.bincount(column, (d_below - d_above)[row], n_features), d_free]


def fit_ordinal(rows: list[tuple[np.ndarray, int]], n_features: int, n_grades: int, weight: np.ndarray | None = None, steps: int = 600, rate: float = 0.05, l1: float = 1e-5, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the weighted mean cumulative-link log likelihood with L1 and L2 penalties, by Adam on all
    rows at once and a proximal step for the L1 part. Thresholds stay ordered: each is the one before plus the
    exponential of a free number.
    """
    y, n = np.array([g for _, g in rows]), len(rows)
    row = np.repeat(np.arange(n), [len(at) for at, _ in rows])
    column = np.concatenate([at for at, _ in rows]) if rows else np.empty(0, int)
    x = np.zeros(n_features + n_grades - 1)
    x[n_features] = 1.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = np.full(n, 1 / max(n, 1)) if weight is None else weight / weight.sum()
    for step in range(1, steps + 1):
        g = ordinal_gradient(x, row, column, y, weight, n_features)[1]
        g[:n_features] += l2 * x[:n_features]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[:n_features] = np.sign(x[:n_features]) * np.maximum(np.abs(x[:n_features]) - rate * l1, 0)
    free = x[n_features:]
    return x[:n_features], np.cumsum(np.r_[free[0], np.exp(free[1:])])


def screen(coded: list[np.ndarray], toxic: np.ndarray, least_z: float = 4.0, least_docs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(features, z): those that more toxic than other documents have, by the z value of the two shares, sorted."""
    found, at = np.unique(np.concatenate(coded), return_inverse=True) if coded else (np.empty(0, np.uint64), np.empty(0, int))
    is_toxic = np.repeat(toxic == 1, [len(c) for c in coded]) if coded else np.empty(0, bool)
    n1, n0 = max(int((toxic == 1).sum()), 1), max(int((toxic == 0).sum()), 1)
    in1, in0 = np.bincount(at[is_toxic], minlength=len(found)), np.bincount(at[~is_toxic], minlength=len(found))
    both = (in1 + in0) / (n1 + n0)
    z = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(both * (1 - both) * (1 / n1 + 1 / n0), 1e-12))
    keep = (z >= least_z) & (in1 + in0 >= least_docs)
    return found[keep], z[keep]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2000, grades: int = 2, most_bytes: int = 1 << 20) -> OrdinalModel:
    """A model from about per_class labelled documents of each grade, of those with at most most_bytes of text, which
    bounds what is broadcast and what comes to the driver: only features of a document, once each.

    label holds grades 0, 1, ... below `grades`; others count as the nearest. With grades = 2, as where documents are
    only marked toxic or not, there is one threshold. Each grade is weighted back to its share of the labels; features
    are screened by grade 0 against all others. A document with several labels has the highest.
    """
    value = F.greatest(F.lit(0), F.least(F.lit(grades - 1), F.col(label).cast("int")))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("of_key")).agg(F.max(value).alias("label"))
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    sample = sample_by_class(marked, "of_key", "label", per_class)
    short = docs.where(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) <= most_bytes)
    found = short.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("key") == F.col("of_key")).select("key", "label", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coded = [np.unique(np.fromiter((f for w in set(words_of(raw)) for f in word_features(w)), np.uint64)).tobytes() for raw in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(coded, pa.binary())], names=["key", "label", "features"])

    rows = map_texts(found, run, "key string, label int, features binary").toPandas().sort_values(["key", "features"])
    y, coded = rows["label"].to_numpy(int), [np.frombuffer(f, np.uint64) for f in rows["features"]]
    if (y == 0).all() or (y > 0).all():
        return OrdinalModel({}, np.full(grades - 1, 40.0 if not len(y) or (y == 0).all() else -40.0))
    features, _ = screen(coded, (y > 0).astype(int))
    in_model = []
    for c, g in zip(coded, y.tolist(), strict=True):
        at = np.minimum(np.searchsorted(features, c), max(len(features) - 1, 0))
        in_model.append((at[features[at] == c] if len(features) else at[:0], g))
    drawn = np.bincount(y, minlength=grades)
    weight = np.array([share[g] / drawn[g] for g in y.tolist()])
    weights, thresholds = fit_ordinal(in_model, len(features), grades, weight)
    return OrdinalModel({int(f): float(w) for f, w in zip(features, weights, strict=True) if w}, thresholds)


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_severity, severity, toxic) of every row, from its whole text alone: the expected grade, the most
    likely one, and whether a grade over 0 is likelier than not. Null and empty texts have no feature; repeated rows
    stay; an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        above = np.array([model.above(model.score(words_of(raw))) for raw in as_bytes(batch.column(1))]).reshape(-1, len(model.thresholds))
        mass = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
        columns = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "expected_severity", "severity", "toxic"])

    rows = map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, expected_severity double, severity int, toxic boolean")
    return rows.withColumnRenamed("key", key)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0))
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    return severity(docs, model).select("doc_id", held_out.alias("held_out"), "expected_severity", "severity", "toxic")
