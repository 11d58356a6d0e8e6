"""Quality classifier: gated-attention multiple-instance learning over the passages of a document."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc_remainder, free_name, map_texts, read_table, text_slices
from .sampling import sample_by_class

#: Words of a passage; bytes of text whose passages are encoded at one time.
PASSAGE, ENCODE_BYTES = 48, 1 << 20
#: Character classes: gap, lower, upper, other letter, digit, mark of a table or markup, stop, other.
CLASSES = 8
#: Buckets of hashed words and of hashed runs of three characters.
WORDS, TRIPLES = 64, 128
#: Their scale beside the other numbers: each of them tells little, and there are many.
LEXICAL = 0.25
#: Numbers that encode a passage.
WIDTH = CLASSES * CLASSES + 2 * CLASSES + WORDS + TRIPLES + 8


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, 7, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c in " \t\n\v\f\r":
            out[i] = 0
        elif c.isalpha():
            out[i] = 1 if c.islower() else 2 if c.isupper() else 3
        elif c.isdigit():
            out[i] = 4
        elif c in "#*$%&|<>=_~^\\{}[]":
            out[i] = 5
        elif c in ".,;:!?":
            out[i] = 6
    return out


def _spread(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % n


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0x94D049BB133111EB) + c


def encode_passages(texts: list[str], all_words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passages by WIDTH, passages of each text). A text is cut into passages of PASSAGE words; one without a word is
    one empty passage. A passage's numbers: shares of each pair of neighbouring character classes, of each class at the
    ends of words, shares of hashed words and of hashed runs of three characters, and how its words repeat. all_words:
    words of the whole texts, where these are pieces of them.
    """
    joined = "\n".join(texts) + "\n"
    cls = _classes()[points := np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    solid = cls > 0
    starts = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
    ends = np.flatnonzero(~solid & np.r_[False, solid[:-1]])
    until = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    words = np.diff(np.r_[0, np.searchsorted(starts, until)])
    passages = np.maximum(-(-words // PASSAGE), 1)
    total, first = int(passages.sum()), np.cumsum(passages) - passages
    out = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return out, passages
    text = np.repeat(np.arange(len(texts)), words)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passage = first[text] + place // PASSAGE
    width = ends - starts
    of_char = np.repeat(passage, width)
    chars = np.flatnonzero(solid)
    n_words = np.bincount(passage, minlength=total).astype(float)
    n_chars = np.bincount(of_char, minlength=total).astype(float)
    pairs = np.bincount(of_char * (CLASSES * CLASSES) + cls[chars].astype(np.int64) * CLASSES + cls[chars + 1], minlength=total * CLASSES * CLASSES)
    out[:, : CLASSES * CLASSES] = pairs.reshape(total, -1) / np.maximum(n_chars, 1)[:, None]
    for i, at in enumerate((starts, ends - 1)):
        share = np.bincount(passage * CLASSES + cls[at], minlength=total * CLASSES).reshape(total, -1)
        out[:, (CLASSES + i) * CLASSES : (CLASSES + i + 1) * CLASSES] = share / np.maximum(n_words, 1)[:, None]
    powers = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    inside = np.arange(len(chars)) - np.repeat(np.cumsum(width) - width, width)
    word = np.add.reduceat((points[chars].astype(np.uint64) + np.uint64(1)) * powers[inside & 63], np.cumsum(width) - width)
    at = 10 * CLASSES
    share = np.bincount(passage * WORDS + _spread(word, WORDS), minlength=total * WORDS).reshape(total, -1)
    out[:, at : at + WORDS] = share / np.maximum(n_words, 1)[:, None]
    inner = chars[cls[chars + 1] > 0]  # a run of three begins here and ends in the word or with the gap behind it
    three = _triple(points[inner], points[inner + 1], points[inner + 2])
    share = np.bincount(of_char[cls[chars + 1] > 0] * TRIPLES + _spread(three, TRIPLES), minlength=total * TRIPLES).reshape(total, -1)
    out[:, at + WORDS : at + WORDS + TRIPLES] = share / np.maximum(n_chars, 1)[:, None]
    order = np.lexsort((word, passage))
    new = np.r_[True, (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    runs = np.diff(np.r_[np.flatnonzero(new), len(order)])
    most = np.zeros(total)
    np.maximum.at(most, passage[order][new], runs)
    distinct = np.bincount(passage[order][new], minlength=total)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    skip = np.zeros(len(word), bool)
    skip[2:] = (word[2:] == word[:-2]) & (passage[2:] == passage[:-2])
    n = np.maximum(n_words, 1)
    extra = [distinct / n, most / n, np.bincount(passage[again], minlength=total) / n, np.bincount(passage[skip], minlength=total) / n]
    mean = n_chars / n
    spread = np.sqrt(np.maximum(np.bincount(passage, width.astype(float) ** 2, total) / n - mean**2, 0))
    extra += [mean / 10, spread / 10, n_words / PASSAGE, np.log1p(words if all_words is None else all_words)[np.repeat(np.arange(len(texts)), passages)] / 10]
    out[:, -8:] = np.stack(extra, axis=1)
    return out, passages


_GAPS = rb"\x20\x09-\x0D"
_NEXT_PASSAGE = re.compile(rb"[%b]*+(?:[^%b]++[%b]++){%d}+" % (_GAPS, _GAPS, _GAPS, PASSAGE))
_WORD = re.compile(rb"([^%b]++)([%b]?)" % (_GAPS, _GAPS))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ENCODE_BYTES that end where a passage does; a passage longer than that is a piece of
    its own. Each byte is looked at once.
    """
    at = end = 0
    while end < len(raw):
        held, m = end, _NEXT_PASSAGE.match(raw, end)
        end = m.end() if m else len(raw)
        if end - held > ENCODE_BYTES and held > at:
            yield raw[at:held]
            at = held
        if end - at >= ENCODE_BYTES:
            yield raw[at:end]
            at = end
    if at < len(raw) or not raw:
        yield raw[at:]


def encode_long_passage(raw: bytes, all_words: int) -> np.ndarray:
    """The numbers of one passage of up to PASSAGE words, as encode_passages() gives them, of words read ENCODE_BYTES at a
    time: a passage with words of any length takes the memory of one such piece.
    """
    pairs, triples = np.zeros(CLASSES * CLASSES), np.zeros(TRIPLES)
    ends, words, widths = np.zeros((2, CLASSES)), [], []
    table, powers = _classes(), np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))

    def take(points: np.ndarray, upto: int) -> None:
        """Counts the runs that begin at the first `upto` points."""
        cls = table[points].astype(np.int64)
        first, second = cls[:upto], cls[1 : upto + 1]
        np.add(pairs, np.bincount(first * CLASSES + second, minlength=len(pairs)), out=pairs)
        three = np.flatnonzero(second > 0)
        np.add(triples, np.bincount(_spread(_triple(points[three], points[three + 1], points[three + 2]), TRIPLES), minlength=TRIPLES), out=triples)

    for m in _WORD.finditer(raw):
        decoder, carry = codecs.getincrementaldecoder("utf-8")("replace"), np.empty(0, np.uint32)
        word = width = 0
        for at in range(m.start(1), m.end(1), ENCODE_BYTES):
            to = min(at + ENCODE_BYTES, m.end(1))
            points = np.frombuffer(decoder.decode(raw[at:to], to == m.end(1)).encode("utf-32-le", "surrogatepass"), np.uint32)
            if not width and len(points):
                ends[0, table[points[0]]] += 1
            word += int(np.sum((points.astype(np.uint64) + np.uint64(1)) * powers[(width + np.arange(len(points))) & 63]))
            width += len(points)
            carry = np.r_[carry, points]
            if len(carry) > 2:
                take(carry, len(carry) - 2)
                carry = carry[-2:]
        ends[1, table[carry[-1]]] += 1
        take(np.r_[carry, np.uint32((m[2] or b"\n")[0]), np.uint32(10)], len(carry))
        words.append(word & 0xFFFFFFFFFFFFFFFF)
        widths.append(width)
    out = np.zeros(WIDTH, np.float32)
    if not words:
        return out
    hashes, width, n, n_chars = np.array(words, np.uint64), np.array(widths, float), len(words), sum(widths)
    out[: CLASSES * CLASSES] = pairs / n_chars
    out[CLASSES * CLASSES : 10 * CLASSES] = ends.ravel() / n
    at = 10 * CLASSES
    out[at : at + WORDS] = np.bincount(_spread(hashes, WORDS), minlength=WORDS) / n
    out[at + WORDS : at + WORDS + TRIPLES] = triples / n_chars
    runs, mean = np.unique(hashes, return_counts=True)[1], n_chars / n
    repeats = [np.count_nonzero(hashes[k:] == hashes[:-k]) / n for k in (1, 2)]
    spread = np.sqrt(max((width**2).sum() / n - mean**2, 0))
    out[-8:] = [len(runs) / n, runs.max() / n, *repeats, mean / 10, spread / 10, n / PASSAGE, np.log1p(all_words) / 10]
    return out


class AttentionModel:
    """h = tanh(x W + b); attention over a document's passages from w . (tanh(h V) * sigmoid(h U)); the logit is linear
    in the attention-weighted mean of h.
    """

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 3) -> None:
        draw = np.random.default_rng(seed).normal
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": draw(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": draw(0, hidden**-0.5, (hidden, gate)), "U": draw(0, hidden**-0.5, (hidden, gate)), "w": draw(0, gate**-0.5, gate), "c": draw(0, hidden**-0.5, hidden), "d": np.zeros(1)}

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        p, starts = self.p, np.cumsum(sizes) - sizes
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "e": e, "a": a, "z": z, "logit": z @ p["c"] + p["d"], "starts": starts}

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x, sizes)["logit"], -30, 30)))

    def score_in_pieces(self, raw: bytes) -> float:
        """A long text's score: attention is summed piece by piece, so that only one piece is encoded at a time."""
        n_words = np.array([sum(1 for _ in _WORD.finditer(raw))])
        top, weight, z = -np.inf, 0.0, np.zeros(len(self.p["c"]))
        for piece in _pieces(raw):
            if len(piece) > 2 * ENCODE_BYTES:
                x, sizes = encode_long_passage(piece, int(n_words[0]))[None], np.ones(1, np.int64)
            else:
                x, sizes = encode_passages([piece.decode("utf-8", "replace")], n_words)
            f = self._forward(x, sizes)
            now = max(top, high := float(f["e"].max()))
            own = np.exp(high - now) / f["a"].max()
            z, weight, top = z * np.exp(top - now) + own * f["z"][0], weight * np.exp(top - now) + own, now
        return float(1 / (1 + np.exp(-np.clip(z / weight @ self.p["c"] + self.p["d"], -30, 30)))[0])

    def attention(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._forward(x, sizes)["a"]

    def _gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self._forward(x, sizes)
        dl = weight * (1 / (1 + np.exp(-f["logit"])) - y) / weight.sum()
        dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), sizes))
        dt, ds = de[:, None] * f["s"] * p["w"] * (1 - f["t"] ** 2), de[:, None] * f["t"] * p["w"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 4) -> AttentionModel:
        """Adam on the weighted log loss of whole documents."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.scale[10 * CLASSES : -8] /= LEXICAL
        starts, draw, step = np.cumsum(sizes) - sizes, np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = draw.permutation(len(sizes))
            for i in range(0, len(order), batch):
                docs, step = order[i : i + batch], step + 1
                n = sizes[docs]
                at = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                for k, g in self._gradients(x[at], n, y[docs], weight[docs]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, most_bytes: int = 1 << 18) -> AttentionModel:
    """A model from about per_class labelled documents of each class, of those with at most most_bytes of text, weighted
    back to the classes' shares. Without any such document each text scores the share of the better class among the
    labels (with one more label of each class: a half if there is none).

    A document with several labels has the least. The sample's keys and labels are at most a few per_class rows, which
    bounds what is broadcast; passages are encoded where the texts are, and only their numbers come to the driver.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("of_key")).agg((F.min(label) > 0).cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    sample = sample_by_class(marked, "of_key", "label", per_class)
    short = docs.where(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) <= most_bytes)
    found = short.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("key") == F.col("of_key")).select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, 2, ENCODE_BYTES):
                x, sizes = encode_passages([(t or b"").decode("utf-8", "replace") for t in as_bytes(piece.column(2))])
                ends = np.cumsum(sizes)
                coded = [x[e - n : e].astype(np.float16).tobytes() for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.string()), piece.column(1), pa.array(coded, pa.binary())], names=["key", "label", "x"])

    rows = found.mapInArrow(run, "key string, label int, x binary").toPandas().sort_values(["key", "x"])
    model = AttentionModel()
    if len(rows) == 0:
        model.p["c"][:] = 0
        model.p["d"][:] = np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
        return model
    parts = [np.frombuffer(r, np.float16).reshape(-1, WIDTH) for r in rows["x"]]
    y = rows["label"].to_numpy()
    drawn = {k: max(int((y == k).sum()), 1) for k in (0, 1)}
    weight = np.array([share[k] / drawn[k] for k in y.tolist()])
    return model.fit(np.concatenate(parts).astype(np.float32), np.array([len(p) for p in parts]), y.astype(float), weight / weight.mean())


def score(docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """(key, score, predicted) of every row, from its whole text alone; with keep, docs' columns and these two. They are
    called as names says, with underscores in front where docs has such a column and keep is set.

    Null and empty texts are one empty passage and get its score; repeated rows stay; an empty table gives an empty one;
    texts are encoded in slices, and a text longer than a slice in pieces of it.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, score double, predicted int"
    others = [c for c in docs.columns if c not in (key, text)] if keep else []
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    if keep:
        schema += "".join(f", c{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(others)) + ", text string"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batch, batch.num_columns - 1, ENCODE_BYTES):
            raw = piece.column(piece.num_columns - 1)
            texts = [t or b"" for t in as_bytes(raw)]
            if len(texts) == 1 and len(texts[0]) > ENCODE_BYTES:
                s = np.array([model.score_in_pieces(texts[0])])
            else:
                s = model.scores(*encode_passages([t.decode("utf-8", "replace") for t in texts]))
            columns = [piece.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            of = ["key", "score", "predicted"]
            if keep:
                columns += [*piece.columns[1:-1], raw]
                of += [*piece.schema.names[1:-1], "text"]
            yield pa.RecordBatch.from_arrays(columns, names=of)

    rows = map_texts(docs.select(F.col(f"`{key}`").alias("key"), *named, F.col(f"`{text}`").alias("text")), run, schema)
    as_named = {key: "key", text: "text"} | {c: f"c{i}" for i, c in enumerate(others)}
    out = [F.col(as_named[c]).alias(c) for c in (docs.columns if keep else [key])]
    return rows.select(*out, *(F.col(c).alias(free_name(docs, n) if keep else n) for c, n in zip(("score", "predicted"), names, strict=True)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0))
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
