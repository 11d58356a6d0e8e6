"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit-distance check.

The CGK walk reads a sequence of words and at each step emits the word under its pointer, then moves on or stays by a
random bit of (step, word). Two sequences with few edits re-join after each edit, so their emitted rows differ in few
places: edit distance becomes Hamming distance. Sampling a few places of that row gives a hash key that near sequences
share with good chance; repeated with other bits and places, it reaches the target recall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import as_bytes, map_texts, read_table

#: Words of benchmark items that are sent to the executors at one time; larger benchmarks go in blocks.
BLOCK_WORDS = 500_000
#: Most repeats of the embedding; trials of the recall of each number of edits, and of all together.
MOST_REPEATS, TRIALS, ALL_TRIALS = 64, 300, 6_000
_WORD = re.compile(r"[^\W_]+")


def words_of(raw: bytes | None) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower()) if raw else []


class ItemIndex:
    """Benchmark items with their seeds and LSH keys. An item of n words allows floor((1 - similarity) * n) edits.

    Where an item stands in a text with that many edits, a run of ceil((n - edits) / (edits + 1)) words stands there
    unchanged; so only windows around such a run (of at most four words) are embedded, and none is lost by that.

    Repeats are set for each number of edits on its own, until items edited as much as is allowed reach the recall; where
    MOST_REPEATS do not, every window around a run goes to the edit check.
    """

    def __init__(self, items: list[tuple[object, list[str]]], similarity: float = 0.8, recall: float = 0.99, sampled: int = 2, seed: int = 9) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in self.items]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.sampled, self.draw = sampled, np.random.default_rng(seed)
        runs = np.minimum(-(-(self.sizes - self.edits) // (self.edits + 1)), 4)
        self.seeds = {}
        for q in sorted(set(runs.tolist())):
            grams = [(self._gram(self.words[i], q), i) for i in np.flatnonzero(runs == q)]
            key = np.concatenate([g for g, _ in grams])
            item = np.concatenate([np.full(len(g), i) for g, i in grams])
            place = np.concatenate([np.arange(len(g)) for g, _ in grams])
            order = np.argsort(key, kind="stable")
            self.seeds[q] = key[order], item[order], place[order]
        self.repeats: dict[int, int] = {}  # by item size; 0: no embedding, every window is checked
        if self.items:
            self.multipliers = self.draw.integers(1, 1 << 32, (MOST_REPEATS, 2 * int(self.sizes.max()) + 2), np.uint64) | np.uint64(1)
            self.places = np.sort(self.draw.random((MOST_REPEATS, sampled)), axis=1)
            self._calibrate(recall)
            self.keys = {int(n): self._item_keys(int(n)) for n in np.unique(self.sizes) if self.repeats[int(n)]}

    @staticmethod
    def _gram(ids: np.ndarray, q: int) -> np.ndarray:
        """Number of each run of q words; 0 where one is not a benchmark word."""
        n = max(len(ids) - q + 1, 0)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(q):
            out = (out + ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            known &= ids[j : j + n] > 0
        return np.where(known, out ^ (out >> np.uint64(29)), np.uint64(0))

    def embed(self, windows: np.ndarray, repeats: int) -> np.ndarray:
        """(repeats, windows): LSH keys of windows (a matrix of word numbers of one size): the words that each walk emits
        at its sampled steps. The steps lie in the first 1.6 n of a walk, which reads a window in about 2 n.
        """
        count, n = windows.shape
        padded = np.c_[windows, np.zeros(count, windows.dtype)].ravel().astype(np.uint64)
        base = np.arange(count, dtype=np.int64) * (n + 1)
        at = np.zeros((repeats, count), np.int64)
        steps = (self.places[:repeats] * 1.6 * n).astype(np.int64)
        keys = np.zeros((repeats, count), np.uint64)
        for j in range(int(steps.max()) + 1):
            word = padded[base + at]
            taken = (steps == j).sum(axis=1)
            for _ in range(int(taken.max())):
                rows = taken > 0
                keys[rows] = (keys[rows] + word[rows] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
                keys[rows] ^= keys[rows] >> np.uint64(31)
                taken = taken - rows
            move = (((word + np.uint64(1)) * self.multipliers[:repeats, j][:, None]) >> np.uint64(31)) & np.uint64(1)
            at = np.minimum(at + move.astype(np.int64), n)
        return keys

    def _edited(self, item: int) -> np.ndarray:
        """The item with as many random edits as it allows, between words of no item."""
        out = self.words[item].tolist()
        for _ in range(int(self.edits[item])):
            at, kind = int(self.draw.integers(len(out))), int(self.draw.integers(3))
            out[at : at + (kind != 1)] = [] if kind == 0 and len(out) > 1 else [int(self.draw.integers(1, len(self.vocabulary) + 1))]
        n = int(self.sizes[item])
        return np.array([0] * n + out + [0] * n, np.int32)

    def _calibrate(self, recall: float) -> None:
        """The repeats of each number of edits: the fewest with which at least the recall of edited items share a key
        with a window that candidates() looks at.
        """
        classes = np.unique(self.edits).tolist()
        for k in classes:
            items = np.flatnonzero(self.edits == k)
            met = []
            for i in self.draw.choice(items, max(20, min(TRIALS, ALL_TRIALS // len(classes)))).tolist() if k else ():
                ids, n = self._edited(i), int(self.sizes[i])
                first = [f for _, f, j in self._seeded(ids, np.array([0]), np.array([len(ids)]))[n].tolist() if j == i]
                windows = np.stack([self.words[i], *(self._window(ids, f, n, 0, len(ids)) for f in sorted(set(first)))])
                keys = self.embed(windows, MOST_REPEATS)
                met.append((keys[:, :1] == keys[:, 1:]).any(axis=1))
            share = np.maximum.accumulate(np.array(met), axis=1).mean(axis=0) if met else np.ones(1)
            enough = np.flatnonzero(share >= recall)
            for n in np.unique(self.sizes[items]).tolist():
                self.repeats[n] = int(enough[0]) + 1 if len(enough) else 0

    def _item_keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        items, r = np.flatnonzero(self.sizes == n), self.repeats[n]
        keys = self.embed(np.stack([self.words[i] for i in items]), r) ^ np.arange(r, dtype=np.uint64)[:, None] << np.uint64(57)
        order = np.argsort(keys.ravel(), kind="stable")
        return keys.ravel()[order], np.tile(items, r)[order]

    def _seeded(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """By item size: (text, first word, item) of the windows around a run of words of an item."""
        windows: dict[int, list[np.ndarray]] = {}
        for q, (key, item, place) in self.seeds.items():
            grams = self._gram(ids, q)
            at = np.flatnonzero(grams)
            low, high = np.searchsorted(key, grams[at], "left"), np.searchsorted(key, grams[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            found = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = np.repeat(np.searchsorted(starts, at, "right") - 1, n)
            inside = np.repeat(at, n) + q <= ends[text]
            size = self.sizes[item[found]]
            for s in np.unique(size[inside]).tolist():
                own = inside & (size == s)
                windows.setdefault(s, []).append(np.unique(np.stack([text[own], np.repeat(at, n)[own] - place[found][own], item[found][own]], axis=1), axis=0))
        return {s: np.unique(np.concatenate(parts), axis=0) for s, parts in windows.items()}

    @staticmethod
    def _window(ids: np.ndarray, first: np.ndarray | int, n: int, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """The n words from `first` on, 0 where that is outside the text."""
        at = np.asarray(first)[..., None] + np.arange(n)
        valid = (at >= np.asarray(start)[..., None]) & (at < np.asarray(end)[..., None])
        return np.where(valid, ids[np.clip(at, 0, len(ids) - 1)], 0)

    def candidates(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, first word) of windows that share a key with an item. ids: all texts' words, one after the
        other, text t from starts[t] to ends[t].
        """
        out = set()
        for n, seeded in self._seeded(ids, starts, ends).items():
            if not (r := self.repeats[n]):
                out.update((t, i, f) for t, f, i in seeded.tolist())
                continue
            where = np.unique(seeded[:, :2], axis=0)
            own, items = self.keys[n]
            for i in range(0, len(where), 4096):
                text, first = where[i : i + 4096].T
                keys = self.embed(self._window(ids, first, n, starts[text], ends[text]), r) ^ np.arange(r, dtype=np.uint64)[:, None] << np.uint64(57)
                low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
                for row, w in zip(*np.nonzero(high > low), strict=True):
                    out.update((int(text[w]), int(items[k]), int(first[w])) for k in range(low[row, w], high[row, w]))
        return out

    def verify(self, ids: np.ndarray, item: int, first: int, start: int, end: int) -> tuple[int, int, int] | None:
        """(edits, first word, words) of the best stretch of ids[start:end] around the window at `first`, if it is within
        the item's edits: by bit-parallel edit distance over all ends, then over all beginnings.
        """
        k, n = int(self.edits[item]), int(self.sizes[item])
        low, high = max(first - k, start), min(first + n + k, end)
        text = ids[low:high].tolist()
        best, stop = _least_distance(self.words[item].tolist(), text, True)
        if best > k:
            return None
        back = text[:stop][::-1]
        _, length = _least_distance(self.words[item][::-1].tolist(), back, False)
        return best, low + stop - length, length


def _least_distance(pattern: list[int], text: list[int], free_start: bool) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of text that ends anywhere (and starts anywhere or at the front),
    and the words up to its end; Myers' bit vectors in one whole number. Number 0 matches nothing.
    """
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, stop = m, 0
    for j, w in enumerate(text, 1):
        eq = places.get(w, 0) if w else 0
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(x | plus)) & full, plus & x
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | (not free_start)) & full
        down = down << 1 & full
        plus, minus = (down | ~(eq | minus | up)) & full, up & (eq | minus)
        if score < best:
            best, stop = score, j
    return best, stop


def _matches(index: ItemIndex, raws: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, edits) of all matches in some texts, sorted."""
    get = index.vocabulary.get
    coded = [np.fromiter((get(w, 0) for w in words_of(raw)), np.int32) for raw in raws]
    ends = np.cumsum([len(c) for c in coded])
    ids, starts = np.concatenate(coded), ends - [len(c) for c in coded]
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    for t, item, first in index.candidates(ids, starts, ends):
        if found := index.verify(ids, item, first, int(starts[t]), int(ends[t])):
            edits, at, n = found
            at -= int(starts[t])
            best[t, item, at] = min(best.get((t, item, at), (edits, n)), (edits, n))
    return sorted((t, item, at, n, e) for (t, item, at), (e, n) in best.items())


def _item_blocks(benchmark: DataFrame, item_key: str, item_text: str, similarity: float) -> Iterator[ItemIndex]:
    """Indexes of at most BLOCK_WORDS words (or one item) each; one empty index for an empty benchmark."""
    rows = benchmark.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t"))
    block, held = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        words = words_of(r["t"].encode())
        if block and held + len(words) > BLOCK_WORDS:
            yield ItemIndex(block, similarity)
            block, held = [], 0
        block.append((r["i"], words))
        held += len(words)
    yield ItemIndex(block, similarity)


def find_items(docs: DataFrame, index: ItemIndex, item_type: DataType, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind, item_kind = dict(docs.dtypes)[key], to_arrow_type(item_type)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = _matches(index, as_bytes(batch.column(1)))
        columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.items[r[1]][0] for r in rows], item_kind)]
        columns += [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "item_id", "first_word", "n_words", "edits"])

    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, item_id {item_type.simpleString()}, first_word long, n_words long, edits long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, item_id, first_word, n_words, edits): each stretch of a text that a benchmark item fits with at most
    (1 - similarity) of its words edited, with the item's key as item_id. Words are runs of letters and digits, in lower case.

    Null and empty texts and items match nothing; equal items are each reported; repeated rows are reported each; empty
    tables give an empty one. Items are read in blocks of BLOCK_WORDS words, so what is sent to the executors is bounded;
    there is no shuffle, and no text leaves its task.
    """
    item_type = benchmark.schema[item_key].dataType
    found = [find_items(docs, index, item_type, key, text) for index in _item_blocks(benchmark, item_key, item_text, similarity)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark item as find_contamination() finds them. Each row
    is judged where it is read: no shuffle and no key is needed.
    """
    others = [c for c in docs.columns if c != text]
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    schema = "".join(f"c{i} {dict(docs.dtypes)[c]}, " for i, c in enumerate(others)) + "text string"
    rows = docs.select(*plain, F.col(f"`{text}`").alias("text"))
    for index in _item_blocks(benchmark, item_key, item_text, similarity):

        def run(batch: pa.RecordBatch, index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            hit = np.zeros(batch.num_rows, bool)
            hit[[m[0] for m in _matches(index, as_bytes(batch.column(batch.num_columns - 1)))]] = True
            yield batch.filter(pa.array(~hit))

        rows = map_texts(rows, run, schema)
    names = dict(zip(others, range(len(others)), strict=True))
    return rows.select(*(F.col("text").alias(c) if c == text else F.col(f"c{names[c]}").alias(c) for c in docs.columns))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
