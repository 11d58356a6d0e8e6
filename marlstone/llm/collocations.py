"""Phrase collocations by Apriori: candidates in a minimal perfect hash, counted in numpy arrays by slot.

Level by level, a phrase can only be frequent if the phrases it is made of are. One pass over the texts finds the
frequent words, one the pairs of frequent words that may be frequent, one the triples whose two pairs may be: each knows
the level below by a bit set of bounded size, whose errors only let more through. Words, pairs and triples then have
slots in a minimal perfect hash that stores their keys, so that a phrase that is no candidate is told apart. A last pass
counts every candidate by slot in one array a task, the arrays are summed as a tree, and the counts of a candidate's two
parts at each cut are read by their slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import BATCH_BYTES, read_table, release_memory, text_slices

#: Candidates of one hash, whose keys and counts (32 bytes a slot) every task can hold; beyond it they are dealt to blocks.
BLOCK = 3 << 20
#: The largest bit set, and its bits for each key below that size.
MOST_BITS, BITS_A_KEY = 1 << 28, 16
#: Slots of one row of counts, arrays that one task of the tree adds, and groups by which a language's ranks are found.
CHUNK, FAN_IN, SALTS = 1 << 16, 64, 64
LONGEST = 3
NO_LANG = "und"
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


class Keying(NamedTuple):
    """How words become keys: a seed, and the bits kept (all of 64, but in tests of what happens when words share a key)."""

    seed: int
    bits: int = 64


class Words(NamedTuple):
    """The words of texts of one language: distinct ones, their 64-bit keys, the number of each place's word, and
    whether the next place goes on in the same piece.
    """

    lang: str
    distinct: pa.Array
    keys: np.ndarray
    codes: np.ndarray
    goes_on: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hash(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """64 bits of phrases given by their words' keys, one array for each place."""
    h = columns[0]
    for k in columns[1:]:
        h = _mix(h + np.uint64(seed * 2 + 1)) + k
    return _mix(h)


def word_keys(lang: str, words: list[bytes], keying: Keying) -> np.ndarray:
    """64-bit keys, never zero, of a language's words."""
    head = f"{len(lang.encode())}:{lang}".encode()
    keys = np.fromiter((xxhash.xxh3_64_intdigest(head + w, keying.seed) for w in words), np.uint64, len(words))
    return np.maximum(keys >> np.uint64(64 - keying.bits), np.uint64(1))


def words_of(batch: pa.RecordBatch, keying: Keying) -> Iterator[Words]:
    """The words of (lang, text) rows, language by language. Null texts are empty."""
    langs = pc.fill_null(batch.column(0), NO_LANG).dictionary_encode()
    for number, lang in enumerate(langs.dictionary.to_pylist()):
        texts = pc.ascii_lower(pc.fill_null(batch.column(1).filter(pc.equal(langs.indices, number)), "")).cast(pa.large_binary())
        edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if edge[-1] == edge[0]:
            continue
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[edge[0] : edge[-1]]
        starts_at = np.unique(edge[:-1] - edge[0])
        starts_at = starts_at[starts_at < len(raw)]
        kind = _KIND[raw]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[starts_at] = inside[starts_at]
        places = np.flatnonzero(begins)
        if not len(places):
            continue
        breaks = kind == 2
        breaks[starts_at] = True
        piece = np.cumsum(breaks, dtype=np.int32)[places]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[places] - 1, np.count_nonzero(inside)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        yield Words(lang, coded.dictionary, word_keys(lang, coded.dictionary.to_pylist(), keying), coded.indices.to_numpy(), np.append(piece[1:] == piece[:-1], False))


class BitSet:
    """Whether a phrase may be in a set; never wrong about those that are."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


class Slots:
    """A minimal perfect hash of phrases (1 to 3 words' keys, zero where there is none), with their keys by slot.

    On each level a key that has its place of a bit array to itself sets the bit; the others go on to the next level. A
    key's slot is the number of bits set before its own, so n keys have the slots 0 to n - 1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.seed = 0
        while not self._build(keys):
            self.seed += 1

    def _build(self, keys: np.ndarray) -> bool:
        hashes = phrase_hash(list(keys.T), self.seed)
        left, bits = hashes, []
        self.levels: list[tuple[int, int]] = []  # first place and number of places
        while len(left):
            if len(self.levels) > 100:  # two keys of one hash
                return False
            size, start = max(64, int(1.5 * len(left))), sum(map(len, bits))
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((start, size))
            bits.append(alone)
            left = left[~alone[place]]
        flat = np.concatenate([*bits, np.zeros(64, bool)])
        flat = np.append(flat, np.zeros(-len(flat) % 64, bool))
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)][:-1].astype(np.int32)
        slots = self._slots(hashes)
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys
        return True

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; some slot or -1 for those that no key has."""
        slots, rest = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (start, size) in enumerate(self.levels):
            if not len(rest):
                break
            place = start + self._place(hashes[rest], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            here = word >> bit & np.uint64(1) > 0
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            slots[rest[here]] = self.before[place[here] >> 6] + below
            rest = rest[~here]
        return slots

    def find(self, *columns: np.ndarray) -> np.ndarray:
        """The slots of phrases, given by an array of keys for each place; -1 for a phrase that is no key."""
        full = [*columns, *[np.zeros(len(columns[0]), np.uint64)] * (LONGEST - len(columns))]
        if not len(self.keys):
            return np.full(len(full[0]), -1, np.int64)
        slots = self._slots(phrase_hash(full, self.seed))
        same = slots >= 0
        for i, column in enumerate(full):
            same &= self.keys[slots, i] == column
        return np.where(same, slots, -1)


def _grouped(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases and their counts. Phrases are sorted by hash and told apart by their keys, so that at worst a
    phrase comes twice.
    """
    order = np.argsort(phrase_hash(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _map_words(docs: DataFrame, per_batch: Callable[[Words], Iterator[pa.RecordBatch]], schema: str, keying: Keying) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, BATCH_BYTES):
                for words in words_of(part, keying):
                    yield from per_batch(words)
        release_memory()

    return docs.mapInArrow(run, schema)


def frequent_words(docs: DataFrame, least: int, key_bits: int = 64) -> tuple[DataFrame, Keying]:
    """(w, lang, word, f) of the words of f >= least, and each language's number of words under the empty word; and the
    keying by which no frequent word's key is another word's: where two words share one, the next seed is tried.
    """
    for keying in (Keying(seed, key_bits) for seed in range(100)):

        def counts(words: Words, keying: Keying = keying) -> Iterator[pa.RecordBatch]:
            n = np.bincount(words.codes, minlength=len(words.keys))
            texts = pa.concat_arrays([words.distinct.cast(pa.string()), pa.array([""])])
            keys = np.append(words.keys, word_keys(words.lang, [b""], keying))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([words.lang] * len(keys)), texts, pa.array(np.append(n, n.sum()))], names=["w", "lang", "word", "n"])

        rows = _map_words(docs, counts, "w long, lang string, word string, n long", keying)
        named = rows.groupBy("w", "lang", "word").agg(F.sum("n").alias("f"))
        words = named.groupBy("w").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("spellings"), F.max(F.struct("lang", "word")).alias("s"))
        words = written(words.where(F.col("f") >= least).select("w", "s.lang", "s.word", "f", "spellings"))
        if not words.where("spellings > 1").head(1):
            return words.drop("spellings"), keying
    raise ValueError("no seed tells all words apart")


def _bit_set(keys: DataFrame, names: list[str]) -> BitSet:
    """A bit set of the phrases of keys, made in pieces by the executors; at most MOST_BITS bits come to the driver."""
    wanted = max(1 << 16, keys.count() * BITS_A_KEY)
    size = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    shift = np.uint64(64 - size.bit_length() + 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (phrase_hash([c.to_numpy().view(np.uint64) for c in batch.columns]) >> shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 16), pa.array(place & 0xFFFF)], names=["piece", "place"])

    def piece(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, bool)
        bits[table.column("place").to_numpy()] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = np.zeros(size // 8, np.uint8)
    for row in keys.select(*names).mapInArrow(places, "piece long, place long").distinct().groupBy("piece").applyInArrow(piece, "piece long, bits binary").toLocalIterator():
        found[row["piece"] << 13 : (row["piece"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    return BitSet(found)


def _may_be_frequent(docs: DataFrame, length: int, parts: DataFrame, keying: Keying, least: int) -> DataFrame:
    """(w1, ..): phrases of `length` words whose two parts of one word less may be in `parts`, and which occur `least`
    times. Counts end at `least` in each batch, which is enough to tell that.
    """
    names = [f"w{i}" for i in range(1, length + 1)]
    known = docs.sparkSession.sparkContext.broadcast(_bit_set(parts, parts.columns))

    def phrases(words: Words) -> Iterator[pa.RecordBatch]:
        hit = known.value.holds(phrase_hash([words.keys]))[words.codes] if length == 2 else None
        keys, on = words.keys[words.codes], words.goes_on
        if length == 2:
            at = np.flatnonzero(on[:-1] & hit[:-1] & hit[1:])
        else:
            pairs = np.flatnonzero(on[:-1])
            held = np.zeros(len(keys), bool)
            held[pairs] = known.value.holds(phrase_hash([keys[pairs], keys[pairs + 1]]))
            at = np.flatnonzero(held[:-1] & held[1:])
        if len(at):
            columns, n = _grouped([keys[at + i] for i in range(length)])
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(np.minimum(n, least))], names=[*names, "n"])

    rows = _map_words(docs, phrases, ", ".join(f"{c} long" for c in names) + ", n long", keying)
    return written(rows.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*names))


def _phrases_by_slot(words: Words, find: Callable[..., np.ndarray]) -> Iterator[np.ndarray]:
    """The slots of all words, pairs and triples that are candidates, by length: a phrase is looked up where its parts
    were found.
    """
    keys = words.keys[words.codes]
    found = find(words.keys)[words.codes]
    yield found[found >= 0]
    at = np.flatnonzero(words.goes_on[:-1] & (found[:-1] >= 0) & (found[1:] >= 0))
    slots = find(keys[at], keys[at + 1])
    yield slots[slots >= 0]
    at = at[slots >= 0]
    at = at[:-1][at[1:] == at[:-1] + 1] if len(at) else at
    slots = find(keys[at], keys[at + 1], keys[at + 2])
    yield slots[slots >= 0]


def _tree_sum(arrays: DataFrame, tasks: int) -> DataFrame:
    """(chunk, counts) from the arrays (chunk, task, counts) of all tasks, FAN_IN arrays added at a time."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column("counts"))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        arrays = arrays.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("chunk", "task").applyInArrow(add, "chunk long, task long, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return arrays.select("chunk", "counts")


def _array_rows(counts: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), CHUNK):
        part = counts[at : at + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK]), pa.array([task]), pa.array([part.tobytes()], pa.binary())], names=["chunk", "task", "counts"])


def _counted_whole(docs: DataFrame, keys: DataFrame, keying: Keying) -> DataFrame:
    """(w1, w2, w3, a, l1, r1, l2, r2) of pairs and triples: one hash of all candidates, in every task."""
    spark = docs.sparkSession
    table = keys.toArrow()
    slots = Slots(np.stack([c.to_numpy().view(np.uint64) for c in table.columns], axis=1))
    shared = spark.sparkContext.broadcast(slots)
    size = len(slots.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in text_slices(batch, 1, BATCH_BYTES):
                for words in words_of(part, keying):
                    for found in _phrases_by_slot(words, shared.value.find):
                        n = np.bincount(found)
                        counts[: len(n)] += n
        yield from _array_rows(counts, TaskContext.get().partitionId())
        release_memory()

    arrays = docs.mapInArrow(run, "chunk long, task long, counts binary")
    counts = np.zeros(size, np.int64)
    for row in _tree_sum(arrays, docs.rdd.getNumPartitions()).toLocalIterator():
        part = np.frombuffer(row["counts"], np.int64)
        counts[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    by_slot = spark.sparkContext.broadcast(counts)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            w = shared.value.keys[at]
            at, w = at[w[:, 1] > 0], w[w[:, 1] > 0]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(w[:, i]).view(np.int64)) for i in range(LONGEST)), *(pa.array(c) for c in _read_cuts(w, at, shared.value.find, by_slot.value))], names=CUT_NAMES)

    return spark.range(size).mapInArrow(cuts, CUT_KIND)


CUT_NAMES = ["w1", "w2", "w3", "a", "l1", "r1", "l2", "r2"]
CUT_KIND = ", ".join(f"{c} long" for c in CUT_NAMES)


def _read_cuts(w: np.ndarray, at: np.ndarray, find: Callable[..., np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """a, and the counts left and right of the first and the second cut (zero for a pair's second), by slot."""
    triple = w[:, 2] > 0
    columns = [np.ascontiguousarray(w[:, i]) for i in range(LONGEST)]
    l1, r1 = counts[find(columns[0])], counts[find(columns[1], columns[2])]
    l2, r2 = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    a, b, c = (x[triple] for x in columns)
    l2[triple], r2[triple] = counts[find(a, b)], counts[find(c)]
    return [counts[at], l1, r1, l2, r2]


def _counted_in_blocks(docs: DataFrame, keys: DataFrame, keying: Keying, blocks: int) -> DataFrame:
    """As _counted_whole(), where candidates are too many for one hash: phrases go to the block of their hash, in batches
    that are counted first, and each block's candidates have a hash of their own; parts are joined by key.
    """
    spark = docs.sparkSession
    names = ["w1", "w2", "w3"]
    levels = {n: spark.sparkContext.broadcast(_bit_set(keys.where(where).select(*names[:n]), names[:n])) for n, where in ((1, "w2 = 0"), (2, "w2 <> 0 AND w3 = 0"))}

    def block_of(columns: list[np.ndarray]) -> np.ndarray:
        return (_mix(phrase_hash(columns)) % np.uint64(blocks)).astype(np.int64)

    def phrases(words: Words) -> Iterator[pa.RecordBatch]:
        keys_, on = words.keys[words.codes], words.goes_on
        hit = levels[1].value.holds(phrase_hash([words.keys]))[words.codes]
        pairs = np.flatnonzero(on[:-1] & hit[:-1] & hit[1:])
        held = levels[2].value.holds(phrase_hash([keys_[pairs], keys_[pairs + 1]]))
        pairs = pairs[held]
        triples = pairs[:-1][pairs[1:] == pairs[:-1] + 1] if len(pairs) else pairs
        for n, at in enumerate((np.flatnonzero(hit), pairs, triples), 1):
            if not len(at):
                continue
            columns, count = _grouped([keys_[at + i] for i in range(n)])
            columns += [np.zeros(len(count), np.uint64)] * (LONGEST - n)
            block = block_of(columns)
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1))
            for at_ in np.split(order, edges[1:]):
                raw = [np.ascontiguousarray(c[at_]).tobytes() for c in (*columns, count)]
                yield pa.RecordBatch.from_arrays([pa.array([block[at_[0]]]), pa.array([zlib.crc32(raw[0]) % SALTS]), *(pa.array([r], pa.binary()) for r in raw)], names=["block", "salt", *names, "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(block_of(columns)), *batch.columns], names=["block", *names])

    sent = _map_words(docs, phrases, "block long, salt long, w1 binary, w2 binary, w3 binary, n binary", keying)
    salted = keys.select(*names).mapInArrow(hashed, "block long, w1 long, w2 long, w3 long").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def count(key: tuple, got: pa.Table, mine: pa.Table) -> pa.Table:
        slots = Slots(np.stack([mine.column(c).to_numpy().view(np.uint64) for c in names], axis=1))
        counts = np.zeros(len(slots.keys), np.int64)
        for row in zip(*(got.column(c) for c in (*names, "n")), strict=True):
            *columns, n = (np.frombuffer(b.as_buffer(), np.uint64) for b in row)
            found = slots.find(*columns)
            np.add.at(counts, found[found >= 0], n.view(np.int64)[found >= 0])
        seen = np.flatnonzero(counts)
        return pa.table({**{c: pa.array(np.ascontiguousarray(slots.keys[seen, i]).view(np.int64)) for i, c in enumerate(names)}, "n": pa.array(counts[seen])})

    summed = sent.groupBy("block", "salt").cogroup(salted.groupBy("block", "salt")).applyInArrow(count, "w1 long, w2 long, w3 long, n long")
    counts = written(summed.groupBy(*names).agg(F.sum("n").alias("n")))

    def of(alias: str, *columns: str) -> tuple[DataFrame, list[str]]:
        own = [f"{alias}_{i}" for i in range(LONGEST)]
        where = " AND ".join(f"w{i + 1} {'<>' if i < len(columns) else '='} 0" for i in range(LONGEST))
        return counts.where(where).select(*(F.col(c).alias(o) for c, o in zip(names, own, strict=True)), F.col("n").alias(alias)), own[: len(columns)]

    def with_part(rows: DataFrame, alias: str, *columns: str) -> DataFrame:
        part, own = of(alias, *columns)
        on = [F.col(c) == F.col(o) for c, o in zip(columns, own, strict=True)]
        return rows.join(part, on).drop(*(f"{alias}_{i}" for i in range(LONGEST)))

    pairs = with_part(with_part(counts.where("w2 <> 0 AND w3 = 0"), "l1", "w1"), "r1", "w2").withColumns({"l2": F.lit(0).cast("long"), "r2": F.lit(0).cast("long")})
    triples = counts.where("w3 <> 0")
    for alias, columns in (("l1", ["w1"]), ("r1", ["w2", "w3"]), ("l2", ["w1", "w2"]), ("r2", ["w3"])):
        triples = with_part(triples, alias, *columns)
    return pairs.unionByName(triples).withColumnRenamed("n", "a").select(*CUT_NAMES)


def _score(left: str, right: str) -> F.Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, dominated: int = 50, key_bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words.

    A candidate occurs `least` times within pieces. Its score is that of its lowest cut; a pair inside a triple that
    occurs dominated/100 as often as the pair is dropped. Null and empty texts have no word, a null language is `und`;
    repeated rows count each; an empty table gives an empty one; no other column is read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    words, keying = frequent_words(rows, least, key_bits)
    single = words.where("word <> ''").select(F.col("w").alias("w1"))
    pairs = _may_be_frequent(rows, 2, single, keying, least)
    triples = _may_be_frequent(rows, 3, pairs, keying, least)
    none = F.lit(0).cast("long")
    keys = single.withColumns({"w2": none, "w3": none}).unionByName(pairs.withColumn("w3", none)).unionByName(triples)
    n = keys.count()
    counted = written(_counted_whole(rows, keys, keying) if n <= BLOCK else _counted_in_blocks(rows, keys, keying, -(-n // BLOCK)))
    counted = counted.where(F.col("a") >= least)
    inside = [counted.where("w3 <> 0").select(F.col(x).alias("w1"), F.col(y).alias("w2"), F.col("a").alias("most")) for x, y in (("w1", "w2"), ("w2", "w3"))]
    longer = inside[0].unionByName(inside[1]).groupBy("w1", "w2").agg(F.max("most").alias("most")).withColumn("w3", none)
    kept = counted.join(longer, ["w1", "w2", "w3"], "left").where(F.col("most").isNull() | (100 * F.col("most") < dominated * F.col("a")))
    kept = kept.withColumns({"s1": _score("l1", "r1"), "s2": F.when(F.col("w3") != 0, _score("l2", "r2"))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    kept = kept.select("w1", "w2", "w3", "a", *(F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in "lr"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    named = kept
    for i in range(1, LONGEST + 1):
        spelled = words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 1 else []))
        named = named.join(spelled, f"w{i}", "inner" if i < LONGEST else "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3")).drop("t1", "t2", "t3")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.where("word = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spans AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) AS t(k)),
counts AS (
  SELECT lang, CAST(k AS INTEGER) AS k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL),
totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, cut,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN counts AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
            JOIN counts AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(kept.phrase)) AS rank,
       kept.phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""
