"""Packing along a space-filling curve: neighbouring documents in the space of hashed vectors share sequences.

A document's vector counts its token ids, hashed with a sign into VECTOR places, and is projected to DIMENSIONS numbers.
These, made comparable by their mean and spread over the corpus, are places on a grid, whose Hilbert key orders the
documents. A range sort by that key deals the documents to tasks, and each task cuts its stretch of the curve into full
sequences. What is left at a stretch's end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read_table, release_memory, shared_dir, text_slices
from .packing import CALL_WORDS, MARK, TOKENIZE_BYTES, WordIds, _byte_characters, _gathered

VECTOR, DIMENSIONS, BITS = 4096, 4, 12
#: Tokens of one packing task on average, and of one output batch.
TASK_TOKENS, BATCH_TOKENS = 16 << 20, 1 << 20
#: Bytes of units and ids that a worker remembers; in Python they take about eight times as much.
UNIT_BYTES = 32 << 20
#: Where a text cannot be cut at ASCII white space: white space of other scripts, separators that only some rules take as
#: white space, and the special token's own string.
_UNEVEN = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|<\|endoftext\|>")
_MAY_BE_UNEVEN = np.zeros(256, bool)
_MAY_BE_UNEVEN[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20), *b"<"]] = True
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[*range(9, 14), 32]] = True
_IS_LETTER, _IS_SIGN = np.zeros(256, bool), np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_SIGN[[i for i in range(33, 127) if not _IS_LETTER[i]]] = True


class ByteIds(WordIds):
    """Ids of whole texts by a byte-level tokenizer whose pieces never go on over white space, but for one blank before
    a word, nor from a letter to a sign. Each distinct unit (a word with that blank, the signs behind it, or the rest of a
    gap) is encoded once, a word of letters by the model alone; texts with white space beyond ASCII or with a special token
    go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probe = "It's a,b\n\n \t x1   \u00e9t\u00e9's\tit\r\n\n".encode()
        cuts = self._cuts(np.frombuffer(probe, np.uint8), np.array([0, len(probe)])).tolist()
        apart = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in encode(probe[a:b].decode())]
        if self.mark is None or encode(probe.decode()) != apart:
            raise ValueError(f"{path}: units at white space are not encoded each on its own")
        vocabulary = self.tokenizer.get_vocab()
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.written = {**_byte_characters(), 10: "\n"}
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(self.written[32])]] = True
        self._clear()

    def _learn(self, words: list[bytes]) -> np.ndarray:
        numbers, glue = np.empty(len(words), np.int64), MARK.encode()
        letters = np.fromiter((w[:1] == b" " and w[1:].decode().isalpha() for w in words), bool, len(words))
        for kind in (True, False):
            of = np.flatnonzero(letters == kind)
            for at in range(0, len(of), CALL_WORDS):
                call = [words[i] for i in of[at : at + CALL_WORDS].tolist()]
                if kind:  # " word" is one piece, and its first token alone opens with the blank
                    ids = np.array(self.pieces.encode_batch_fast([b"\n".join(call).decode("latin-1").translate(self.written)], add_special_tokens=False)[0].ids, np.int64)
                    sizes = np.diff(np.r_[np.flatnonzero(self.opens[ids]), len(ids)])
                else:
                    ids = np.array(self.tokenizer.encode_batch_fast([glue.join(call).decode()], add_special_tokens=False)[0].ids, np.int64)
                    ends = np.r_[np.flatnonzero(ids == self.mark), len(ids)]
                    ids, sizes = np.delete(ids, ends[:-1]), np.diff(np.r_[-1, ends]) - 1
                if len(sizes) != len(call):
                    raise ValueError(f"the ids of {len(call)} units end {len(sizes)}")
                numbers[of[at : at + CALL_WORDS]] = self._add(call, ids, sizes)
        return numbers

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids. A null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        uneven = [i for i in np.flatnonzero(_MAY_BE_UNEVEN[raw]).tolist() if _UNEVEN.match(raw, i)]
        odd = np.unique(np.searchsorted(edge, uneven, side="right") - 1)
        cuts = self._cuts(raw, edge)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]) if len(raw) else pa.array([], pa.binary())
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes, numbers = coded.indices.to_numpy(), np.zeros(len(distinct), np.int64)
        first = np.searchsorted(cuts[:-1], edge)  # of each text, its first unit
        used = np.arange(len(distinct))
        if len(odd):
            plain = np.ones(len(codes), bool)
            for i in odd.tolist():
                plain[first[i] : first[i + 1]] = False
            used = np.unique(codes[plain])
            codes = np.where(plain, codes, len(distinct))
        numbers[used] = self._numbers([distinct[i] for i in used.tolist()])
        ids, starts, sizes = self._table()
        of_code = np.r_[numbers, 0]  # number 0 is the empty unit
        start, size = starts[of_code][codes], sizes[of_code][codes]
        flat = ids[_gathered(start, size)]
        end = np.r_[0, np.cumsum(size)][first]
        out = [flat[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
        for i in odd.tolist():
            out[i] = np.array(self.tokenizer.encode(raw[edge[i] : edge[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        self._shrink([distinct[i] for i in used.tolist()], numbers[used])
        return out

    @staticmethod
    def _cuts(raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where units begin: texts, gaps, the last character of a gap before a word, words not behind a blank, and signs
        and digits behind a letter.
        """
        gap = _IS_GAP[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[edge] = True
        change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        words = change[~gap[change]]
        words = words[~cut[words]]
        cut[change] = True
        cut[words] = raw[words - 1] != 32
        cut[words - 1] = True
        cut[1:-1] |= _IS_LETTER[raw[:-1]] & _IS_SIGN[raw[1:]]
        return np.flatnonzero(cut)

    def _shrink(self, words: list[bytes], numbers: np.ndarray) -> None:
        if self.held <= UNIT_BYTES:
            return
        ids, starts, sizes = self._table()
        keep = np.flatnonzero(sizes[numbers] > 0)
        n = sizes[numbers[keep]]
        kept = ids[_gathered(starts[numbers[keep]], n)]
        self._clear()
        self._add([words[i] for i in keep.tolist()], kept, n)

    def _clear(self) -> None:
        super()._clear()
        self.known = {b"": 0}


@lru_cache(maxsize=2)
def _byte_ids(path: str) -> ByteIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteIds(path)


@lru_cache(maxsize=2)
def _projection(ids: int) -> np.ndarray:
    """What each token id adds to the projected vector: the sign and the row of its hashed place."""
    hashed = (np.arange(ids, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    place, sign = (hashed >> np.uint64(32)) % np.uint64(VECTOR), np.where(hashed >> np.uint64(31) & np.uint64(1), 1.0, -1.0)
    rows = np.random.default_rng(7).standard_normal((VECTOR, DIMENSIONS))
    return rows[place.astype(np.int64)] * sign[:, None]


def hilbert_key(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of grid places (n by dimensions, each below 2^bits), by Skilling's transform."""
    x = places.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenized(docs: DataFrame, tokenizer_path: str, key: str, text: str, end_id: int) -> DataFrame:
    """(key, n, ids, place): every row's ids and end_id, as bytes, and the projection of its hashed vector of counts."""
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = _byte_ids(tokenizer_path)
        adds = _projection(int(coder.tokenizer.get_vocab_size()))
        for part in text_slices(batch, 1, TOKENIZE_BYTES):
            found = coder.encode(part.column(1))
            n = np.array([len(f) for f in found], np.int64)
            place = np.zeros((len(found), DIMENSIONS))
            for i, f in enumerate(found):
                if len(f):
                    ids, counts = np.unique(f, return_counts=True)
                    place[i] = counts @ adds[ids] / np.sqrt(counts @ counts)
            raw = [np.append(f, end_id).astype("<u4" if coder.wide else "<u2").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n + 1), pa.array(raw, pa.binary()), *(pa.array(place[:, d]) for d in range(DIMENSIONS))], names=["key", "n", "ids", *(f"p{d}" for d in range(DIMENSIONS))])

    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n long, ids binary, " + ", ".join(f"p{d} double" for d in range(DIMENSIONS)))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `curve`, the Hilbert key of each row's projection on a grid that the corpus's mean and spread set."""
    names = [f"p{d}" for d in range(DIMENSIONS)]
    stats = rows.agg(*(f(c) for c in names for f in (F.avg, F.stddev_pop))).first()
    mean, spread = np.array([s or 0.0 for s in stats[::2]]), np.array([s or 1.0 for s in stats[1::2]])

    @F.pandas_udf("long")
    def as_curve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            z = (np.stack([c.to_numpy() for c in columns], axis=1) - mean) / spread
            share = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))  # near the normal distribution: cells of like counts
            yield pd.Series(hilbert_key(np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64)))

    return rows.withColumn("curve", as_curve(*names)).drop(*names)


def tail_lengths(rest: int) -> list[int]:
    """Powers of two, falling, that come to `rest`."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _sequences(total: int, capacity: int) -> np.ndarray:
    """Ends of the sequences of a stretch of `total` tokens: full ones, then powers of two."""
    full, rest = divmod(total, capacity)
    return np.cumsum([capacity] * full + tail_lengths(rest)) if total else np.zeros(0, np.int64)


def pack_along_curve(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, curve, sequence_id, offset[, ids]): the pieces of every row of docs.

    Rows stand in the order of their Hilbert key, then of the key itself, then of arrival; ranges of that order go to
    tasks, so that equal texts, however many, are dealt out by their keys. Within a range tokens follow one another
    without a gap, cut where a sequence is full; the last stretch of a range becomes sequences of powers of two. No
    token is padding and a document is cut only where a sequence ends. Null and empty texts are the end id alone;
    repeated rows and null keys are packed like others; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    coded = tokenized(docs, tokenizer_path, key, text, end_id).withColumn("arrival", F.monotonically_increasing_id())
    coded.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(coded.schema).parquet(folder)
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // TASK_TOKENS))
    order = ["curve", "key", "arrival"]
    ranged = _keyed(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = f"key {dict(rows.dtypes)['key']}, start long, length long, ids_crc32 long, doc_tokens long, curve long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in kind.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of bounded text in order. Only the sequence that is not full yet is held: its pieces wait for the
        next batch, for at the end of the range it is cut anew.
        """
        base, done = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []  # (row of its batch as an array, start, ids, doc_tokens, curve)
        held = 0

        def emit(items: list[tuple], ends: np.ndarray) -> pa.RecordBatch:
            out: list[list] = [[] for _ in names[1:]]
            keys, at, seq, opened = [], 0, 0, 0
            for key_, start, ids, tokens, curve in items:
                used = 0
                while used < len(ids):
                    take = min(len(ids) - used, int(ends[seq]) - at)
                    part = ids[used : used + take].astype("<u4")
                    keys.append(key_)
                    for column, value in zip(out, (start + used, take, zlib.crc32(part.tobytes()), tokens, curve, base + done + seq, at - opened, part.astype(np.int32)), strict=False):
                        column.append(value)
                    used, at = used + take, at + take
                    if at == ends[seq]:
                        opened, seq = at, seq + 1
            key_column = pa.concat_arrays(keys)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([key_column, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, (n, curve, raw) in enumerate(zip(column["n"].to_pylist(), column["curve"].to_pylist(), column["ids"], strict=True)):
                buffer = raw.as_buffer()
                waiting.append((column["key"].slice(i, 1), 0, np.frombuffer(buffer, "<u4" if len(buffer) == 4 * n else "<u2"), n, curve))
                held += n
                if held >= BATCH_TOKENS:
                    full = held // capacity
                    rest = held - full * capacity
                    last, carried = [], rest
                    while carried:  # pieces behind the last full sequence
                        key_, start, ids, tokens, c = waiting.pop()
                        if len(ids) > carried:
                            waiting.append((key_, start, ids[:-carried], tokens, c))
                            start, ids = start + len(ids) - carried, ids[-carried:].copy()
                        last.append((key_, start, ids, tokens, c))
                        carried -= len(ids)
                    yield emit(waiting, np.arange(1, full + 1) * capacity)
                    waiting, held, done = last[::-1], rest, done + full
        if held:
            yield emit(waiting, _sequences(held, capacity))
        release_memory()

    packed = ranged.select("key", "n", "ids", "curve").mapInArrow(pieces, kind)
    return packed.withColumnRenamed("key", key)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = pack_along_curve(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
