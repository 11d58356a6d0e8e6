"""Best-fit packing of token sequences, certified by dual-feasible lower bounds and repaired by exchange."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, read_table, text_slices

#: Pieces that one packing task takes on average; partitions whose open sequences are pooled at the end.
PIECES_PER_TASK, POOLED_PARTITIONS = 8_000, 256
#: Bytes of words and ids that a worker remembers, and the longest word among them; words that go into one call.
CACHE_BYTES, LONGEST_KEPT, CALL_WORDS = 16 << 20, 64, 20_000
#: Bytes of text that are tokenized at one time.
TOKENIZE_BYTES = 6 << 20
MARK, WORD_END = "<|endoftext|>", "</w>"
LAST_LATIN = chr(0x24F)
#: A word of lower-case letters and the marks behind it. The tokenizer takes the marks as one piece, unless an apostrophe
#: is their first: that may be the front of a short form.
_PLAIN = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?")


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is printable Latin-1 and not a gap,
    else the next one from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class WordIds:
    """Ids of whole texts by a tokenizer that never looks across ASCII white space, each distinct word encoded once.

    The ids of all known words stand in one array. A word of lower-case letters is a piece that normalisation and
    splitting leave as it is, so that the model alone gives its ids; other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.written = _byte_characters()
        self._check(path)
        self._clear()

    def _check(self, path: str) -> None:
        """That this tokenizer works as this class takes it to."""
        probe = ["it's,", "l\u00e9on", "x##,", "\u00e9t\u00e9!", "a1b", "(ab)", "ab'"]
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        apart = [i for w in probe for i in encode(w)]
        if self.mark is None or encode(" ".join(probe)) != apart or encode(" ".join(probe).upper().lower()) != apart:
            raise ValueError(f"{path}: words at white space are not encoded each on its own")
        if encode("abc") != self.pieces.encode("abc").ids or encode("abc,#") != encode("abc") + encode(",#") or not self.last[encode("abc,")[-1]]:
            raise ValueError(f"{path}: a word's letters are not a piece that ends in {WORD_END}")

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.held = [np.empty(0, np.uint32)], 0  # ids of words, in the order of their numbers
        self.starts, self.sizes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.words, self.tokens = 1, 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Takes words with their ids in; their numbers."""
        numbers = np.arange(self.words, self.words + len(words))
        self.known.update((w, n) for w, n in zip(words, numbers.tolist(), strict=True) if len(w) <= LONGEST_KEPT)
        self.ids.append(ids.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))
        self.starts.append(self.tokens + np.cumsum(sizes) - sizes)
        self.words, self.tokens = self.words + len(words), self.tokens + len(ids)
        self.held += 2 * sum(map(len, words)) + 4 * len(ids)
        return numbers

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and each word's start and number of them."""
        for name in ("ids", "starts", "sizes"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.ids[0], self.starts[0], self.sizes[0]

    def _model_text(self, word: str) -> str | None:
        """The word in the vocabulary's characters, if it is one run of lower-case Latin letters."""
        if word.isascii():
            return word if word.isalpha() and word.islower() else None
        if not word.isalpha() or word != word.lower() or max(word) > LAST_LATIN or not is_normalized("NFC", word):
            return None
        return word.encode().decode("latin-1").translate(self.written)

    def _by_model(self, words: list[str], texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        for i in range(0, len(words), CALL_WORDS):
            call = words[i : i + CALL_WORDS]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(texts[i : i + CALL_WORDS])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(call) or ends[-1] != len(ids):
                raise ValueError(f"the ids of {len(call)} words end {len(ends)} words")
            yield call, ids, np.diff(np.r_[0, ends])

    def _by_tokenizer(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        glue = f" {MARK} "
        for i in range(0, len(words), CALL_WORDS):
            call = words[i : i + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([glue.join(call)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.r_[np.flatnonzero(ids == self.mark), len(ids)]
            if len(ends) != len(call):
                raise ValueError("the tokenizer joined or split words at white space")
            yield call, np.delete(ids, ends[:-1]), np.diff(np.r_[-1, ends]) - 1

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of words that are not known, after encoding them."""
        local: dict[str, int] = {}
        joined, model, others = {}, {}, []
        for w in words:
            if m := _PLAIN.fullmatch(w):
                core, tail = m.groups()
                if tail:
                    joined[w] = core, tail
                    if tail not in self.known:
                        others.append(tail)
                if core not in self.known:
                    model[core] = core
            elif "<|" in w:
                ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int64)
                local[w] = int(self._add([w], ids, np.array([len(ids)]))[0])
            elif text := self._model_text(w):
                model[w] = text
            else:
                others.append(w)
        for source in (self._by_model(list(model), list(model.values())), self._by_tokenizer([*dict.fromkeys(others)])):
            for call, ids, sizes in source:
                local.update(zip(call, self._add(call, ids, sizes).tolist(), strict=True))
        if joined:
            number = lambda w: n if (n := local.get(w)) is not None else self.known[w]
            parts = np.fromiter(map(number, chain.from_iterable(joined.values())), np.int64, 2 * len(joined))
            ids, starts, sizes = self._table()
            n = sizes[parts]
            local.update(zip(joined, self._add(list(joined), ids[_gathered(starts[parts], n)], n.reshape(-1, 2).sum(axis=1)).tolist(), strict=True))
        return np.array([local[w] for w in words], np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = self._learn([words[i] for i in new.tolist()])
        return numbers

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. A-Z are lowered first, as the tokenizer does, but
        not in words that may hold a special token's own string.
        """
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        lower = pc.ascii_lower(words)
        if pc.any(special := pc.match_substring(words, "<|")).as_py():
            lower = pc.if_else(special, words, lower)
        coded = lower.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self._numbers(distinct)
        ids, starts, sizes = self._table()
        of_word = numbers[coded.indices.to_numpy()]
        edge = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))]
        total = np.r_[0, np.cumsum(sizes[of_word])]
        step = max(1, len(of_word) // max(1, int(total[-1]) // 500_000))
        raw = b"".join(ids[_gathered(starts[w], sizes[w])].astype("<u4").tobytes() for w in (of_word[i : i + step] for i in range(0, len(of_word), step)))
        cuts = 4 * total[edge]
        out = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if self.held > CACHE_BYTES:  # goes on with this call's words alone
            keep = np.flatnonzero(sizes[numbers] > 0)
            n = sizes[numbers[keep]]
            kept = ids[_gathered(starts[numbers[keep]], n)]
            self._clear()
            self._add([distinct[i] for i in keep.tolist()], kept, n)
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every text's ids and then end_id, cut only where longer than
    capacity. A null text is empty: one piece with the end id alone.
    """
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch, 1, TOKENIZE_BYTES):
            yield cut_texts(part)

    def cut_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        texts = batch.column(1)
        for i, raw in enumerate(_word_ids(tokenizer_path).encode(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["key", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of bins by dual-feasible functions: the identity, thresholds, and rounded multiples.

    A function f is dual feasible if any lengths that fit a bin have f-values that sum to the capacity at most, so the
    f-values' sum over the capacity, rounded up, is a bound. All sums are of whole numbers.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    total, weight = np.cumsum(count), np.cumsum(count * size)
    cuts = np.arange(1, capacity // 2 + 1)  # below the cut: nothing; within a cut of the capacity: a whole bin
    sums = (weight[capacity - cuts] - weight[cuts - 1]) + capacity * (total[capacity] - total[capacity - cuts])
    if len(cuts):
        best = max(best, -(-int(sums.max()) // capacity))
    for k in range(1, 33):
        value = np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each item's bin and offset, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0  # open_rooms: bit r is set if a bin with room r exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := open_rooms >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - r
        room[r - n].append(b)
        open_rooms |= 1 << (r - n)
    return bins, offsets, used


def _pack(rows: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Deals rows into `parts` partitions anew and packs each: part, bin, place, bins (used by the part), bound."""
    given = [c for c in rows.columns if c not in ("part", "bin", "place", "bins", "bound", "level")]
    dealt = rows.select(*given, F.pmod(F.xxhash64("serial", F.lit(seed)), F.lit(parts)).alias("part"))

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        more = {"bin": bins, "place": offsets, "bins": np.full(len(lengths), used), "bound": np.full(len(lengths), lower_bound(lengths, capacity))}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", bin long, place long, bins long, bound long"
    return dealt.groupBy("part").applyInArrow(run, schema).withColumn("level", F.lit(seed))


def _bins(rows: DataFrame) -> int:
    return rows.where("place = 0").count()


def pack(pieces: DataFrame, capacity: int, rounds: int = 3) -> DataFrame:
    """pieces (serial, length, ...) with sequence_id and offset, in as few sequences as can be reached. serial is a number of
    each row's own, so that equal rows are dealt out too; pieces must be written, as it must not change.

    Each partition is packed by best-fit decreasing and certified by its lower bound. The partitions that use more bins
    than their bound exchange their pieces and are packed again, as long as that saves bins. Then the sequences that are
    not full of up to POOLED_PARTITIONS partitions are packed once more together, which wins back what partitions lose
    by each rounding up. Nothing is cut here, and no piece is lost: equal rows are packed each on its own.
    """
    n = pieces.count()
    parts = max(1, -(-n // PIECES_PER_TASK))
    done, work = [], cut(_pack(pieces, parts, 0, capacity))
    for seed in range(1, rounds + 1):
        gap = work.where("bins > bound")
        had = _bins(gap)
        if not had:
            break
        n_gap = gap.select("part").distinct().count()
        again = cut(_pack(gap, n_gap, seed, capacity))
        if _bins(again) >= had:
            break
        done.append(work.where("bins <= bound"))
        work = again
    packed = work
    for d in done:
        packed = packed.unionByName(d)
    fill = packed.groupBy("level", "part", "bin").agg(F.sum("length").alias("fill"))
    marked = cut(packed.join(fill, ["level", "part", "bin"]))
    pools = max(1, -(-parts // POOLED_PARTITIONS))
    full_enough = F.col("fill") >= capacity - capacity // 256
    loose = marked.where(~full_enough)
    level = rounds + 1
    pooled = cut(_pack(loose.drop("fill"), pools, level, capacity))
    better = _bins(pooled) < _bins(loose)
    final = marked.where(full_enough).drop("fill").unionByName(pooled) if better else marked.drop("fill")
    number = F.col("level").cast("long") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    return final.withColumn("sequence_id", number).withColumnRenamed("place", "offset").drop("part", "bin", "bins", "bound", "level")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row for each piece of each row of docs.

    Null and empty texts are one piece of the end id; repeated rows and null keys are packed like others; an empty table
    gives an empty one; other columns of docs are not read. with_ids keeps the token ids themselves.
    """
    rows = cut(token_pieces(docs, tokenizer_path, capacity, key, text, with_ids=with_ids).withColumn("serial", F.monotonically_increasing_id()))
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["sequence_id", "offset"]
    return pack(rows, capacity).select(F.col("key").alias(key), *names)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
