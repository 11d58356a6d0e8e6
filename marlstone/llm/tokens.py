"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_texts, read_table

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Words that a worker remembers the counts of, and the longest of them.
CACHE_WORDS, LONGEST_KEPT = 300_000, 64
NO_RANK = np.iinfo(np.int32).max
#: A run of more symbols is merged place by place from sorted lists: rounds over it would cost its square.
LONG_RUN = 256
_RUNS = re.compile(" +[^ ]*")


class PieceModel:
    """The merge table of a sentencepiece BPE model with byte fallback, as sorted arrays.

    A symbol is a number: the pieces come first, then single characters that occur only inside longer pieces. A pair's
    rank is that of the piece it spells, equal scores having equal ranks.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("not a BPE model with byte fallback, identity normalisation and a dummy prefix")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == NORMAL]
        if any(p.type not in (NORMAL, BYTE, 2, 3) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("user-defined or unused pieces, or spaces inside a piece")
        level = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        rank = {p: level[s] for p, s in pieces}
        number = {p: i for i, (p, _) in enumerate(pieces)}
        self.known = len(number)
        for c in sorted({c for p in rank for c in p} - number.keys()):
            number[c] = len(number)
        self.width = len(number) + 1  # the last number is any other character
        self.symbol = {ord(p): i for p, i in number.items() if len(p) == 1}
        pairs = {number[p[:i]] * self.width + number[p[i:]]: (level, number[p]) for p, level in rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_out = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        inside = {number[p[i]] * self.width + number[p[i + 1]] for p in rank for i in range(len(p) - 1)}
        self.inside = np.array(sorted(inside), np.int64)
        held = np.bincount(list(rank.values()), minlength=len(level)) == 1
        for p, r in rank.items():  # a rank is safe if no piece that holds its piece comes before it
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if (inner := rank.get(p[i:j])) is not None and inner >= r and j - i < len(p):
                        held[inner] = False
        self.safe = held
        self.code = np.full(0x110000, self.width - 1, np.int32)
        self.code[list(self.symbol)] = list(self.symbol.values())
        self.pairs: dict[int, tuple[int, int]] | None = None  # made when a long run comes

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], NO_RANK), self.pair_out[at]

    def _spanned(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        return self.inside[np.minimum(np.searchsorted(self.inside, keys), len(self.inside) - 1)] == keys

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each string, spaces already written as SPACE. All strings are merged at the same time: in each
        round every string applies its lowest-ranked pair, all places of it at once where that gives what one place
        after the other gives.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), lengths)
        sym = self.code[points]
        utf8 = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.bincount(owner, np.where(sym < self.known, 0, utf8), len(words)).astype(np.int64)
        # Cut where no piece spans two neighbours: each run is then merged on its own.
        inner = self._spanned(sym[:-1], sym[1:]) & (owner[1:] == owner[:-1])
        run = np.r_[0, np.cumsum(~inner)][: len(sym)]
        alone = (np.r_[True, ~inner] & np.r_[~inner, True])[: len(sym)]
        out += np.bincount(owner[alone & (sym < self.known)], minlength=len(words))
        sym, run, owner = sym[~alone], run[~alone], owner[~alone]
        edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True][: len(run) + 1]) if len(run) else np.zeros(1, np.int64)
        long = np.flatnonzero(np.diff(edges) > LONG_RUN)
        if len(long):
            stays = np.ones(len(sym), bool)
            for a, b in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
                out[owner[a]] += self._merged_long(sym[a:b])
                stays[a:b] = False
            sym, run, owner = sym[stays], run[stays], owner[stays]
        rank, made = self._fresh(sym, run)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            ended = least == NO_RANK
            if ended.any():
                gone = np.repeat(ended, sizes)
                out += np.bincount(owner[gone & (sym < self.known)], minlength=len(words))
                sym, run, owner, rank, made = (x[~gone] for x in (sym, run, owner, rank, made))
                least, sizes = least[~ended], sizes[~ended]
                if not len(sym):
                    break
            places = np.flatnonzero(rank == np.repeat(least, sizes))
            runs = run[places]
            first = np.r_[True, runs[1:] != runs[:-1]]
            fresh = np.r_[True, places[1:] != places[:-1] + 1] | first
            step = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[np.where(self.safe[rank[places]], step % 2 == 0, first)]
            sym[places] = made[places]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
            now = places - np.arange(len(places))
            sym, run, owner, rank, made = (x[keep] for x in (sym, run, owner, rank, made))
            for at in (now, now[now > 0] - 1):
                at_next = np.minimum(at + 1, len(sym) - 1)
                r, m = self.ranks(sym[at], sym[at_next])
                rank[at] = np.where((at + 1 < len(sym)) & (run[at] == run[at_next]), r, NO_RANK)
                made[at] = m
        return out

    def _merged_long(self, sym: np.ndarray) -> int:
        """Known symbols that a run ends as. Places of one rank are swept from left to right, in a linked list; what a merge
        makes is put off to its own rank's sweep, or comes at once if it is before the sweep's next place: n log n steps.
        """
        if self.pairs is None:
            self.pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_out.tolist(), strict=True), strict=True))
        rank, made = self._fresh(sym, np.zeros(len(sym), np.int64))
        order = np.argsort(rank, kind="stable")
        ranks, firsts = np.unique(rank[order], return_index=True)
        sweeps = {int(r): p.tolist() for r, p in zip(ranks, np.split(order, firsts[1:]), strict=True) if r != NO_RANK}
        waiting = list(sweeps)
        heapq.heapify(waiting)
        end, width, get = len(sym), self.width, self.pairs.get
        ids, rank, made = sym.tolist(), rank.tolist(), made.tolist()
        after, before = [*range(1, end + 1)], [*range(-1, end - 1)]
        urgent: list[tuple[int, int]] = []
        while waiting:
            now = heapq.heappop(waiting)
            places, i = sorted(sweeps.pop(now)), 0
            while urgent or i < len(places):
                if urgent and (i == len(places) or urgent[0] < (now, places[i])):
                    r, at = heapq.heappop(urgent)
                else:
                    r, at, i = now, places[i], i + 1
                if rank[at] != r:  # merged meanwhile, or another pair
                    continue
                ids[at] = made[at]
                gone = after[at]
                rank[gone] = -1
                after[at] = follows = after[gone]
                if follows < end:
                    before[follows] = at
                for left in (before[at], at):
                    if left < 0 or (right := after[left]) >= end:
                        if left == at:
                            rank[at] = NO_RANK
                        continue
                    found = get(ids[left] * width + ids[right])
                    if found is None:
                        rank[left] = NO_RANK
                        continue
                    rank[left], made[left] = found
                    if found[0] <= now:
                        heapq.heappush(urgent, (found[0], left))
                    elif (later := sweeps.get(found[0])) is not None:
                        later.append(left)
                    else:
                        sweeps[found[0]] = [left]
                        heapq.heappush(waiting, found[0])
        at = count = 0
        while at < end:
            count += ids[at] < self.known
            at = after[at]
        return count

    def _fresh(self, sym: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), NO_RANK, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            r, m = self.ranks(sym[:-1], sym[1:])
            rank[:-1] = np.where(run[1:] == run[:-1], r, NO_RANK)
            made[:-1] = m
        return rank, made


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


_seen: dict[str, dict[str, int]] = {}


def count_tokens(path: str, texts: Iterable[str]) -> list[int]:
    """Tokens of each text without begin or end tokens. A text is a row of words, each with the spaces before it; no
    piece crosses from a word to the next word's spaces, so each distinct word is merged once.
    """
    model, cache = piece_model(path), _seen.setdefault(path, {})
    split = []
    for text in texts:
        text = text.replace(SPACE, " ")
        split.append([w[1:] for w in _RUNS.findall(f" {text}")] if text[:1] == " " or "  " in text else text.split(" ") if text else [])
    wanted = set().union(*split)
    if len(cache) + len(wanted) > CACHE_WORDS:
        cache.clear()
    missing = list(wanted - cache.keys())
    for i in range(0, len(missing), 50_000):
        part = missing[i : i + 50_000]
        cache.update(zip(part, model.counts([f" {w}".replace(" ", SPACE) for w in part]).tolist(), strict=True))
    found = [sum(map(cache.__getitem__, words)) for words in split]
    for w in missing:
        if len(w) > LONGEST_KEPT:
            del cache[w]
    return found


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row. A null or empty text has no byte and no token; repeated rows
    stay repeated; an empty table gives an empty one. Texts are read whole; a long text is one list of words.
    """
    kind = dict(docs.dtypes)[key]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [x or b"" for x in as_bytes(batch.column(1))]
        tokens = pa.array(count_tokens(model_path, [x.decode("utf-8", "replace") for x in raw]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), tokens], names=["key", "n_bytes", "n_tokens"])

    rows = map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
