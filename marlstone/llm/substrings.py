"""Substring deduplication by relative Lempel-Ziv parsing, in blocks of reference text.

The reference of a document is what stands in documents with smaller keys. It is indexed in blocks: each window of
`window` words belongs to the block of its least `anchor`-word hash, so that equal windows always meet in one block,
whichever documents hold them, and a document needs to be parsed against those blocks only where its own windows lie.
A stretch of windows with one anchor is parsed from left to right: where a window stands in the block's reference, a
factor begins; it is copied from the earliest document that has this window and goes on as long as the source does.
Where it ends, the next window, which lies across the factor's boundary, is looked up again. Factors of all blocks are
joined for each document; any of them is at least `window` words long and is a duplicate span.

Windows are compared within their block by 72 bits of two hashes of different kinds, not by their bytes: of 10^13
different windows in blocks of BLOCK_BYTES no pair is expected to agree by chance (one in 180 such corpora has one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, free_name, read_table, release_memory, shuffle_width, text_slices

#: Bytes of text that are hashed at one time, that one chunk's index holds, and that a block holds on average at most.
SLICE_BYTES, CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 12 << 20, 32 << 20
#: Blocks for each shuffle partition at least, so that partitions come out even.
BLOCKS_PER_PARTITION = 4
#: Bytes of a window's second hash.
CHECK_BYTES = 1
#: A stretch holds at most so many windows.
STRETCH = 32
#: Bytes of text that frequent anchors are looked for in. They only say where windows meet, not what is found.
SAMPLE_BYTES = 64 << 20
_ODD, _ODD_TOO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _is_gap(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _is_gap(data)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, and where they start. A word's hash is a polynomial of its bytes."""
    starts, ends = _word_places(data)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    widths = ends - starts
    owner_start = np.repeat(starts, widths)
    at = np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))
    powers = np.multiply.accumulate(np.full(int(widths.max()) + 1, _ODD, np.uint64))
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers[at - owner_start]
    return _mix(np.add.reduceat(terms, np.cumsum(widths) - widths) + widths.astype(np.uint64)), starts


def _word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and each text's number of words. Bytes are hashed in pieces that end at a gap, so that
    a very long text takes little more memory than itself.
    """
    joined = b" ".join(t or b"" for t in texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and not (near := np.flatnonzero(_is_gap(data[end - 1 : end + SLICE_BYTES]))[:1]).size:
            end += SLICE_BYTES
        if end < len(data):
            end += int(near[0])
        h, s = _hash_words(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(np.r_[0, np.searchsorted(starts, np.cumsum(lengths))])


def _rolling(h: np.ndarray, width: int, odd: int = _ODD) -> np.ndarray:
    """Hash of each run of `width` entries, by Horner's rule."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * np.uint64(odd) + h[j : j + n]
    return _mix(out)


def _check_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A second hash of each run of `width` words, of another kind: xor of rotated and mixed word hashes, CHECK_BYTES of it."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        other = _mix(h * np.uint64(_ODD_TOO) + np.uint64(1))
        for j in range(width):
            part, k = other[j : j + n], np.uint64(5 * j % 63 + 1)
            out ^= (part << k) | (part >> (np.uint64(64) - k))
    return (out >> np.uint64(64 - 8 * CHECK_BYTES)).astype(np.uint32)


def _sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` entries, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[: len(a) - step], a[step:])
        have += step
    return a


#: Window hashes and their second hashes.
Windows = tuple[np.ndarray, np.ndarray]


def _windows(texts: list[bytes | None], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Windows]:
    """Of all windows of some texts: anchor, text, place in the text, and hashes."""
    hashes, counts = _word_hashes(texts)
    have = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), have)
    local = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have)
    at = (np.cumsum(counts) - counts)[text] + local
    if not len(at):
        return np.empty(0, np.uint64), text, local, (np.empty(0, np.uint64), np.empty(0, np.uint32))
    anchors = _sliding_least(_rolling(hashes, anchor), window - anchor + 1)
    return anchors[at], text, local, (_rolling(hashes, window)[at], _check_hash(hashes, window)[at])


_HEAD = np.dtype([("order", "<i8"), ("row", "<u4"), ("first", "<u4"), ("size", "u1")])
#: A factor, by windows: `count` of them from `start` on stand in document `source` from its window `at` on.
_FACTOR = np.dtype([("order", "<i8"), ("row", "<u4"), ("start", "<u4"), ("count", "<u4"), ("source", "<i8"), ("at", "<u4")])


def _planes(column: np.ndarray) -> bytes:
    """A column byte by byte: all first bytes, then all second ones, and so on. The shuffle compresses that better."""
    return np.ascontiguousarray(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T).tobytes()


def _pack(head: np.ndarray, windows: Windows) -> bytes:
    """A payload: number of stretches, their heads column by column, then their windows' hashes."""
    check = windows[1].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :CHECK_BYTES]
    return np.array([len(head)], "<u8").tobytes() + b"".join(_planes(head[n]) for n in _HEAD.names) + windows[0].astype("<u8").tobytes() + np.ascontiguousarray(check).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, Windows]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    head, at = np.empty(n, _HEAD), 8
    for name in _HEAD.names:
        width = _HEAD[name].itemsize
        head[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(_HEAD[name]).ravel()
        at += n * width
    many = (len(raw) - at) // (8 + CHECK_BYTES)
    check = np.zeros((many, 4), np.uint8)
    check[:, :CHECK_BYTES] = np.frombuffer(raw, np.uint8, CHECK_BYTES * many, at + 8 * many).reshape(-1, CHECK_BYTES)
    return head, (np.frombuffer(raw, "<u8", many, at), check.view("<u4").ravel())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _first_equal(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For each entry the first one with the same key and check. One sort of one array, but for keys that agree where
    the checks don't.
    """
    at = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[at[1:]] != key[at[:-1]]
    differs = check[at[1:]] != check[at[:-1]]
    if (differs & ~new[1:]).any():
        at = np.lexsort((check, key))
        new[1:] = (key[at[1:]] != key[at[:-1]]) | (check[at[1:]] != check[at[:-1]])
    starts = np.flatnonzero(new)
    out = np.empty(len(at), np.int64)
    out[at] = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
    return out


def _parse(head: np.ndarray, windows: Windows) -> np.ndarray:
    """The greedy parse of all stretches of one block against the block: its factors. Stretches are in order of `order`,
    so that the first equal window is the earliest document's.

    All stretches are read at once, a window at a time: a stretch goes on with its factor if the source's next window is
    its own next one, else it looks its window up.
    """
    key, check = windows
    size = head["size"].astype(np.int64)
    place = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(head)), size)
    first = _first_equal(key, check)
    order = head["order"][owner]
    earlier = order[first] < order
    source = np.full(len(head), -1)  # the window that each stretch's factor is copied from at present
    source_of, begins = np.full(len(key), -1), np.zeros(len(key), bool)
    for step in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero(size > step)
        at, last = place[live] + step, source[live]
        following = np.minimum(last + 1, len(key) - 1)
        goes_on = (last >= 0) & (last + 1 < len(key)) & (owner[following] == owner[last]) & (key[following] == key[at]) & (check[following] == check[at])
        now = np.where(goes_on, following, np.where(earlier[at], first[at], -1))
        begins[at] = ~goes_on
        source[live] = source_of[at] = now
    found = np.flatnonzero(source_of >= 0)
    starts = found[begins[found]]
    ends = np.r_[starts[1:], len(key)]
    out = np.empty(len(starts), _FACTOR)
    mine, theirs = owner[starts], owner[source_of[starts]]
    out["order"], out["row"], out["source"] = head["order"][mine], head["row"][mine], head["order"][theirs]
    out["start"] = head["first"][mine] + (starts - place[mine])
    out["at"] = head["first"][theirs] + (source_of[starts] - place[theirs])
    out["count"] = np.searchsorted(found, ends) - np.searchsorted(found, starts)
    return out


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places) of the entries of `to`."""
    if not len(to):
        return
    at = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.r_[True, to[at][1:] != to[at][:-1]])
    for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(at)].tolist(), strict=True):
        yield int(to[at[a]]), at[a:b]


def _dealt_factors(factors: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    to = (_mix(factors["row"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    return ((number, factors[at].tobytes()) for number, at in _dealt(to))


def _index(blocks: int, window: int, anchor: int, hot: np.ndarray):
    """Chunks of documents to payloads, one for each block. Windows of the anchors in `hot` go to blocks by their own
    hash. A stretch that repeats within a chunk goes to its block for its least document only; the others are factors
    already, and pass through a block.
    """

    def emit(parts: list[tuple[np.ndarray, np.ndarray, Windows]]) -> Iterator[pa.RecordBatch]:
        head, block = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        windows = tuple(np.concatenate([p[2][i] for p in parts]) for i in (0, 1))
        size = head["size"].astype(np.int64)
        place = np.cumsum(size) - size
        by = np.argsort(head["order"], kind="stable")
        inside = (np.arange(len(windows[0])) - np.repeat(place, size)).astype(np.uint64) + np.uint64(1)
        total = lambda w, spread: _mix(np.add.reduceat(_mix(w.astype(np.uint64) + spread) * _mix(inside), place)) if len(w) else np.empty(0, np.uint64)
        key, check = _mix(total(windows[0], np.uint64(0)) + size.astype(np.uint64)), total(windows[1], np.uint64(7))
        first = by[_first_equal(key[by], check[by])]
        same = np.empty(len(by), np.int64)
        same[by] = first
        repeated = head["order"] > head["order"][same]
        factors = np.empty(int(repeated.sum()), _FACTOR)
        for to, of, rows in (("order", "order", repeated), ("row", "row", repeated), ("start", "first", repeated), ("count", "size", repeated), ("source", "order", same[repeated]), ("at", "first", same[repeated])):
            factors[to] = head[of][rows]
        out = [(number, True, raw) for number, raw in _dealt_factors(_joined(factors), blocks)]
        keep = np.flatnonzero(~repeated)
        for number, at in _dealt(block[keep]):
            own = keep[at]
            n = _ranges(place[own], size[own])
            out.append((number, False, _pack(head[own], (windows[0][n], windows[1][n]))))
        kinds = (pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["block", "done", "payload"])

    def stretches(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Windows]:
        anchors, text, local, windows = _windows(as_bytes(piece.column(2)), window, anchor)
        is_hot = np.isin(anchors, hot)
        to = (np.where(is_hot, _mix(windows[0] + np.uint64(3)), anchors >> np.uint64(17)) % np.uint64(blocks)).astype(np.int64)
        new = np.ones(len(to), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | is_hot[1:]
        since = np.arange(len(to)) - np.maximum.accumulate(np.where(new, np.arange(len(to)), 0)) if len(to) else to
        starts = np.flatnonzero(new | (since % STRETCH == 0))
        head = np.empty(len(starts), _HEAD)
        order, row = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        head["order"], head["row"], head["first"], head["size"] = order[text[starts]], row[text[starts]], local[starts], np.diff(np.r_[starts, len(to)])
        return head, to[starts], windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in text_slices(batch, 2, SLICE_BYTES):
                parts.append(stretches(piece))
                held += 8 * len(parts[-1][2][0])
                if held > CHUNK_BYTES:
                    yield from emit(parts)
                    parts, held = [], 0
        if parts:
            yield from emit(parts)
        del parts
        release_memory()

    return run


def _factor(parts: int):
    """One block: all stretches of it, from all chunks, to factors, dealt by row."""

    def run(table: pa.Table) -> pa.Table:
        out, heads, keys, checks = [], [np.empty(0, _HEAD)], [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        for done, raw in zip(table.column("done").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if done:
                out += _dealt_factors(np.frombuffer(raw, _FACTOR), parts)
            else:
                h, (k, c) = _unpack(raw)
                heads.append(h)
                keys.append(k)
                checks.append(c)
        head, key, check = np.concatenate(heads), np.concatenate(keys), np.concatenate(checks)
        del heads, keys, checks
        by = np.lexsort((head["first"], head["row"], head["order"]))
        size = head["size"].astype(np.int64)
        at = _ranges((np.cumsum(size) - size)[by], size[by])
        out += _dealt_factors(_parse(head[by], (key[at], check[at])), parts)
        del head, key, check, by, size, at
        release_memory()
        return pa.table({"part": pa.array([n for n, _ in out], pa.int32()), "payload": pa.array([raw for _, raw in out], pa.binary())})

    return run


def _joined(factors: np.ndarray) -> np.ndarray:
    """Factors sorted by document and start; those that go on both in the document and in the source are one."""
    f = factors[np.lexsort((factors["start"], factors["row"], factors["order"]))]
    new = np.ones(len(f), bool)
    end = f["start"] + f["count"]
    new[1:] = (f["order"][1:] != f["order"][:-1]) | (f["row"][1:] != f["row"][:-1]) | (f["start"][1:] != end[:-1]) | (f["source"][1:] != f["source"][:-1]) | (f["at"][1:] != (f["at"] + f["count"])[:-1])
    starts = np.flatnonzero(new)
    out = f[starts]
    if len(starts):
        out["count"] = np.add.reduceat(f["count"], starts)
    return out


def _by_row(table: pa.Table) -> pa.Table:
    """The factors of some rows, from all blocks, to one binary for each row."""
    f = _joined(np.concatenate([np.frombuffer(raw, _FACTOR) for raw in table.column("payload").to_pylist()]))
    cuts = np.flatnonzero(np.r_[True, (f["row"][1:] != f["row"][:-1]) | (f["order"][1:] != f["order"][:-1])][: len(f)])
    raws = [f[a:b].tobytes() for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(f)].tolist(), strict=True)]
    return pa.table({"of_key": pa.array(f["order"][cuts]), "of_row": pa.array(f["row"][cuts].astype(np.int64)), "factors": pa.array(raws, pa.binary())})


def _covered(n_words: int, factors: bytes, window: int) -> np.ndarray:
    """Which words lie in a factor."""
    edge = np.zeros(n_words + 1, np.int64)
    f = np.frombuffer(factors, _FACTOR)
    start, count = f["start"].astype(np.int64), f["count"].astype(np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _hot_anchors(rows: DataFrame, total: int, blocks: int, window: int, anchor: int) -> np.ndarray:
    """Anchors that alone have more than a block's share of windows, by a sample of about SAMPLE_BYTES of text; there are
    fewer of them than blocks. The same windows meet whatever is found here.
    """
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, 0, 4 * SLICE_BYTES):
                found, n = np.unique(_windows(as_bytes(piece.column(0)), window, anchor)[0], return_counts=True)
                most = n > len(found) // (1 << 14)  # of a slice's anchors those that can matter, and their sum
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[found[most].view(np.int64), 0]), pa.array(np.r_[n[most], n.sum()]), pa.array(np.r_[np.ones(int(most.sum()), bool), False])], names=["anchor", "n", "one"])

    counted = drawn.select("text").mapInArrow(run, "anchor long, n long, one boolean").groupBy("anchor", "one").agg(F.sum("n").alias("n"))
    whole = counted.where("NOT one").agg(F.sum("n")).first()[0] or 0
    least = max(whole // blocks, 32)
    return np.sort(np.array([r[0] for r in counted.where(F.col("one") & (F.col("n") > least)).select("anchor").collect()], np.int64).view(np.uint64))


def duplicate_factors(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, anchor: int = 5) -> DataFrame:
    """(of_key, of_row, factors): of each row with a factor all of them as _FACTOR records; of_row tells rows
    of one key apart. See duplicate_spans() and remove_duplicate_spans().
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("order"), _row(key, text).alias("row"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(BLOCKS_PER_PARTITION * shuffle_width(docs.sparkSession), -(-total // BLOCK_BYTES))
    hot = _hot_anchors(rows, total, blocks, window, anchor)
    indexed = rows.mapInArrow(_index(blocks, window, anchor, hot), "block int, done boolean, payload binary")
    found = indexed.groupBy("block").applyInArrow(_factor(blocks), "part int, payload binary")
    return found.groupBy("part").applyInArrow(_by_row, "of_key long, of_row long, factors binary")


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, anchor: int = 5) -> DataFrame:
    """(key, start, n_words, source, source_start): the factors of each row's parse. n_words words from word `start` on
    also stand in the row with key `source`, a smaller one, from its word source_start on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                f = np.frombuffer(raw, _FACTOR)
                columns = [f["order"], f["start"].astype(np.int64), f["count"] + np.int64(window - 1), f["source"], f["at"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "start", "n_words", "source", "source_start"])

    spans = duplicate_factors(docs, key, text, window, anchor).select("factors").mapInArrow(run, "key long, start long, n_words long, source long, source_start long")
    return spans.withColumnRenamed("key", key)


def _row(key: str, text: str):
    """Tells rows with one key and different texts apart."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text)).bitwiseAND(F.lit((1 << 32) - 1))


def _cut_out(raw: bytes, starts: np.ndarray, ends: np.ndarray, stays: np.ndarray, layout: bool) -> bytes:
    """The text without the words that don't stay, one blank where words went. With layout, what lies between two words
    that stay next to each other is kept as it is.
    """
    edge = np.flatnonzero(np.diff(np.r_[False, stays, False].astype(np.int8)))
    runs = (raw[starts[a] : ends[b - 1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return b" ".join(runs if layout else (b" ".join(r.split()) for r in runs))


def _without_factors(raw: bytes, factors: bytes | None, window: int, layout: bool) -> tuple[int, int, bytes]:
    """A text's number of words, how many of them its factors cover, and the text without those."""
    if not factors:
        words = raw.split()
        return len(words), 0, raw if layout else b" ".join(words)
    starts, ends = _word_places(np.frombuffer(raw, np.uint8))
    stays = ~_covered(len(starts), factors, window)
    return len(starts), len(starts) - int(stays.sum()), _cut_out(raw, starts, ends, stays, layout)


def remove_duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, anchor: int = 5, layout: bool = False, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """docs, all columns, with each text's words that no duplicate window covers, and the two columns named in counts,
    a text's words and those removed (renamed with underscores in front where docs has such a column).

    A window of `window` words is a duplicate if the same words also start, as a window, in a row with a smaller key.
    All windows are judged on the input. The words that are left are joined by one blank; with layout, a text without a
    duplicate stays as it is, and others keep the white space between words that stay together.

    Keys are whole numbers. Texts shorter than a window, empty and null texts keep all their words (null: none, and an
    empty text); rows with equal keys are not earlier than one another, so repeated rows get equal results; rows with a
    null key come before and after nothing and stay whole; an empty table gives an empty one.
    """
    others = [c for c in docs.columns if c != text]
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    found = duplicate_factors(docs, key, text, window, anchor)
    rows = docs.select(*plain, F.col(key).cast("long").alias("key"), _row(key, text).alias("row"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(found.hint("shuffle_hash"), (F.col("key") == F.col("of_key")) & (F.col("row") == F.col("of_row")), "left")
    joined = joined.select(*(f"c{i}" for i in range(len(others))), "factors", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for piece in text_slices(batch, last):
                done = [_without_factors(raw or b"", f, window, layout) for raw, f in zip(as_bytes(piece.column(last)), piece.column(last - 1).to_pylist(), strict=True)]
                columns = [*piece.columns[: last - 1], *(pa.array([d[i] for d in done], pa.int64()) for i in (0, 1)), pa.array([d[2] for d in done], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[: last - 1], "n_words", "n_removed", "text"])

    kinds = dict(docs.dtypes)
    done = joined.mapInArrow(run, "".join(f"c{i} {kinds[c]}, " for i, c in enumerate(others)) + "n_words long, n_removed long, text string")
    place = {c: i for i, c in enumerate(others)}
    named = [F.col("text").alias(c) if c == text else F.col(f"c{place[c]}").alias(c) for c in docs.columns]
    return done.select(*named, *(F.col(c).alias(free_name(docs, name)) for c, name in zip(("n_words", "n_removed"), counts, strict=True)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_duplicate_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT row_no, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT row_no, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
duplicates AS (
  SELECT row_no, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id),
covered AS (
  SELECT DISTINCT row_no, i + j AS k FROM duplicates, range(13) AS t(j)),
placed AS (
  SELECT row_no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words WHERE len(w) > 0),
kept AS (
  SELECT row_no, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n
  FROM placed ANTI JOIN covered USING (row_no, k) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.row_no = kept.row_no
"""
