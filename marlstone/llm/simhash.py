"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import as_bytes, cut, free_name, map_texts, read_table
from .components import connected_components

BITS = 64
#: Groups of up to so many fingerprints are compared by shifted arrays, larger ones by a growing frontier.
SMALL_GROUP = 48
#: Rows of (block, fingerprint) that one grouping task takes on average.
ROWS_PER_TASK = 60_000


def _fingerprint(raw: bytes | None, width: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends[width - 1 :].tolist(), strict=False)
    hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in spans], np.uint64)
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)  # 255 ones still fit a byte
    padded[:n] = hashes
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp): fp is the 64-bit fingerprint as a signed long. Null and wordless texts have 0."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([_fingerprint(raw, width, seed) for raw in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    kind = dict(docs.dtypes)[key]
    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, fp long")


def block_scheme(n: int, distance: int) -> tuple[int, int]:
    """(blocks, kept): the bits are cut into `blocks` blocks; a pair within `distance` agrees on `blocks - distance` of
    them at least. The block count is the least that makes a key of those blocks longer than log2(n) + 2 bits, so that
    the groups stay small at any n. Exact for every n.
    """
    for blocks in range(distance + 1, distance + 9):
        kept = blocks - distance
        if BITS * kept // blocks >= math.log2(max(n, 2)) + 2:
            break
    return blocks, kept


def block_keys(fp: Column, blocks: int, kept: int) -> Column:
    """The array of block keys of a fingerprint: one hash for each choice of `kept` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(sum(masks[j] for j in choice))))) for i, choice in enumerate(combinations(range(blocks), kept))))


def _frontier_links(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that span the classes of one large group of distinct fingerprints, as their places, one for each that joins
    a class.
    """
    places = np.arange(len(fps))
    while len(places):
        queue, places = [int(places[0])], places[1:]
        while queue and len(places):
            at = queue.pop()
            near = np.bitwise_count(fps[places] ^ fps[at]) <= distance
            if near.any():
                queue.extend(found := places[near].tolist())
                yield from ((at, x) for x in found)
                places = places[~near]


def _group_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of verified links inside each run of equal keys; together they connect all that is within `distance`."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_GROUP))
    k, f = keys[small], fps[small]
    for step in range(1, min(SMALL_GROUP, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + step]) <= distance]
        a.append(small[near])
        b.append(small[near + step])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        found = np.array(list(_frontier_links(fps[starts[g] : starts[g] + sizes[g]], distance)), np.int64).reshape(-1, 2)
        a.append(starts[g] + found[:, 0])
        b.append(starts[g] + found[:, 1])
    return order[np.concatenate(a)], order[np.concatenate(b)]


def fingerprint_links(distinct_fps: DataFrame, n: int, distance: int = 4, node: str = "fp") -> DataFrame:
    """(a, b): verified links between distinct fingerprints (column fp), enough of them to connect every class. Each is
    named by its value of the column `node`.
    """
    blocks, kept = block_scheme(n, distance)
    tasks = max(1, -(-n * math.comb(blocks, kept) // ROWS_PER_TASK))
    kind = distinct_fps.schema[node].dataType
    rows = distinct_fps.select("fp", F.col(node).alias("node"), F.explode(block_keys(F.col("fp"), blocks, kept)).alias("key"))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))

    def run(table: pa.Table) -> pa.Table:
        a, b = _group_links(table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64), distance)
        nodes = table.column("node").combine_chunks()
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

    return rows.groupBy("task").applyInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component): every row of docs with its fingerprint and the least key its fingerprint's links reach.

    Null and empty texts share fingerprint 0 and are linked like any other; rows with a null key get the class of their
    fingerprint (null if no row in it has a key); repeated rows stay repeated; an empty table gives an empty one. Equal
    fingerprints are one node, so copies are never expanded into pairs; other columns of docs are not touched. A node is
    named by the least key of its rows, so that a class's least node names the class.
    """
    own = cut(fingerprints(docs, key, text, width))
    nodes = own.groupBy("fp").agg(F.min("key").alias("least"))
    nodes = cut(nodes.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("node")))
    classes = connected_components(fingerprint_links(nodes, nodes.count(), distance, "node"))
    linked = classes.select(F.col("node.fp").alias("fp"), F.col("component.least").alias("component"))
    alone = nodes.join(classes.select("node"), "node", "left_anti").select("fp", F.col("node.least").alias("component"))
    by_fp = cut(linked.unionByName(alone))
    return own.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates: the one with the least key (where rows have equal
    keys: the one whose text has the least hash). Rows with a null key can't be told apart by it; they stay.
    """
    keyed = docs.where(F.col(key).isNotNull())
    found = near_duplicates(keyed, key, text, width, distance)
    name = free_name(docs, "kept")
    kept = found.where(F.col(key) == F.col("component")).select(F.col(key).alias(name)).distinct().hint("shuffle_hash")
    out = keyed.join(kept, F.col(key) == F.col(name), "left_semi")
    if found.agg(F.count(F.lit(1)) - F.count_distinct(key)).first()[0]:
        of, least = free_name(docs, "of_key"), free_name(docs, "least_hash")
        value = F.struct(F.xxhash64(text), F.xxhash64(*(c for c, t in docs.dtypes if c != text and "map<" not in t)))
        first = out.groupBy(F.col(key).alias(of)).agg(F.min(value).alias(least))
        out = out.join(first, (F.col(key) == F.col(of)) & (value == F.col(least))).drop(of, least).dropDuplicates([key])
    return out.unionByName(docs.where(F.col(key).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
