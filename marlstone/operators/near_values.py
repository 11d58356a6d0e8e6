"""Near-duplicate values: a similarity join by rare runs of three characters, and the greedy choice in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_value
from ..sources.shared import written

#: Characters of a run, buckets in which runs are counted to tell the rare ones, and classes of characters that are counted.
RUN, BUCKETS, CHARACTERS = 3, 1 << 16, 64
#: Values of one key that meet in one task, pairs that are compared at one time, and links of a group that one task settles.
CELL, BLOCK_PAIRS, LOCAL_LINKS = 4_096, 1 << 19, 200_000
#: Values of a group that are settled first (then four times as many, and so on), and rows by which that is told.
WAVE, SAMPLE = 2_048, 20_000


def most_unmatched(length: np.ndarray, ratio: float) -> np.ndarray:
    """Characters, of both values together, that a value of some length and one that is near it can leave unmatched.

    A ratio is 2 M / T, of M matched of T characters, and M is the shorter length at most; so T is 2 length / ratio at
    most, and T - 2 M is (1 - ratio) T at most.
    """
    return np.floor((1 - ratio) * np.floor(2 * length / ratio + 1e-9) + 1e-9).astype(np.int64)


def _points(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, values), np.int64, len(values))


def runs_of(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(value, hash) of each run of RUN characters; a run's n-th occurrence in a value hashes with n."""
    points, n = _points(values)
    owner = np.repeat(np.arange(len(values)), n)
    place = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(place <= n[owner] - RUN)
    h = np.zeros(len(at), np.uint64)
    for i in range(RUN):
        h = _mix(h + points[at + i])
    order = np.lexsort((place[at], h, owner[at]))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])]
    index = np.arange(len(at))
    times = np.empty(len(at), np.uint64)
    times[order] = (index - np.maximum.accumulate(np.where(same, 0, index))).astype(np.uint64)
    return owner[at], _mix(h + times * np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_keys(values: list[str], ratio: float, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, run): the keys by which two near values meet, in one order of runs, the rarest first.

    An unmatched character takes RUN runs away at most. So of two near values' runs all but RUN * most_unmatched are
    common, and the first common one is among the first RUN * most_unmatched + 1 of either. A value with no more runs
    than that has all its runs, and run 0 besides, where such values meet. Values that leave nothing unmatched have no key.
    """
    owner, h = runs_of(values)
    n = np.fromiter(map(len, values), np.int64, len(values))
    free = most_unmatched(n, ratio)
    order = np.lexsort((h, frequency[(h % np.uint64(BUCKETS)).astype(np.int64)], owner))
    owner, h = owner[order], h[order]
    index = np.arange(len(owner))
    rank = index - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]], index, 0)) if len(owner) else index
    kept = (rank <= RUN * free[owner]) & (free[owner] > 0)
    short = np.flatnonzero((free > 0) & (np.maximum(n - RUN + 1, 0) <= RUN * free))
    return np.r_[owner[kept], short], np.r_[h[kept], np.zeros(len(short), np.uint64)]


def _counts(values: list[str]) -> np.ndarray:
    points, n = _points(values)
    owner = np.repeat(np.arange(len(values)), n)
    return np.bincount(owner * CHARACTERS + points % CHARACTERS, minlength=len(values) * CHARACTERS).reshape(len(values), CHARACTERS).astype(np.int32)


def candidate_pairs(values: list[str], sides: list[np.ndarray], ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values of one key that their lengths and their counts of characters let be near, and that differ in each
    of sides.
    """
    order = np.argsort(np.fromiter(map(len, values), np.int64, len(values)), kind="stable")
    n = np.fromiter(map(len, values), np.int64, len(values))[order]
    counts, sides = _counts(values)[order], [of[order] for of in sides]
    first = np.searchsorted(n, np.ceil(n * ratio / (2 - ratio) - 1e-9))  # of each value, the shortest that can be near it
    step = max(1, BLOCK_PAIRS // max(len(n), 1))
    for at in range(0, len(n), step):
        rows = np.arange(at, min(at + step, len(n)))
        low = int(first[rows[0]])
        columns = np.arange(low, int(rows[-1]) + 1)
        may = (columns[None] < rows[:, None]) & (columns[None] >= first[rows, None])
        for of in sides:
            may &= of[rows, None] != of[None, columns]
        i, j = np.nonzero(may)
        for k in range(0, len(i), BLOCK_PAIRS // 8):
            a, b = rows[i[k : k + BLOCK_PAIRS // 8]], columns[j[k : k + BLOCK_PAIRS // 8]]
            common = np.minimum(counts[a], counts[b]).sum(axis=1)
            near = 2 * common >= ratio * (n[a] + n[b]) - 1e-9
            yield order[a[near]], order[b[near]]


def near_pairs(rows: DataFrame, ratio: float, between: str | None = None) -> DataFrame:
    """(g, first, second) of values (g, value, low) of one group g whose matching ratio is at least `ratio`; first is the
    longer value, or the earlier of two as long. With between, a column of 0 and 1, only of values that differ in it.

    Values meet by keys (index_keys()) of their group and of lengths near each other. A key with more than CELL values is
    dealt to a grid of cells, each of which has the pairs of two parts; pairs that a cell lets through are made distinct,
    and only then compared as texts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount((runs_of(batch.column(0).to_pylist())[1] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    frequency = np.zeros(BUCKETS, np.int64)
    for r in rows.select("low").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    grown = np.log((2 - ratio) / ratio)  # of two near values the longer one is so much longer at most

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(2).to_pylist()
            owner, run = index_keys(low, ratio, frequency)
            band = np.floor(np.log(np.fromiter(map(len, low), np.int64, len(low))[owner] + 1e-9) / max(grown, 1e-9)).astype(np.int64)
            for step in (0, 1):  # band b holds values of the bands b - 1 and b
                took = batch.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(run.view(np.int64)), pa.array(band + step)], names=["g", "value", "low", "of", "run", "band"])

    key = ["g", "run", "band"]
    of = F.col(between) if between else F.lit(0)
    keys = rows.select("g", "value", "low", of.cast("int").alias("of")).mapInArrow(keyed, "g string, value string, low string, of int, run long, band long")
    keys = written(keys)
    crowded = keys.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts")).where("parts > 1")
    dealt = keys.join(crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("value"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": (F.col("own") < F.col("other")).cast("int")})

    def pairs(table: pa.Table) -> pa.Table:
        values, low = table.column("value").to_pylist(), table.column("low").to_pylist()
        sides = [table.column("side").to_numpy()] if table.column("a")[0] != table.column("b")[0] else []
        sides += [table.column("of").to_numpy()] if between else []
        place = np.empty(len(values), np.int64)
        place[sorted(range(len(values)), key=lambda i: (-len(values[i]), values[i]))] = np.arange(len(values))
        found = [*candidate_pairs(low, sides, ratio)] or [(np.zeros(0, np.int64),) * 2]
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        ahead = place[i] < place[j]
        take = [table.combine_chunks().take(pa.array(p)) for p in (np.where(ahead, i, j), np.where(ahead, j, i))]
        return pa.table({"g": take[0].column("g"), "first": take[0].column("value"), "second": take[1].column("value"), "low1": take[0].column("low"), "low2": take[1].column("low")})

    found = dealt.select(*key, "a", "b", "side", "of", "value", "low").groupBy(*key, "a", "b").applyInArrow(pairs, "g string, first string, second string, low1 string, low2 string").distinct()

    @F.pandas_udf("boolean")
    def near(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, f).ratio() >= ratio for f, s in zip(first, second, strict=True)], dtype=bool)

    return found.where(near("low1", "low2")).select("g", "first", "second")


def removed_by_choice(links: DataFrame) -> DataFrame:
    """(g, value) of the values that the greedy choice takes away: in order, a value goes if one that stays has a link to it.
    links (g, first, second), written; first comes before second.

    A group of at most LOCAL_LINKS links is settled in one task. In larger ones rounds settle all values at once that no
    open value stands before: they stay, their seconds go, and links of settled values are closed.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[str, list[str]] = {}
        for f, s in zip(pdf["first"], pdf["second"], strict=True):
            before.setdefault(s, []).append(f)
        gone: set[str] = set()
        for v in sorted(before, key=lambda v: (-len(v), v)):
            if any(f not in gone for f in before[v]):
                gone.add(v)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(gone), "value": sorted(gone)})

    out = None
    while True:
        sizes = links.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        small = links.join(sizes.where(F.col("n") <= LOCAL_LINKS), "g", "left_semi").groupBy("g").applyInPandas(settle, "g string, value string")
        out = small if out is None else out.unionByName(small)
        large = links.join(sizes.where(F.col("n") > LOCAL_LINKS), "g", "left_semi")
        if not large.head(1):
            return out
        large = written(large)
        seconds = large.select("g", F.col("second").alias("first"))
        heads = large.join(seconds, ["g", "first"], "left_anti").select("g", "second")
        gone = written(heads.distinct())
        out = out.unionByName(gone.withColumnRenamed("second", "value"))
        left = large.join(gone, ["g", "second"], "left_anti").join(gone.withColumnRenamed("second", "first"), ["g", "first"], "left_anti")
        links = written(left.select("g", "first", "second"))


def _named(group: Column) -> Column:
    """The group as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def collapse_near_duplicates(rows: DataFrame, ratio: float = 0.92) -> DataFrame:
    """(group, value) without restatements: longest first, a value goes if its matching ratio with one that stays is at
    least `ratio`. Values are compared as fold_value() gives them; of values that it makes equal the first one stands for
    all. Null values are none, a null group is a group, repeated rows are one, an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(fold_value)

    todo = rows.select(_named(F.col("group")).alias("g"), F.col("value").cast("string").alias("value")).where("value IS NOT NULL").distinct().withColumn("low", folded("value"))
    order = F.struct(-F.length("value"), F.col("value").alias("v"))
    left = written(todo.groupBy("g", "low").agg(F.min(order)["v"].alias("value")))
    kept, size = None, WAVE
    while True:
        cuts = _cuts(left, order, size)
        marked = left.join(cuts, "g", "left").withColumn("later", F.coalesce(order > F.col("cut"), F.lit(False))).drop("cut")
        wave, rest = marked.where(~F.col("later")).drop("later"), marked.where("later").drop("later")
        stay = wave.join(removed_by_choice(written(near_pairs(wave, ratio))), ["g", "value"], "left_anti")
        last = not rest.head(1)
        stay = stay if last else written(stay)
        kept = stay if kept is None else kept.unionByName(stay)
        if last:
            return kept.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("group"), "value")
        both = written(rest.withColumn("of", F.lit(1)).unionByName(stay.withColumn("of", F.lit(0)).join(rest.select("g").distinct(), "g", "left_semi")))
        gone = near_pairs(both, ratio, between="of").select("g", F.col("second").alias("value")).distinct()
        left = written(rest.join(gone, ["g", "value"], "left_anti"))
        size *= 4


def _cuts(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """(g, cut): for groups of more than `size` values, a value up to which there are about `size`, by a sample of about
    SAMPLE rows of all groups. It says only which values are settled first.
    """
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    drawn = F.when(F.pmod(F.xxhash64("g", "value"), F.lit(1 << 20)) < int(share * (1 << 20)), order)
    seen = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(drawn)).alias("s")).where(F.col("n") > size)
    return seen.select("g", F.try_element_at("s", (F.size("s") * size / F.col("n")).cast("int") + 1).alias("cut"))
