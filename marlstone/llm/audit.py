"""Filter interaction audit: what five filters remove in every order, by a product of incidence matrices.

A document's failures are a mask of five bits. All that an order of the filters does to a document depends on its mask
alone, so each part (a value of the source column) is a histogram of 32 counts, and the outcome of all 120 orders and
their five steps is that row of counts times an integer matrix of 32 by 600.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
GAP = r"[\x20\x09-\x0D]+"
#: Parts whose outcomes (600 rows each) are written in one batch.
PARTS_A_BATCH = 64


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique_fails: 1 where a document of the mask (row) has that outcome at the order and
    step (column); steps of an order stand side by side.
    """
    bits = np.array([[1 << FILTERS.index(c) for c in o] for o in ORDERS], np.int64)
    before = np.cumsum(bits, axis=1) - bits
    bit, before = bits.reshape(1, -1), before.reshape(1, -1)
    mask = np.arange(MASKS, dtype=np.int64).reshape(-1, 1)
    fails, gone = mask & bit > 0, mask & before > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}
    return {k: v.astype(np.int64) for k, v in found.items()}


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text counts as empty. JVM functions only."""
    words = F.array_remove(F.split(text, GAP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_histograms(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail.

    Texts are compared by SHA-256, and go no further than the scan: what is shuffled is a key, a mask and a digest,
    summed first. Of equal texts all but those of the smallest key fail filter E; so the digest's smallest key is found
    by an aggregate, and joined by digest and key together, which no group of copies makes hot.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failures(F.col("text")).alias("mask"))
    rows = cut(rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    named = rows.where(F.col("id").isNotNull())
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    told = named.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    told = told.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << 4))
    nameless = rows.where(F.col("id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    columns = ["part", "mask", "n", "good", "toxic"]
    counted = told.select(columns).unionByName(nameless.select(columns))
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good"), weighed("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Filters: A under 200 words, B under half of the words distinct, C over two capitals in a hundred characters, D a
    sign of `#$%&*|`, E the text of a smaller key. Null and empty texts are equal and have no word; a null part is the
    empty one; a row with a null key never fails E, is no smaller key and has no label; rows that repeat a key with its
    text are copies of one document, so none is smaller; a key with several labels is good (toxic) if one of them is;
    an empty table gives an empty one. Other columns are not read.
    """
    histograms = mask_histograms(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    kind = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    letters = np.array([FILTERS.index(c) for o in ORDERS for c in o])
    filters = np.eye(len(FILTERS), dtype=np.int64)[letters]  # 600 by 5

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = outcome_matrices()
        steps = len(FILTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_A_BATCH):
                piece = batch.slice(at, PARTS_A_BATCH)
                cells, k = piece.column(1), piece.num_rows
                flat = cells.flatten()
                of = np.repeat(np.arange(k), cells.value_lengths().to_numpy(zero_copy_only=False))
                stacked = np.zeros((3, k, MASKS), np.int64)  # all, good, toxic
                for i, name in enumerate(("n", "good", "toxic")):
                    stacked[i, of, flat.field("mask").to_numpy(zero_copy_only=False)] = flat.field(name).to_numpy(zero_copy_only=False)
                every = {name: stacked[0] @ m for name, m in ways.items()}
                lost = stacked[1:] @ ways["removed"]
                shapley = (every["removed"] @ filters) @ filters.T
                columns = [*every.values(), lost[0], lost[1], shapley]
                names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(k, dtype=np.int32), len(letters)), piece.column(0)).dictionary_decode()
                orders = pa.array(np.tile(np.repeat(ORDERS, steps), k).tolist(), pa.string())
                place = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), k * len(ORDERS)))
                yield pa.RecordBatch.from_arrays([names, orders, place, *(pa.array(c.reshape(-1)) for c in columns)], names=[c.split()[0] for c in kind.split(", ")])

    return histograms.mapInArrow(outcomes, kind)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
failed AS (
  SELECT words.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [CASE WHEN len(w) < 200 THEN 'A' END,
          CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' END,
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
          CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY text) THEN 'E' END] AS f
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
classes AS (
  SELECT part, list_filter(f, lambda x: x IS NOT NULL) AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order
  FROM letters a, letters b, letters d, letters e, letters g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS c, string_split(substr(filter_order, 1, step - 1), '') AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
outcomes AS (
  SELECT part, filter_order, step, c, n, good, toxic, list_contains(f, c) AS fails, list_has_any(f, earlier) AS gone, f = [c] AS alone
  FROM classes, steps),
counted AS (
  SELECT part, filter_order, step, c,
         CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, c)
SELECT * EXCLUDE (c), CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM counted
"""
