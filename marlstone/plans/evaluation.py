"""Queries of retrieval quality: recall, MRR, percentiles, threshold and margin sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.golden import containing
from ..operators.retrieval import score
from ..operators.statistics import nearest_ranks
from ..sources import tables as T
from .base import query

#: A query is one of the stated set; what it should find is any other vector of its label.
GOLDEN = "vec_id % 20 = 0"
ASKED = f"(SELECT count(*) FROM embeddings WHERE {GOLDEN})"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings")
    q = e.where(GOLDEN).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"), F.col("label").alias("q_label"))
    # a probe finds itself, so one more than the eight is taken
    found = score(e.select("vec_id", "label", "embedding"), q, k=9, by="vec_id").where("vec_id <> query_id").join(q.select(F.col("query_id").alias("q"), "q_label"), F.col("query_id") == F.col("q"))
    scored = found.select("query_id", "vec_id", "sim", (F.col("label") == F.col("q_label")).alias("expected"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where("rank <= 8")


RANKED = f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim, e.label = q.label AS expected FROM embeddings e, embeddings q WHERE q.{GOLDEN} AND e.vec_id <> q.vec_id)) WHERE rank <= 8)"
FOUND = f"{RANKED}, found AS (SELECT query_id, min(rank) FILTER (WHERE expected) AS first, max(sim) AS top FROM ranked GROUP BY ALL)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("expected"), F.col("rank"))).alias("first"), F.max("sim").alias("top"))


@query("ag15_ag16_recall_mrr", f"WITH {FOUND} SELECT count(*) AS n, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS recall_k, round(sum(coalesce(1.0 / first, 0.0)) / count(*), 4) AS mrr FROM found")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return _found(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), share(F.col("first") == 1).alias("recall_1"), share(F.col("first").isNotNull()).alias("recall_k"), F.round(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / F.count(F.lit(1)), 4).alias("mrr"))


@query("wn5_rank_of_first_expected", f"WITH {FOUND} SELECT query_id, first AS first_rank FROM found")
def first_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("query_id", F.col("first").cast("long").alias("first_rank"))


@query("ag17_ag18_nearest_rank_percentiles", f"WITH {FOUND}, s AS (SELECT list_sort(list(top)) AS a, count(*) AS n FROM found) SELECT round(a[CAST(round_even(0.1 * (n - 1), 0) AS INTEGER) + 1], 4) AS p10, round(a[CAST(round_even(0.5 * (n - 1), 0) AS INTEGER) + 1], 4) AS p50, round(a[CAST(round_even(0.9 * (n - 1), 0) AS INTEGER) + 1], 4) AS p90 FROM s")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_ranks(_found(spark, sf_dir), "top", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return found.agg(*(F.round(F.max(F.when(F.col("name") == p, F.col("value"))), 4).alias(p) for p in ("p10", "p50", "p90")))


SIDES = f"{RANKED}, side AS (SELECT query_id, expected, max(sim) AS top FROM ranked GROUP BY ALL), listed AS (SELECT expected, list_sort(list(top)) AS a, count(*) AS n FROM side GROUP BY ALL)"


@query("ag18_score_separation", f"WITH {SIDES} SELECT (SELECT round(a[1], 4) FROM listed WHERE expected) AS least_positive, (SELECT round(a[CAST(round_even(0.5 * (n - 1), 0) AS INTEGER) + 1], 4) FROM listed WHERE expected) AS median_positive, (SELECT round(a[CAST(round_even(0.5 * (n - 1), 0) AS INTEGER) + 1], 4) FROM listed WHERE NOT expected) AS median_negative, (SELECT round(a[n], 4) FROM listed WHERE NOT expected) AS most_negative, round((SELECT a[CAST(round_even(0.1 * (n - 1), 0) AS INTEGER) + 1] FROM listed WHERE expected) - (SELECT a[CAST(round_even(0.9 * (n - 1), 0) AS INTEGER) + 1] FROM listed WHERE NOT expected), 4) AS separation")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores of hits that were to be found against those of others, and how far the tenth percentile of the first
    lies over the ninetieth of the second.
    """
    side = _ranked(spark, sf_dir).groupBy("query_id", "expected").agg(F.max("sim").alias("top"))
    found = nearest_ranks(side, "top", {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "most": 1.0}, by=["expected"])
    at = lambda expected, name: F.max(F.when((F.col("expected") == expected) & (F.col("name") == name), F.col("value")))
    shown = {"least_positive": at(True, "least"), "median_positive": at(True, "median"), "median_negative": at(False, "median"), "most_negative": at(False, "most"), "separation": at(True, "p10") - at(False, "p90")}
    return found.agg(*(F.round(v, 4).alias(k) for k, v in shown.items()))


@query("ag19_threshold_sweep", f"WITH {RANKED}, t AS (SELECT unnest(range(0, 10)) / 20.0 AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(DISTINCT query_id) FILTER (WHERE expected AND sim >= threshold) AS kept, count(*) FILTER (WHERE NOT expected AND sim >= threshold) AS leaked FROM ranked, t GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = _ranked(spark, sf_dir).withColumn("threshold", F.explode(F.array(*(F.lit(i / 20.0) for i in range(10)))))
    over = F.col("sim") >= F.col("threshold")
    return swept.groupBy("threshold").agg(F.countDistinct(F.when(F.col("expected") & over, F.col("query_id"))).alias("kept"), F.count_if(~F.col("expected") & over).alias("leaked"))


@query("ag20_ag21_margin_sweep", f"WITH {RANKED}, m AS (SELECT unnest([0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3]) AS margin), s AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS best FROM ranked) SELECT CAST(margin AS DOUBLE) AS margin, count(DISTINCT query_id) FILTER (WHERE expected) AS kept, round(count(*) / {ASKED}, 4) AS mean_kept FROM s, m WHERE sim >= best - margin GROUP BY ALL")
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _ranked(spark, sf_dir).withColumn("best", F.max("sim").over(W.partitionBy("query_id")))
    swept = best.withColumn("margin", F.explode(F.array(*map(F.lit, (0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3))))).where(F.col("sim") >= F.col("best") - F.col("margin"))
    n = T.read(spark, sf_dir, "embeddings").where(GOLDEN).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = swept.groupBy("margin").agg(F.countDistinct(F.when(F.col("expected"), F.col("query_id"))).alias("kept"), F.count(F.lit(1)).alias("all"))
    return counted.crossJoin(F.broadcast(n)).select("margin", "kept", F.round(F.col("all") / F.col("n"), 4).alias("mean_kept"))


@query("src25_golden_passages", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION ALL SELECT b.item_id + 1000000, d.doc_id FROM (SELECT item_id, split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) AS text FROM benchmark) b JOIN documents d ON contains(d.text, b.text)")
def golden_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a golden passage whole, and those that contain two words of it."""
    items = T.read(spark, sf_dir, "benchmark").select("item_id", "text")
    words = F.concat_ws(" ", *(F.split_part("text", F.lit(" "), F.lit(i)) for i in (3, 4)))
    short = items.select((F.col("item_id") + 1_000_000).alias("item_id"), words.alias("text"))
    return containing(T.read(spark, sf_dir, "documents"), items.unionByName(short))
