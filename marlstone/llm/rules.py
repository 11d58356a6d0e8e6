"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, read_table

GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Words of a window; a repeat is a window found twice or more in one text.
WINDOW = 8


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more. hashes[i] is the window from word i."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
    twice = lambda a: F.filter(a, lambda x, i: same(a, i, i - 1) | same(a, i, i + 1))
    places = lambda a: F.sort_array(F.transform(twice(a), lambda x: x["i"]))
    gaps = lambda p: F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1))))
    total = lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda a, x: a + x)
    # One-element transforms bind an array to a name, so that it is made once for each row.
    bind = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))
    return bind(placed, lambda a: bind(places(a), total))


def measures(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; no shuffle."""
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.select(
        "key",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(0)
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    return rows.select("key", "host", "n_words", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) of the failure rates of hosts (n, failed), by weighted moments: the variance between hosts is what
    exceeds that of draws at one common rate. Two numbers come to the driver. No host: an even prior of weight two.
    """
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    if not sums.n or not 0 < sums.f < sums.n:
        return 1.0, 1.0
    mean = sums.f / sums.n
    within = mean * (1 - mean)
    between = (sums.q / sums.n - mean * mean) - within * max(sums.k - 1, 0) / sums.n
    weight = min(max(within / max(between, 1e-9) - 1, 2.0), 1e6)
    return mean * weight, (1 - mean) * weight


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 20, most_repeat: int = 30, most_rate: float = 0.5) -> DataFrame:
    """Every row's measures, base_failed, the shrunk failure rate of its host, and kept.

    A row fails the base rules if it has fewer than least_words words, or over most_repeat percent of its words lie in
    repeated windows. A host is rejected if its failure rate, shrunk towards the empirical beta prior of all hosts, is
    over most_rate; kept is false for rows that fail and for all rows of a rejected host. Null and empty texts have no
    word, so they fail; rows with a null host are one host; repeated rows and null keys stay; an empty table gives an
    empty one. Failures are summed before the shuffle by host, and rows that are joined back hold numbers only.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    rows = cut(measures(docs, key, text, host).withColumn("base_failed", failed))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    rates = hosts.select(F.col("host").alias("of_host"), ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most_rate))
    name = free_name(joined, key)
    return joined.withColumnRenamed("key", name).withColumnRenamed(name, key)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT row_no, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM (SELECT row_no, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
repeated AS (
  SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, gram) >= 2),
covered AS (
  SELECT row_no, count(DISTINCT i + j) AS n FROM repeated, range(8) AS t(j) GROUP BY row_no),
measured AS (
  SELECT words.row_no, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered ON words.row_no = covered.row_no),
rules AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS failed
  FROM rules GROUP BY source),
sums AS (
  SELECT count(*) AS k, sum(n) AS n, sum(failed) AS f, sum(failed * failed / n) AS q FROM hosts),
moments AS (
  SELECT *, f / n AS mean, f / n * (1 - f / n) AS within,
         q / n - f / n * f / n - f / n * (1 - f / n) * greatest(k - 1, 0) / n AS between_hosts FROM sums),
prior AS (
  SELECT CASE WHEN f > 0 AND f < n THEN mean * weight ELSE 1 END AS alpha,
         CASE WHEN f > 0 AND f < n THEN (1 - mean) * weight ELSE 1 END AS beta
  FROM (SELECT *, least(greatest(within / greatest(between_hosts, 1e-9) - 1, 2), 1e6) AS weight FROM moments))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed,
       NOT base_failed AND (failed + alpha) / (hosts.n + alpha + beta) <= 0.5 AS kept
FROM rules JOIN hosts ON rules.source IS NOT DISTINCT FROM hosts.source, prior
"""
