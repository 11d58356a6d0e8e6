"""Queries of the job queue, retries, rate limits, conversations; batch replays of Structured Streaming included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources import tables as T
from ..streaming import ratelimit, sessions
from .base import query


@query("str1_jn12_so5_claim_jobs", T.sql("SELECT source_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at NULLS FIRST, job_id) AS rn FROM job WHERE status = 'QUEUED' AND source_id NOT IN (SELECT source_id FROM job WHERE status = 'RUNNING')) WHERE rn = 1", "job"))
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claimable(T.jobs(spark, sf_dir)).select("source_id", "job_id")


@query("str3_sc34_retry_decisions", T.sql("SELECT job_id, status, attempts, CASE WHEN status = 'QUEUED' AND failure_kind <> 'worker_abandoned' THEN CAST(least(600 * pow(2, attempts - 1), 3600) AS BIGINT) END AS wait FROM (SELECT job_id, failure_kind, attempt_count + 1 AS attempts, CASE WHEN failure_kind NOT IN ('rate_limited', 'tika_unavailable', 'worker_abandoned') THEN 'FAILED' WHEN attempt_count + 1 >= 4 THEN 'DEAD_LETTER' ELSE 'QUEUED' END AS status FROM job WHERE failure_kind IS NOT NULL)", "job"))
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.jobs(spark, sf_dir).where("failure_kind IS NOT NULL").select("job_id", J.decide(F.col("failure_kind"), F.col("attempt_count")).alias("d")).select("job_id", "d.*")


@query("str2_stale_jobs", T.sql("SELECT job_id FROM job WHERE status = 'RUNNING' AND started_at < TIMESTAMP '2024-01-15 00:00:00'", "job"))
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.jobs(spark, sf_dir).where("status = 'RUNNING' AND started_at < timestamp_ntz'2024-01-15 00:00:00'").select("job_id")


OUTCOMES = "SELECT job_id, CASE WHEN failure_kind IS NULL THEN 'INDEXED' ELSE 'FAILED' END AS outcome, failure_kind AS kind FROM job WHERE status = 'RUNNING'"


@query("str4_complete_job", T.sql("", "job").rstrip() + f""", told AS ({OUTCOMES}), d AS (SELECT j.*, outcome, kind, coalesce(kind IN ('rate_limited', 'tika_unavailable', 'worker_abandoned'), FALSE) AS again, attempt_count + 1 AS made FROM job j LEFT JOIN told USING (job_id)),
s AS (SELECT *, CASE WHEN outcome IS NULL THEN status WHEN outcome <> 'FAILED' THEN outcome WHEN NOT again THEN 'FAILED' WHEN made >= 4 THEN 'DEAD_LETTER' ELSE 'QUEUED' END AS new_status FROM d)
SELECT job_id, new_status AS status, CASE WHEN outcome IS NULL THEN failure_kind ELSE kind END AS failure_kind, CASE WHEN outcome = 'FAILED' THEN made ELSE attempt_count END AS attempt_count,
       CASE WHEN outcome = 'FAILED' AND new_status = 'QUEUED' AND kind <> 'worker_abandoned' THEN CAST(least(600 * pow(2, made - 1), 3600) AS BIGINT) END AS wait FROM s""")
def complete_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after all running jobs have ended, those with a failure as failed."""
    jobs = T.jobs(spark, sf_dir)
    ended = jobs.where("status = 'RUNNING'").select("job_id", F.when(F.col("failure_kind").isNull(), "INDEXED").otherwise("FAILED").alias("outcome"), F.col("failure_kind").alias("kind"))
    return J.completed(jobs, ended).select("job_id", "status", "failure_kind", "attempt_count", "wait")


#: Before: the oldest version of each source is its current one. Ready: of each source the newest that is stale; some have none.
BEFORE = "pointer AS (SELECT source_id, min(version_id) AS current_version, TRUE AS is_active FROM version GROUP BY ALL), ready AS (SELECT source_id, max(version_id) AS new_version FROM version WHERE status = 'STALE' GROUP BY ALL), moved AS (SELECT p.*, new_version FROM pointer p LEFT JOIN ready USING (source_id))"


def _cutover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = T.versions(spark, sf_dir).select("version_id", "source_id", "status")
    pointer = v.groupBy("source_id").agg(F.min("version_id").alias("current_version")).withColumn("is_active", F.lit(True))
    return J.cutover(v, pointer, v.where("status = 'STALE'").groupBy("source_id").agg(F.max("version_id").alias("new_version")))


@query("str5_cutover_versions", T.sql("", "version").rstrip() + f", {BEFORE} SELECT version_id, CASE WHEN version_id = new_version THEN 'INDEXED' WHEN new_version IS NOT NULL AND version_id = current_version THEN 'STALE' ELSE status END AS status FROM version JOIN moved USING (source_id)")
def cutover_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutover(spark, sf_dir)[0].select("version_id", "status")


@query("str5_str17_cutover_sources", T.sql("", "version").rstrip() + f", {BEFORE} SELECT source_id, coalesce(new_version, current_version) AS current_version, source_id NOT LIKE '%/7' AS is_active FROM moved")
def cutover_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' pointers after the cutover, and one shelf of each site deleted softly."""
    moved = _cutover(spark, sf_dir)[1]
    return J.soft_deleted(moved, moved.where("source_id LIKE '%/7'").select("source_id"))


@query("str5_str17_cutover", T.sql("SELECT v.version_id, CASE WHEN v.version_id = s.current_version THEN 'INDEXED' ELSE 'STALE' END AS status, s.is_active FROM version v JOIN source s USING (source_id)", "version", "source"))
def cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = T.versions(spark, sf_dir).drop("status").join(T.sources(spark, sf_dir), "source_id")
    return joined.select("version_id", F.when(F.col("version_id") == F.col("current_version"), "INDEXED").otherwise("STALE").alias("status"), "is_active")


RATE = "SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) - CAST(epoch(ts) AS BIGINT) % 86400 AS window_start, row_number() OVER (PARTITION BY user_id, CAST(epoch(ts) AS BIGINT) // 86400 ORDER BY ts, event_id) AS n, ts FROM events"


@query("str7_sc35_sc36_rate_limit", f"SELECT user_id, event_id, window_start, n > 2 AS rejected, CASE WHEN n > 2 THEN greatest(1, window_start + 86400 - CAST(floor(epoch(ts)) AS BIGINT)) END AS retry_after FROM ({RATE.replace('CAST(epoch(ts) AS BIGINT)', 'CAST(floor(epoch(ts)) AS BIGINT)')})")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.rate_limited(events, 86400, 2).select("user_id", "event_id", "window_start", "rejected", F.col("retry_after").cast("long").alias("retry_after"))


@query("str8_str18_tumbling_counts", "SELECT user_id, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming query over the stored events, run to its end; same rows as the batch form."""
    return ratelimit.replay_counts(spark, f"{sf_dir}/events.parquet", 900)


@query("str8_bucket_sweep", "WITH b AS (SELECT user_id, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM b WHERE window_start >= (SELECT max(epoch(ts)) - 86400 FROM events)")
def bucket_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep of buckets more than a day older than the newest event leaves."""
    ts = F.col("ts").cast("timestamp")
    events = T.read(spark, sf_dir, "events")
    buckets = events.groupBy("user_id", (F.floor(F.unix_micros(ts) / 900e6) * 900).cast("long").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    newest = events.agg((F.max(F.unix_micros(ts)) / 1e6 - 86400).alias("cutoff"))  # one row
    return ratelimit.swept(buckets.crossJoin(newest), F.col("cutoff")).drop("cutoff")


@query("str18_sliding_windows", "SELECT user_id, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) - k * 900 AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts in windows of an hour that begin every quarter, as a stream run to its end."""
    return ratelimit.replay_counts(spark, f"{sf_dir}/events.parquet", 3600, 900)


@query("str18_session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of events less than six hours apart."""
    events = T.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.unix_seconds("w.start").alias("session_start"), "n")


@query("str12_idempotent_insert", "SELECT user_id, event_type, min(event_id) AS kept, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("wn7_str11_bounded_history", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chars FROM t WHERE back <= 4) SELECT conv_id, turn, CAST(chars AS BIGINT) AS chars FROM s WHERE chars <= 4000")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    chars = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    last = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", back.alias("back")).where("back <= 4")
    return last.select("conv_id", "turn", chars.alias("chars")).where("chars <= 4000")


@query("wn14_scope_sequence", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def scope_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return T.read(spark, sf_dir, "events").select("user_id", "event_id", n.cast("long").alias("seq"))


@query("str14_token_reuse_revokes", "SELECT user_id, count(*) AS n, bool_or(event_type = 'error') AS revoked, min(event_id) FILTER (WHERE event_type = 'error') AS reused_at FROM events GROUP BY user_id")
def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reused = F.when(F.col("event_type") == "error", F.col("event_id"))
    return T.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("revoked"), F.min(reused).alias("reused_at"))


@query("str14_refresh_rotation", """WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS family FROM events)
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'issued' WHEN family = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, family ORDER BY ts, event_id) > 0 THEN 'reuse' ELSE 'rotated' END AS outcome FROM s""")
def refresh_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups log in, errors present a spent token, all other events the newest one."""
    events = T.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kind = F.col("event_type")
    return J.refresh_outcomes(events, kind == "signup", kind == "error").select("event_id", "outcome")


@query("str10_ticket_sessions")
def ticket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful ticket dialogues over the stored conversations' user turns."""
    return sessions.replay(spark, T.read(spark, sf_dir, "conversations").where("role = 'user'"))
