"""Job queue, retry and rate limits as pure column logic and batch transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Failures that usually pass, those that are retried at once, attempts, first and longest wait in seconds.
TRANSIENT, IMMEDIATE = ["rate_limited", "tika_unavailable", "worker_abandoned"], ["worker_abandoned"]
MOST_ATTEMPTS, BACKOFF_BASE, BACKOFF_MOST = 4, 600, 3600


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2), F.greatest(attempts, F.lit(1)) - 1), F.lit(BACKOFF_MOST)).cast("long")


def decide(kind: Column, attempts: Column) -> Column:
    """(status, attempts, wait) after a failure: a struct of the new status, the attempts made, and seconds to wait."""
    made, transient = attempts + 1, F.coalesce(kind.isin(*TRANSIENT), F.lit(False))
    status = F.when(~transient, "FAILED").when(made >= MOST_ATTEMPTS, "DEAD_LETTER").otherwise("QUEUED")
    wait = F.when((status == "QUEUED") & ~kind.isin(*IMMEDIATE), backoff_seconds(made))
    return F.struct(status.alias("status"), made.alias("attempts"), wait.alias("wait"))


def claimable(jobs: DataFrame) -> DataFrame:
    """Queued jobs whose source has no running job, the first of each source by (started_at nulls first, job_id)."""
    running = jobs.where("status = 'RUNNING'").select("source_id").distinct()
    ready = jobs.where("status = 'QUEUED'").join(running, "source_id", "left_anti")
    least = F.min(F.struct(F.col("started_at").isNotNull().alias("has_start"), "started_at", "job_id"))
    return ready.groupBy("source_id").agg(least.alias("j")).select("source_id", "j.job_id", "j.started_at")


def rate_limited(events: DataFrame, seconds: int, most: int, principal: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Each event with its tumbling window's start, its number in the window and whether it is over the limit. An event
    over the limit counts too.
    """
    start = (F.unix_seconds(F.col(ts)) - F.unix_seconds(F.col(ts)) % seconds).alias("window_start")
    rows = events.select(principal, event, ts, start)
    number = F.row_number().over(W.partitionBy(principal, "window_start").orderBy(ts, event))
    return rows.withColumn("n", number).withColumn("rejected", F.col("n") > most).withColumn("retry_after", F.when(F.col("rejected"), F.greatest(F.lit(1), F.col("window_start") + seconds - F.unix_seconds(F.col(ts)))))


def completed(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs (job_id, source_id, status, failure_kind, attempt_count, started_at) with outcomes (job_id, outcome, kind)
    written back, and wait, the seconds until the next attempt. A failure goes by decide(); any other outcome is the
    new status, and leaves the attempts as they were. Jobs without an outcome stay. outcomes holds a job once.
    """
    told = outcomes.select("job_id", F.col("outcome").alias("_outcome"), F.col("kind").alias("_kind"))
    rows = jobs.join(told, "job_id", "left").withColumn("_d", decide(F.col("_kind"), F.coalesce("attempt_count", F.lit(0))))
    failed, done = F.col("_outcome") == "FAILED", F.col("_outcome").isNotNull()
    return rows.select(
        "job_id", "source_id", F.when(failed, F.col("_d.status")).otherwise(F.coalesce("_outcome", "status")).alias("status"), F.when(done, F.col("_kind")).otherwise(F.col("failure_kind")).alias("failure_kind"),
        F.when(failed, F.col("_d.attempts")).otherwise(F.col("attempt_count")).alias("attempt_count"), "started_at", F.when(failed, F.col("_d.wait")).alias("wait"),
    )


def cutover(versions: DataFrame, sources: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions (version_id, source_id, status) and sources (source_id, current_version, is_active) after the ready versions
    (source_id, new_version; a source once) went live: the new one is INDEXED, the one it replaces STALE.
    """
    moved = sources.join(ready.select("source_id", "new_version"), "source_id", "left")
    marks = moved.where("new_version IS NOT NULL").select(F.explode(F.array(F.struct(F.col("new_version").alias("_id"), F.lit("INDEXED").alias("_status")), F.struct(F.col("current_version").alias("_id"), F.lit("STALE").alias("_status")))).alias("m")).select("m.*")
    marks = marks.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_status").alias("_status"))  # a version that was current already stays INDEXED
    left = versions.join(marks, F.col("version_id") == F.col("_id"), "left").select("version_id", "source_id", F.coalesce("_status", "status").alias("status"))
    return left, moved.select("source_id", F.coalesce("new_version", "current_version").alias("current_version"), "is_active")


def soft_deleted(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """sources with is_active false where gone (source_id) names them; nothing else changes."""
    marked = sources.join(gone.select("source_id", F.lit(True).alias("_gone")).distinct(), "source_id", "left")
    return marked.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*sources.columns)


def refresh_outcomes(events: DataFrame, login: Column, reused: Column, principal: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """events with outcome: issued at a login; rotated where the newest token is presented; reuse where a spent one is, and
    from there on, as all tokens of the principal are revoked, until the next login; unknown before the first one.
    """
    so_far = W.partitionBy(principal).orderBy(ts, event).rowsBetween(W.unboundedPreceding, 0)
    last = lambda when: F.max(F.when(when, F.struct(ts, event))).over(so_far)
    rows = events.withColumns({"_login": last(login), "_reuse": last(reused & ~login)})
    outcome = F.when(login, "issued").when(F.col("_login").isNull(), "unknown").when(F.col("_reuse") > F.col("_login"), "reuse").otherwise("rotated")
    return rows.withColumn("outcome", outcome).drop("_login", "_reuse")
