"""Queries of uploads, confirmed crawls, event frames and cached discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import tables as T
from .base import query

FILES = "file AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' ELSE 'exe' END AS extension, coalesce(strlen(text), 0) AS n_bytes, sha256(text) AS checksum FROM documents)"


@query("src1_src19_validated_uploads", f"""WITH {FILES}, f AS (SELECT *, CASE WHEN extension = 'exe' THEN 'unsupported_type' WHEN n_bytes = 0 THEN 'empty' WHEN n_bytes > 20000 THEN 'too_large' END AS fault FROM file),
first AS (SELECT checksum, min(doc_id) AS first FROM f WHERE fault IS NULL GROUP BY ALL)
SELECT doc_id, 'manual_upload://' || doc_id || '.' || upper(extension) AS reference, CASE WHEN fault IS NOT NULL THEN fault WHEN f.checksum IN (SELECT checksum FROM file WHERE doc_id % 10 = 9) OR first < doc_id THEN 'duplicate' ELSE 'accepted' END AS decision FROM f LEFT JOIN first USING (checksum)""")
def validated_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four types, some of whose contents are stored already."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("PDF", "DOCX", "MD", "EXE"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = T.read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", F.col("doc_id").cast("string"), kind).alias("name"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"), F.sha2("text", 256).alias("checksum"))
    return S.validated(S.described(rows), rows.where("doc_id % 10 = 9"), key="doc_id", most_bytes=20_000).select("doc_id", "reference", "decision")


PAGES = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ftp' || url ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE html END AS html FROM pages"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    html = F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("html"))
    return S.confirmed(T.read(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html")))


ERRORS = f"SELECT *, CASE WHEN NOT regexp_matches(url, '(?i)^https?://[^/]') THEN 'bad_url' WHEN trim(html) = '' THEN 'empty_page' END AS error FROM ({PAGES})"


@query("src10_confirmed_crawl", f"SELECT page_id, error FROM ({ERRORS})")
def confirmed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).select("page_id", "error")


@query("src20_crawl_sink", f"SELECT page_id, sha256(html) AS checksum FROM ({ERRORS}) WHERE error IS NULL")
def crawl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_errors(_crawled(spark, sf_dir)).select("page_id", F.sha2("html", 256).alias("checksum"))


@query("src2_single_page", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'document' ELSE 'html' END AS branch FROM pages")
def single_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit(" Text/HTML; charset=utf-8"), F.lit("application/pdf"), F.lit("application/xhtml+xml"))
    return T.read(spark, sf_dir, "pages").select("page_id", S.branch(F.element_at(kinds, (F.col("page_id") % 3 + 1).cast("int"))).alias("branch"))


@query("src27_event_frames", "SELECT event_id, 'data: ' || CAST(to_json({'event': event_type, 'event_id': event_id, 'user_id': user_id}) AS VARCHAR) || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", S.frames(F.col("event_type"), "event_id", "user_id").alias("frame"))


@query("src24_discovery_cache", "SELECT user_id, max_by(props, (ts, props)) AS payload FROM events WHERE ts + INTERVAL 600 SECOND >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id")
def discovery_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = T.read(spark, sf_dir, "events").select("user_id", F.col("props").alias("payload"), F.col("ts").alias("stored_at"))
    return S.live_discoveries(cache, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query("src29_source_listing", T.sql("SELECT source_id, site, current_version FROM source ORDER BY current_version DESC", "version", "source"))
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sources(spark, sf_dir).select("source_id", "site", "current_version").orderBy(F.desc("current_version"))
