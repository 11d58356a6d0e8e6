"""Uploaded files and crawled pages on their way into the tables: validation, registration, frames, cached discoveries."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that may be uploaded, the largest file in bytes, and seconds that a discovery is kept.
UPLOADED = ["pdf", "docx", "md"]
MOST_BYTES, KEPT_SECONDS = 25 * 1024 * 1024, 600


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(name, extension, n_bytes, checksum, reference) of the files of a folder and those below it. Spark's file sources
    pass over files of no bytes; these come from the listing that the source has made, so that they can be turned down.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = lambda p: F.regexp_replace(p, "^([a-z0-9]+:)/+", "$1/")
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(plain("path").alias("path"))
    read = files.select(plain("path").alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("checksum"))
    found = listed.join(read, "path", "left").withColumns({"n_bytes": F.coalesce("n_bytes", F.lit(0).cast("long")), "checksum": F.coalesce("checksum", F.sha2(F.lit(b""), 256))})
    return described(found.select(F.substring_index("path", "/", -1).alias("name"), "n_bytes", "checksum"))


def described(files: DataFrame) -> DataFrame:
    """files (name, n_bytes, checksum, ...) with their extension in lower case and the reference of a manual upload."""
    return files.withColumns({"extension": F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)), "reference": F.concat(F.lit("manual_upload://"), "name")})


def fault(extension: Column, n_bytes: Column, most_bytes: int = MOST_BYTES) -> Column:
    """The first rule that a file breaks, or null: its type, then no content, then too much."""
    known = F.coalesce(extension.isin(*UPLOADED), F.lit(False))
    return F.when(~known, "unsupported_type").when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty").when(n_bytes > most_bytes, "too_large")


def validated(files: DataFrame, stored: DataFrame, key: str = "name", most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (key, extension, n_bytes, checksum) with decision: a broken rule, duplicate where the checksum is stored
    (checksum) or a valid file with a smaller key has it, or accepted. Only valid files claim a checksum.
    """
    rows = files.withColumn("_fault", fault(F.col("extension"), F.col("n_bytes"), most_bytes))
    first = rows.where("_fault IS NULL").groupBy(F.col("checksum").alias("_sum")).agg(F.min(key).alias("_first"))
    known = stored.select(F.col("checksum").alias("_sum")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(first.join(known, "_sum", "left"), F.col("checksum") == F.col("_sum"), "left")
    decision = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(F.col("_known") | (F.col("_first") < F.col(key)), "duplicate").otherwise("accepted")
    return rows.withColumn("decision", decision).select(*files.columns, "decision")


def confirmed(pages: DataFrame) -> DataFrame:
    """pages (url, html) with error: one row for each page, and no page stops the others."""
    return pages.withColumn("error", F.when(~F.coalesce(F.col("url").rlike("(?i)^https?://[^/]"), F.lit(False)), "bad_url").when(F.coalesce(F.trim("html"), F.lit("")) == "", "empty_page"))


def without_errors(crawled: DataFrame) -> DataFrame:
    """What of a crawl is stored: rows without an error."""
    return crawled.where("error IS NULL").drop("error")


def branch(content_type: Column) -> Column:
    """How a fetched page goes on: as html, or as a document."""
    return F.when(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml"), "html").otherwise("document")


def frames(event: Column, *data: str) -> Column:
    """One frame of an event stream: its name and its data as JSON."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(event.alias("event"), *data)), F.lit("\n\n"))


def live_discoveries(cache: DataFrame, now: Column, key: str = "user_id") -> DataFrame:
    """The newest entry of each key that is not older than KEPT_SECONDS: cache (key, payload, stored_at)."""
    alive = cache.where(F.col("stored_at") + F.make_dt_interval(secs=F.lit(KEPT_SECONDS)) >= now)
    return alive.groupBy(key).agg(F.max_by("payload", F.struct("stored_at", "payload")).alias("payload"))
