"""The engine's tables, derived from the star-schema parquet files, and the same derivations as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _money(column: str):
    return F.col(column).cast("decimal(12,2)").cast("string")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, name) of regions, nations, suppliers, customers and parts."""
    out = None
    for kind, letter in (("region", "r"), ("nation", "n"), ("supplier", "s"), ("customer", "c"), ("part", "p")):
        key = f"{letter}_{kind if kind != 'customer' else 'cust'}key" if kind in ("region", "nation") else {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}[kind]
        rows = read(spark, sf_dir, kind).select(_id(kind, key).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(f"{letter}_name").alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, namespace, attribute, value, searchable, superseded): attribute values as rows, values as text."""
    customer, supplier, part = (read(spark, sf_dir, t) for t in ("customer", "supplier", "part"))

    def rows(df, kind, key, attribute, value, searchable, superseded=None):
        old = F.lit(False) if superseded is None else F.col(key) % superseded == 0
        return df.select(_id(kind, key).alias("entity_id"), F.lit(kind).alias("namespace"), F.lit(attribute).alias("attribute"), value.alias("value"), F.lit(searchable).alias("searchable"), old.alias("superseded"))

    parts = [
        rows(customer, "customer", "c_custkey", "acctbal", _money("c_acctbal"), False, 7),
        rows(customer, "customer", "c_custkey", "mktsegment", F.col("c_mktsegment"), True),
        rows(supplier, "supplier", "s_suppkey", "acctbal", _money("s_acctbal"), False, 7),
        rows(part, "part", "p_partkey", "brand", F.col("p_brand"), True),
        rows(part, "part", "p_partkey", "type", F.col("p_type"), True),
        rows(part, "part", "p_partkey", "size", F.col("p_size").cast("string"), False, 5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """(source_id, target_id, relation_type), directed: places in places, and suppliers of the parts of their lines. Without
    distinct, a supplier's part has a row for each line, for those who restrict rows before they make them distinct.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    lines = lines.distinct() if distinct else lines  # by numbers, which take less memory than names
    nation, supplier, customer = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    belongs = F.lit("belongs_to").alias("relation_type")
    provides = lines.select(_id("supplier", "l_suppkey").alias("source_id"), _id("part", "l_partkey").alias("target_id"), F.lit("provides").alias("relation_type"))
    return (
        nation.select(_id("nation", "n_nationkey").alias("source_id"), _id("region", "n_regionkey").alias("target_id"), belongs)
        .unionByName(supplier.select(_id("supplier", "s_suppkey").alias("source_id"), _id("nation", "s_nationkey").alias("target_id"), belongs))
        .unionByName(customer.select(_id("customer", "c_custkey").alias("source_id"), _id("nation", "c_nationkey").alias("target_id"), belongs))
        .unionByName(provides)
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_id, source_id, version_number, status, checksum) of documents; a source holds at most four hundred neighbours of a site."""
    source = F.concat("source", F.lit("/"), F.expr("doc_id div 400").cast("string"))
    number = F.row_number().over(W.partitionBy("source_id").orderBy("version_id"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), source.alias("source_id"), F.sha2("text", 256).alias("checksum"))
    status = F.when(F.col("version_id") % 5 == 0, "STALE").otherwise("INDEXED")
    return rows.withColumn("version_number", number.cast("long")).withColumn("status", status)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, site, current_version, is_active): a source is inactive if its current document is marked toxic."""
    v = versions(spark, sf_dir)
    top = v.groupBy("source_id").agg(F.max("version_id").alias("current_version"))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    joined = top.join(toxic, F.col("current_version") == F.col("toxic_id"), "left")
    return joined.select("source_id", F.substring_index("source_id", "/", 1).alias("site"), "current_version", F.col("toxic_id").isNull().alias("is_active"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, version_id, text, embedding): one chunk for each document that has an embedding."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.join(docs, F.col("chunk_id") == F.col("version_id"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, source_id, status, failure_kind, attempt_count, started_at) of ingestion jobs, from events."""
    kind = {"signup": "QUEUED", "click": "RUNNING", "view": "INDEXED", "purchase": "FAILED", "error": "RUNNING"}
    status = F.create_map(*(F.lit(x) for kv in kind.items() for x in kv))[F.col("event_type")]
    failure = F.when(F.col("event_id") % 4 == 0, "rate_limited").when(F.col("event_id") % 4 == 1, "worker_abandoned").when(F.col("event_id") % 4 == 2, "checksum_mismatch").otherwise("tika_unavailable")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("source_id"), status.alias("status"), F.when(F.col("event_type").isin("purchase", "error"), failure).alias("failure_kind"),
        (F.col("event_id") % 5).alias("attempt_count"), F.col("ts").alias("started_at"),
    )


VIEWS = {
    "entity": """
  SELECT 'region:' || r_regionkey AS entity_id, 'region' AS entity_type, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part""",
    "value": """
  SELECT 'customer:' || c_custkey AS entity_id, 'customer' AS namespace, 'acctbal' AS attribute, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS value, FALSE AS searchable, c_custkey % 7 = 0 AS superseded FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'mktsegment', c_mktsegment, TRUE, FALSE FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'acctbal', CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR), FALSE, s_suppkey % 7 = 0 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'brand', p_brand, TRUE, FALSE FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'type', p_type, TRUE, FALSE FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'size', CAST(p_size AS VARCHAR), FALSE, p_partkey % 5 = 0 FROM part""",
    "relation": """
  SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'belongs_to' AS relation_type FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'belongs_to' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'belongs_to' FROM customer
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'provides' FROM lineitem""",
    "version": """
  SELECT doc_id AS version_id, source || '/' || (doc_id // 400) AS source_id, row_number() OVER (PARTITION BY source || '/' || (doc_id // 400) ORDER BY doc_id) AS version_number,
         CASE WHEN doc_id % 5 = 0 THEN 'STALE' ELSE 'INDEXED' END AS status, sha256(text) AS checksum FROM documents""",
    "source": """
  SELECT source_id, split_part(source_id, '/', 1) AS site, current_version, current_version NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_active
  FROM (SELECT source_id, max(version_id) AS current_version FROM version GROUP BY source_id)""",
    "chunk": """
  SELECT vec_id AS chunk_id, doc_id AS version_id, text, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings JOIN documents ON vec_id = doc_id""",
    "job": """
  SELECT event_id AS job_id, user_id AS source_id,
         CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'INDEXED' WHEN 'purchase' THEN 'FAILED' WHEN 'error' THEN 'RUNNING' END AS status,
         CASE WHEN event_type IN ('purchase', 'error') THEN CASE event_id % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'worker_abandoned' WHEN 2 THEN 'checksum_mismatch' ELSE 'tika_unavailable' END END AS failure_kind,
         event_id % 5 AS attempt_count, ts AS started_at FROM events""",
}


def sql(query: str, *views: str) -> str:
    """The query with the views it uses in front."""
    named = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {named} {query}" if named else query
