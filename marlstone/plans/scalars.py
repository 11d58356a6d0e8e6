"""Queries of scalar functions: text, numbers, dates, JSON, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import parse_embedding
from ..operators import chunking
from ..sources import tables as T
from .base import query


@query("sc2_sc3_normalize_names", "SELECT p_partkey, trim(lower(regexp_replace(translate(p_name, '-_', '  '), '\\s+', ' ', 'g'))) AS name FROM part")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_partkey", X.normalize_term(F.col("p_name")).alias("name"))


@query("sc4_sc5_storage_keys", "SELECT doc_id, 'uploads/' || source || '/' || doc_id || '/' || left(CASE WHEN leaf = '' THEN 'file' ELSE leaf END, 128) AS key FROM (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(text), ' ' || chr(10)), '\\s+', '-', 'g'), '[^a-z0-9._-]', '', 'g'), '-+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS leaf FROM documents)")
def storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", X.storage_key(F.lit("uploads"), F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("key"))


@query("sc9_sc10_terms", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^0-9a-zA-Z]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for')))), ' ') AS terms FROM part")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.terms(F.col("p_type")), " ").alias("terms"))


@query("sc10_singulars", "SELECT DISTINCT w AS term, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS singular FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^0-9a-z]+')) AS w FROM documents) WHERE w <> ''")
def singulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.read(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^0-9a-z]+")).alias("term")).where("term <> ''").distinct()
    return words.select("term", X.singular(F.col("term")).alias("singular"))


@query("sc16_capitals", "SELECT p_partkey, length(regexp_replace(p_name, '[^A-Z]', '', 'g')) AS capitals FROM part")
def capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_partkey", X.capitals(F.col("p_name")).cast("long").alias("capitals"))


@query("sc17_checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("sc18_fact_lines", "SELECT n_nationkey, '- ' || n_name || coalesce(' (' || r_name || ')', '') || ', v' || n_regionkey AS line FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = T.read(spark, sf_dir, "nation").join(T.read(spark, sf_dir, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    place = F.coalesce(F.concat(F.lit(" ("), F.col("r_name"), F.lit(")")), F.lit(""))
    return joined.select("n_nationkey", F.concat(F.lit("- "), F.col("n_name"), place, F.lit(", v"), F.col("n_regionkey").cast("string")).alias("line"))


@query("sc20_templates", "SELECT c_custkey, replace(replace('{name} in {segment}', '{name}', c_name), '{segment}', c_mktsegment) AS prompt FROM customer")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.replace(F.replace(F.lit("{name} in {segment}"), F.lit("{name}"), F.col("c_name")), F.lit("{segment}"), F.col("c_mktsegment"))
    return T.read(spark, sf_dir, "customer").select("c_custkey", filled.alias("prompt"))


@query("sc21_history_lines", "SELECT conv_id, string_agg((turn + 1) || '. ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, F.col("text"))


def _history(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    made = T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("a"))
    return made.select("conv_id", F.array_join(F.transform("a", lambda x: F.concat((x["turn"] + 1).cast("string"), F.lit(". "), x["t"])), "\n").alias("history"))


MESSAGE = "CASE event_id % 4 WHEN 0 THEN 'Error code: 429, try again in ' || (event_id % 9) || 'm' || (event_id % 60) || '.5s.' WHEN 1 THEN 'json_validate_failed 429' WHEN 2 THEN 'please retry in ' || (event_id % 7) || 'm' ELSE 'connection reset' END"


@query("sc22_sc23_error_messages", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'deterministic' ELSE 'other' END AS kind, CASE event_id % 4 WHEN 0 THEN (event_id % 9) * 60.0 + event_id % 60 + 0.5 WHEN 2 THEN (event_id % 7) * 60.0 END AS cooldown FROM (SELECT event_id, {MESSAGE} AS m FROM events)")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "events").select("event_id", F.expr(MESSAGE).alias("m"))
    return rows.select("event_id", X.error_class(F.col("m")).alias("kind"), X.cooldown_seconds(F.col("m")).alias("cooldown"))


@query("sc27_redaction", "SELECT c_custkey, '<redacted str, ' || length(c_name) || ' chars>' AS name, c_mktsegment FROM customer")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.concat(F.lit("<redacted str, "), F.length("c_name").cast("string"), F.lit(" chars>"))
    return T.read(spark, sf_dir, "customer").select("c_custkey", hidden.alias("name"), "c_mktsegment")


@query("sc28_split_part", "SELECT s_suppkey, split_part(s_name, '#', 1) AS kind FROM supplier")
def split_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "supplier").select("s_suppkey", F.split_part("s_name", F.lit("#"), F.lit(1)).alias("kind"))


@query("sc33_confidence_tiers", "SELECT c_custkey, CASE WHEN c >= 0.8 THEN 'HIGH' WHEN c >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM (SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 9000)) AS c FROM customer)")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "customer").select("c_custkey", X.confidence_tier(F.col("c_acctbal") / 9000).alias("tier"))


@query("sc38_sc39_embedding_json", "SELECT vec_id, len(embedding) = 64 AS right_size, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 3) AS square FROM embeddings")
def embedding_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_embedding(F.to_json("embedding"))
    rows = T.read(spark, sf_dir, "embeddings").select("vec_id", parsed.alias("e"))
    return rows.select("vec_id", (F.size("e") == 64).alias("right_size"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x), 3).alias("square"))


@query("sc40_sc42_json_parse", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"))


@query("sc43_value_types", T.sql("SELECT namespace, attribute, CASE WHEN lower(trim(value)) IN ('true', 'false') THEN 'boolean' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS value_type, count(*) AS n FROM value GROUP BY ALL", "value"))
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.values(spark, sf_dir).groupBy("namespace", "attribute", X.value_type(F.col("value")).alias("value_type")).agg(F.count(F.lit(1)).alias("n"))


@query("sc46_sc47_routing", "SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'escalate' ELSE 'ticket_agent' END WHEN value < 50 THEN 'clarify' ELSE 'knowledge_agent' END AS next_agent, CASE WHEN user_id % 2 = 0 THEN 'hybrid' ELSE 'vector' END AS strategy FROM events")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "escalate").otherwise("ticket_agent")).when(F.col("value") < 50, "clarify").otherwise("knowledge_agent")
    entity_type = F.when(F.col("user_id") % 2 == 0, "customer")
    return T.read(spark, sf_dir, "events").select("event_id", agent.alias("next_agent"), F.when(entity_type.isNotNull(), "hybrid").otherwise("vector").alias("strategy"))


@query("nl3_nl5_nl6_token_windows", r"""
WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, text, w, len(w) AS n, unnest(range(0, greatest(len(w), 1), 425)) AS s FROM t WHERE len(w) > 0),
k AS (SELECT * FROM s WHERE s = 0 OR s + 75 < n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(len(w[s + 1:s + 500]) AS INTEGER) AS token_count,
       md5(CASE WHEN n <= 500 THEN text ELSE array_to_string(w[s + 1:s + 500], ' ') END) AS chunk_md5 FROM k""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk_tokens(T.read(spark, sf_dir, "documents"))
    return made.select("doc_id", "chunk_index", "token_count", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("nl16_extraction_windows")
def extraction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_for_extraction(T.read(spark, sf_dir, "documents"))


@query("nl17_batches", "SELECT CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS BIGINT) AS batch, source, doc_id FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return T.read(spark, sf_dir, "documents").select(F.floor(n / 3).alias("batch"), "source", "doc_id")
