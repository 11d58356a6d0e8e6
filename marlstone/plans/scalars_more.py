"""More scalar queries: content types, ranking parts, durations, citations, vocabulary matches, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import duration, normalize_term, strip, strip_code_fence
from ..sources import tables as T
from .base import query


@query("sc8_content_types", "SELECT page_id, lower(trim(split_part(ct, ';', 1))) AS base FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ' Text/HTML; charset=utf-8' ELSE 'application/PDF' END AS ct FROM pages)")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct = F.when(F.col("page_id") % 2 == 0, " Text/HTML; charset=utf-8").otherwise("application/PDF")
    return T.read(spark, sf_dir, "pages").select("page_id", F.lower(F.trim(F.split_part(ct, F.lit(";"), F.lit(1)))).alias("base"))


@query("sc30_freshness", T.sql("SELECT version_id, round(version_number / (version_number + 1), 4) AS freshness FROM version", "version"))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.versions(spark, sf_dir).select("version_id", F.round(F.col("version_number") / (F.col("version_number") + 1), 4).alias("freshness"))


@query("sc32_combined_confidence", "SELECT event_id, round(list_sum(a) / len(a), 3) AS confidence FROM (SELECT event_id, list_filter([event_id % 4 / 4.0, user_id % 8 / 8.0, CASE WHEN event_type = 'error' THEN 0.5 END], lambda x: x IS NOT NULL) AS a FROM events)")
def combined_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.col("event_id") % 4 / 4.0, F.col("user_id") % 8 / 8.0, F.when(F.col("event_type") == "error", 0.5))
    known = T.read(spark, sf_dir, "events").select("event_id", F.filter(parts, lambda x: x.isNotNull()).alias("a"))
    return known.select("event_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / F.size("a"), 3).alias("confidence"))


@query("sc37_durations", """SELECT event_id, CASE WHEN s % 86400 = 0 THEN CASE WHEN s = 86400 THEN 'day' ELSE (s // 86400) || ' days' END WHEN s % 3600 = 0 THEN CASE WHEN s = 3600 THEN 'hour' ELSE (s // 3600) || ' hours' END
WHEN s % 60 = 0 THEN CASE WHEN s = 60 THEN 'minute' ELSE (s // 60) || ' minutes' END ELSE s || ' seconds' END AS text
FROM (SELECT event_id, (user_id % 30 + 1) * list_extract([1, 60, 900, 3600, 86400], event_id % 5 + 1) AS s FROM events)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of seconds, minutes, hours and days in words."""
    unit = F.element_at(F.array(*map(F.lit, (1, 60, 900, 3600, 86400))), (F.col("event_id") % 5 + 1).cast("int"))
    return T.read(spark, sf_dir, "events").select("event_id", duration((F.col("user_id") % 30 + 1) * unit).alias("text"))


@query("jn23_citations", "SELECT conv_id, array_to_string([r[i] FOR i IN [0, conv_id % 11 - 1, 2, 9] IF i BETWEEN 1 AND len(r)], ',') AS cited FROM (SELECT conv_id, list(turn || ':' || role ORDER BY turn) AS r FROM conversations GROUP BY ALL)")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited places from 1, some of them out of range; no conversation is collected beyond the last place cited."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = T.read(spark, sf_dir, "conversations").select("conv_id", place.alias("place"), F.concat_ws(":", F.col("turn").cast("string"), "role").alias("item")).where("place <= 9")
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("r"))
    asked = F.array(F.lit(0), (F.col("conv_id") % 11 - 1).cast("int"), F.lit(2), F.lit(9))
    return made.select("conv_id", F.array_join(F.transform(F.filter(asked, lambda i: i.between(1, F.size("r"))), lambda i: F.element_at("r", i)["item"]), ",").alias("cited"))


@query("jn22_reply_to_window", "SELECT c.conv_id, c.turn, coalesce(r.role, 'none') AS reply_role FROM conversations c LEFT JOIN conversations r ON c.conv_id = r.conv_id AND c.turn + 1 = r.turn")
def reply_to_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    replies = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply"))
    return c.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("reply", F.lit("none")).alias("reply_role"))


@query("pf10_wn4_margin", "SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE o_totalprice >= best - 10000")
def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max("o_totalprice").over(W.partitionBy("o_custkey"))
    return T.read(spark, sf_dir, "orders").withColumn("best", best).where(F.col("o_totalprice") >= F.col("best") - 10000).select("o_custkey", "o_orderkey")


@query("pf14_sc24_expiry_and_tickets", "SELECT event_id, coalesce(lower(regexp_extract('ticket ' || upper(md5(CAST(event_id AS VARCHAR))), '([0-9A-F]{32})', 1)), '') AS ticket FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("ticket "), F.upper(F.md5(F.col("event_id").cast("string").cast("binary"))))
    return T.read(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-20 00:00:00'").select("event_id", F.lower(F.regexp_extract(text, "([0-9A-F]{32})", 1)).alias("ticket"))


VOCABULARY = {"building": "construction", "automobile": "automotive", "machinery": "industrial", "household": "home", "furniture": "home"}


@query("sc12_sc13_sc14_vocabulary_match")
def vocabulary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("c_custkey") % 2 == 0, F.substring("c_mktsegment", 1, 6)).otherwise(F.col("c_mktsegment"))
    rows = T.read(spark, sf_dir, "customer").select("c_custkey", normalize_term(asked).alias("term"))
    return rows.withColumn("m", fuzzy.match(F.col("term"), VOCABULARY)).select("c_custkey", "term", "m.*")


@query("sc14_type_match")
def type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types, some of them cut short, against all types of the table as the vocabulary."""
    part = T.read(spark, sf_dir, "part")
    types = fuzzy.vocabulary_rows(part.select(F.col("p_type").alias("term")), normalize_term(F.col("term")))
    kind = F.col("p_partkey") % 3
    asked = F.when(kind == 0, F.col("p_type")).when(kind == 1, F.substring("p_type", 2, 100)).otherwise(F.split_part("p_type", F.lit(" "), F.lit(1)))
    rows = part.select("p_partkey", normalize_term(asked).alias("term"))
    return rows.join(fuzzy.match_table(rows, types), "term", "left").select("p_partkey", "term", "canonical", "confidence", "alternates")


@query("sc14_relation_match")
def relation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as relations, against two stored relation types and their synonyms."""
    known = {"belongs to": "belongs_to", "provides": "provides", "purchased": "provides", "sign ups": "belongs_to"}
    rows = T.read(spark, sf_dir, "events").select("event_id", normalize_term(F.col("event_type")).alias("term"))
    return rows.withColumn("m", fuzzy.match_relation(F.col("term"), known)).select("event_id", "term", "m.*")


@query("sc14_attribute_match")
def attribute_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of all values as another type's extraction may name them, within what each type has."""
    own = {"customer": ["acctbal", "mktsegment"], "supplier": ["acctbal"], "part": ["brand", "type", "size"]}
    synonyms = {"account balance": "acctbal", "segment": "mktsegment", "maker": "brand"}
    rows = T.values(spark, sf_dir).select("entity_id", "namespace", "attribute", normalize_term(F.when(F.col("attribute") == "acctbal", "account-balances").otherwise(F.substring("attribute", 1, 4))).alias("term"))
    return rows.withColumn("m", fuzzy.match_attribute(F.col("namespace"), F.col("term"), own, synonyms)).select("entity_id", "attribute", "term", "m.*")


@query("sc15_exact_canonical", "SELECT c_custkey, CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'construction' WHEN 'automobile' THEN 'automotive' WHEN 'machinery' THEN 'industrial' WHEN 'household' THEN 'home' WHEN 'furniture' THEN 'home' ELSE trim(c_mktsegment) END AS canonical FROM customer")
def exact_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in VOCABULARY.items() for x in kv))
    return T.read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.try_element_at(table, normalize_term(F.col("c_mktsegment"))), F.trim("c_mktsegment")).alias("canonical"))


@query("sc15_canonical_terms", "WITH term AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' Unknown  ' || c_custkey ELSE '  ' || replace(lower(n_name), ' ', '-') END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce(n_name, trim(t)) AS canonical FROM term LEFT JOIN nation ON translate(lower(n_name), '-_', '  ') = trim(lower(regexp_replace(translate(t, '-_', '  '), '\\s+', ' ', 'g')))")
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as a vocabulary table spells them, and other terms as they are."""
    nations = T.read(spark, sf_dir, "nation")
    spelt = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" Unknown  "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("  "), F.replace(F.lower("n_name"), F.lit(" "), F.lit("-"))))
    rows = T.read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spelt.alias("t"))
    known = fuzzy.vocabulary_rows(nations.select(F.col("n_name").alias("term")), normalize_term(F.col("term")))
    return rows.join(known, normalize_term(F.col("t")) == F.col("n"), "left").select("c_custkey", F.coalesce("canonical", strip(F.col("t"))).alias("canonical"))


@query("sc19_code_fences", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'see ```' || props || '```' ELSE props END AS inside FROM events")
def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    fenced = F.when(kind == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(kind == 1, F.concat(F.lit("  "), F.col("props"), F.lit("\n"))).otherwise(F.concat(F.lit("see ```"), F.col("props"), F.lit("```")))
    return T.read(spark, sf_dir, "events").select("event_id", strip_code_fence(fenced).alias("inside"))


@query("pf26_role_rank", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END >= 1 AS allowed FROM conversations")
def role_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("system"), F.lit(2), F.lit("assistant"), F.lit(1)), F.col("role")), F.lit(0))
    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", (rank >= 1).alias("allowed"))
