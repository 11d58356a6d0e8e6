"""Queries of entity-attribute-value lookup and its predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_term_matches, terms
from ..operators import eav
from ..sources import tables as T
from ..sources.shared import written
from .base import query


def _questions(spark: SparkSession) -> DataFrame:
    rows = [(1, "nation", "germany", None), (2, "region", "EUROPE", None), (3, "customer", "Europe", "belongs_to"), (4, None, "supplier#000000003", "acctbal"), (5, "supplier", "Supplier#000000005", "missing")]
    return spark.createDataFrame(rows, "query_id int, q_type string, q_name string, q_attribute string")


QUESTIONS = "question(query_id, q_type, q_name, q_attribute) AS (VALUES (1, 'nation', 'germany', NULL), (2, 'region', 'EUROPE', NULL), (3, 'customer', 'Europe', 'belongs_to'), (4, NULL, 'supplier#000000003', 'acctbal'), (5, 'supplier', 'Supplier#000000005', 'missing'))"
RESOLVED = "resolved AS (SELECT * FROM (SELECT *, CASE WHEN q_type IS NULL OR lower(entity_type) = lower(q_type) THEN 0 ELSE 1 END AS tier FROM entity JOIN question ON lower(name) = lower(q_name)) QUALIFY tier = min(tier) OVER (PARTITION BY query_id))"
FACT = "fact AS (SELECT entity_id, 0 AS branch, attribute, value FROM value WHERE NOT superseded UNION ALL SELECT source_id, 1, relation_type, name FROM relation JOIN entity ON target_id = entity_id UNION ALL SELECT target_id, 2, relation_type, name FROM relation JOIN entity ON source_id = entity_id)"


def _with(text: str, tail: str) -> str:
    return T.sql("", "entity", "value", "relation").rstrip() + ", " + text + " " + tail


@query("pf1_pf2_resolve_entities", _with(f"{QUESTIONS}, {RESOLVED}", "SELECT query_id, entity_id, tier FROM resolved"))
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eav.resolve(T.entities(spark, sf_dir), F.broadcast(_questions(spark))).select("query_id", "entity_id", "tier")


@query("nl10_nl11_structured_lookup", _with(f"{QUESTIONS}, {RESOLVED}, {FACT}", "SELECT query_id, entity_id, branch, attribute, value, tier AS fallback FROM (SELECT query_id, r.entity_id, branch, attribute, value, CASE WHEN q_attribute IS NULL OR lower(attribute) = lower(q_attribute) THEN 0 ELSE 1 END AS tier FROM resolved r JOIN fact f ON r.entity_id = f.entity_id) QUALIFY tier = min(tier) OVER (PARTITION BY query_id)"))
def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = T.entities(spark, sf_dir)
    found = written(eav.resolve(entities, F.broadcast(_questions(spark))))
    return eav.lookup(found, eav.facts(T.values(spark, sf_dir), T.relations(spark, sf_dir, distinct=False), entities, of=found))


@query("st2_jn3_jn4_jn5_all_facts", _with(FACT, "SELECT branch, attribute, count(*) AS n, count(DISTINCT entity_id) AS n_entities, min(value) AS least, max(value) AS most FROM fact GROUP BY ALL"))
def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eav.facts(T.values(spark, sf_dir), T.relations(spark, sf_dir), T.entities(spark, sf_dir))
    return rows.groupBy("branch", "attribute").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_entities"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("pf3_so10_find_entities", T.sql("SELECT entity_id, entity_type, name FROM entity WHERE name ILIKE '%er%9%' AND entity_type = 'supplier' ORDER BY name, entity_id LIMIT 50", "entity"))
def find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entities(spark, sf_dir).where(F.col("name").ilike("%er%9%") & (F.col("entity_type") == "supplier")).orderBy("name", "entity_id").limit(50)


@query("pf4_ag10_find_by_value", T.sql("SELECT entity_id, name FROM entity WHERE entity_id IN (SELECT entity_id FROM value WHERE searchable AND value ILIKE '%build%')", "entity", "value"))
def find_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    matching = T.values(spark, sf_dir).where(F.col("searchable") & F.col("value").ilike("%build%")).select("entity_id")
    return T.entities(spark, sf_dir).join(matching, "entity_id", "left_semi").select("entity_id", "name")


@query("jn6_gr1_entity_detail", T.sql("SELECT e.entity_id, e.name, count(v.value) AS fact_count, coalesce(string_agg(attribute || '=' || value, ';' ORDER BY namespace, attribute, value), '') AS details FROM entity e LEFT JOIN value v ON e.entity_id = v.entity_id GROUP BY ALL", "entity", "value"))
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.when(F.col("value").isNotNull(), F.struct("namespace", "attribute", "value"))
    joined = T.entities(spark, sf_dir).join(T.values(spark, sf_dir), "entity_id", "left")
    made = joined.groupBy("entity_id", "name").agg(F.count("value").alias("fact_count"), F.array_sort(F.collect_list(fact)).alias("facts"))
    return made.select("entity_id", "name", "fact_count", F.array_join(F.transform("facts", lambda f: F.concat(f["attribute"], F.lit("="), f["value"])), ";").alias("details"))


@query("pf6_pf7_current_values_of", T.sql("SELECT entity_id, attribute, value FROM value WHERE NOT superseded AND entity_id IN ('supplier:1', 'supplier:7', 'customer:14', 'part:3')", "value"))
def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.values(spark, sf_dir).where(~F.col("superseded") & F.col("entity_id").isin("supplier:1", "supplier:7", "customer:14", "part:3")).select("entity_id", "attribute", "value")




@query("pf11_sc11_fact_relevance", """
WITH t AS (SELECT p_partkey, p_type, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name), '[^0-9a-zA-Z]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'are', 'was', 'were', 'our', 'all', 'any', 'list', 'with'))) AS terms FROM part),
u AS (SELECT p_partkey, unnest(terms) AS term FROM t),
q AS (SELECT unnest(['polished', 'coppers', 'standards']) AS term),
s AS (SELECT p_partkey, CASE WHEN term LIKE '%ies' AND length(term) > 4 THEN left(term, -3) || 'y' WHEN term LIKE '%s' AND length(term) > 3 THEN left(term, -1) ELSE term END AS term FROM u),
r AS (SELECT CASE WHEN term LIKE '%s' THEN left(term, -1) ELSE term END AS term FROM q)
SELECT DISTINCT p_partkey FROM s JOIN r ON s.term = r.term OR (length(s.term) >= 5 AND length(r.term) >= 5 AND left(s.term, 5) = left(r.term, 5))""")
def fact_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*map(F.lit, ("polished", "coppers", "standards")))
    rows = T.read(spark, sf_dir, "part").select("p_partkey", terms(F.concat_ws(" ", "p_type", "p_name")).alias("terms"))
    return rows.where(any_term_matches(asked, F.col("terms"))).select("p_partkey")


@query("st3_membership_fallback", _with("picked AS (SELECT n.entity_id, coalesce(max(CASE WHEN s.entity_type = 'supplier' THEN 1 END), 0) AS has_supplier FROM entity n JOIN relation r ON n.entity_id = r.target_id JOIN entity s ON r.source_id = s.entity_id WHERE n.entity_type = 'nation' GROUP BY ALL)", "SELECT p.entity_id, s.entity_type, count(*) AS n FROM picked p JOIN relation r ON p.entity_id = r.target_id JOIN entity s ON r.source_id = s.entity_id WHERE has_supplier = 0 OR s.entity_type = 'supplier' GROUP BY ALL"))
def membership_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.entities(spark, sf_dir)
    nations = e.where("entity_type = 'nation'").select(F.col("entity_id").alias("target_id"))
    members = T.relations(spark, sf_dir).join(nations, "target_id").join(e.select(F.col("entity_id").alias("source_id"), "entity_type"), "source_id")
    counted = members.groupBy("target_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    special = F.max(F.col("entity_type") == "supplier").over(W.partitionBy("target_id"))
    return counted.withColumn("special", special).where(~F.col("special") | (F.col("entity_type") == "supplier")).select(F.col("target_id").alias("entity_id"), "entity_type", "n")
