"""Queries of entity resolution, supersession and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_value
from ..operators import resolution as R
from ..sources import tables as T
from .base import query

#: Entities whose names collide after normalisation: parts by the first word of their names, as three types, two of which
#: are one. Synonyms of types, and names whose type was settled by hand.
COLLIDING = "SELECT 'part:' || p_partkey AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'goods' WHEN p_partkey % 7 = 1 THEN 'Item' ELSE 'part' END AS entity_type, CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS name FROM part"
COUNTS = "SELECT entity_id, count(*) AS facts FROM value WHERE NOT superseded GROUP BY ALL"
SYNONYMS, REVIEWED = {"item": "part", "vendor": "supplier"}, {"red": "colour"}
CANONICAL = "CASE lower({0}) WHEN 'item' THEN 'part' WHEN 'vendor' THEN 'supplier' ELSE {0} END"


def _colliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    kind = F.when(F.col("p_partkey") % 3 == 0, "goods").when(F.col("p_partkey") % 7 == 1, "Item").otherwise("part")
    return T.read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), kind.alias("entity_type"), F.when(F.col("p_partkey") % 2 == 0, F.upper(word)).otherwise(word).alias("name"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.values(spark, sf_dir).where(~F.col("superseded")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("facts"))


def _plan_sql(named: str, counts: str) -> str:
    return f"""named AS ({named}), counts AS ({counts}), freq AS (SELECT entity_type AS canonical, count(*) AS freq FROM named GROUP BY ALL),
rows_ AS (SELECT n.*, coalesce(freq, 0) AS freq, coalesce(facts, 0) AS facts, trim(lower(n.name)) AS name_norm FROM (SELECT *, {CANONICAL.format('entity_type')} AS canonical FROM named) n LEFT JOIN counts c ON n.entity_id = c.entity_id LEFT JOIN freq f ON n.canonical = f.canonical),
bucket AS (SELECT *, count(*) OVER w AS size, max(facts) OVER w AS top FROM rows_ WINDOW w AS (PARTITION BY name_norm)),
sup AS (SELECT *, facts >= greatest(1.0, top * 0.2) AS supported FROM bucket WHERE size >= 2),
sup2 AS (SELECT *, bool_or(supported) OVER (PARTITION BY name_norm) AS any_supported FROM sup),
typed AS (SELECT *, CASE name_norm WHEN 'red' THEN 'colour' ELSE first_value(canonical) OVER (PARTITION BY name_norm ORDER BY CASE WHEN NOT any_supported OR supported THEN 0 ELSE 1 END, freq, facts DESC, canonical, entity_id) END AS chosen_type FROM sup2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name_norm ORDER BY facts DESC, entity_type <> chosen_type, canonical <> chosen_type, entity_id) AS rn, row_number() OVER (PARTITION BY name_norm ORDER BY length(regexp_replace(name, '[^A-Z]', '', 'g')) DESC, length(name) DESC, entity_id DESC) AS ln FROM typed),
plan AS (SELECT name_norm, max(entity_id) FILTER (WHERE rn = 1) AS survivor, max(chosen_type) AS chosen_type, max(name) FILTER (WHERE ln = 1) AS label, max(size) AS size FROM ranked GROUP BY ALL),
ids AS (SELECT entity_id AS old_id, survivor AS new_id FROM ranked JOIN plan USING (name_norm) WHERE entity_id <> survivor)"""


PLAN = _plan_sql(COLLIDING, COUNTS)
#: Values of which every second entity's are spelt in capitals, with blanks before them.
SPELT = "SELECT * REPLACE (CASE WHEN regexp_matches(entity_id, '[13579]$') THEN '  ' || upper(value) ELSE value END AS value) FROM value"


@query("er8_wn10_wn11_wn12_merge_plan", T.sql("", "value").rstrip() + f", {PLAN} SELECT name_norm, survivor, chosen_type, label, CAST(size AS BIGINT) AS size FROM plan")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_plan(_colliding(spark, sf_dir), _counts(spark, sf_dir), SYNONYMS, REVIEWED).select("name_norm", "survivor", "chosen_type", "label", "size")


@query("er10_er13_jn14_repoint_values", T.sql("", "value").rstrip() + f", {PLAN} SELECT coalesce(i.new_id, v.entity_id) AS entity_id, attribute, lower(trim(value)) AS value_norm, arg_min(value, (i.new_id IS NOT NULL, v.entity_id, value)) AS value FROM ({SPELT}) v LEFT JOIN ids i ON v.entity_id = i.old_id GROUP BY ALL")
def repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _colliding(spark, sf_dir)
    plan = R.merge_plan(named, _counts(spark, sf_dir), SYNONYMS, REVIEWED)
    v = T.values(spark, sf_dir)
    spelt = v.withColumn("value", F.when(F.col("entity_id").rlike("[13579]$"), F.concat(F.lit("  "), F.upper("value"))).otherwise(F.col("value")))
    return R.repoint(spelt, R.merged_ids(named, plan)).select("entity_id", "attribute", "value_norm", "value")


#: Stale tables for a whole run: entities, attributes, values and relations as several extractions left them.
ATTRIBUTES = [("part.brand", "part", "brand"), ("part.size", "part", "size"), ("item.BRAND", "Item", "BRAND"), ("goods.size", "goods", "size"), ("vendor.acctbal", "Vendor", "acctbal")]
STALE_ENTITIES = f"{COLLIDING} UNION ALL SELECT 'supplier:' || s_suppkey, 'Vendor', s_name FROM supplier"
STALE = f"""attribute(attribute_id, namespace, name) AS (VALUES {', '.join(map(str, ATTRIBUTES))}),
stale AS (SELECT p_partkey * 10 AS value_id, 'part:' || p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 1 THEN 'item.BRAND' ELSE 'part.brand' END AS attribute_id, CASE WHEN p_partkey % 5 < 2 THEN upper(p_brand) || '  ' ELSE p_brand END AS value FROM part UNION ALL SELECT p_partkey * 10 + 1, 'part:' || p_partkey, 'part.size', CAST(p_size AS VARCHAR) FROM part),
link AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, 'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, 'provides' AS relation_type FROM lineitem)"""
RECONCILED = f"{STALE}, {_plan_sql(STALE_ENTITIES, 'SELECT entity_id, count(*) AS facts FROM stale GROUP BY ALL')}"


def _stale(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    part, lines = T.read(spark, sf_dir, "part"), T.read(spark, sf_dir, "lineitem")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    vendors = T.read(spark, sf_dir, "supplier").select(name("supplier", "s_suppkey").alias("entity_id"), F.lit("Vendor").alias("entity_type"), F.col("s_name").alias("name"))
    brand = part.select((F.col("p_partkey") * 10).alias("value_id"), name("part", "p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 2 == 1, "item.BRAND").otherwise("part.brand").alias("attribute_id"), F.when(F.col("p_partkey") % 5 < 2, F.concat(F.upper("p_brand"), F.lit("  "))).otherwise(F.col("p_brand")).alias("value"))
    size = part.select((F.col("p_partkey") * 10 + 1).alias("value_id"), name("part", "p_partkey").alias("entity_id"), F.lit("part.size").alias("attribute_id"), F.col("p_size").cast("string").alias("value"))
    links = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), name("supplier", "l_suppkey").alias("source_id"), name("part", "l_partkey").alias("target_id"), F.lit("provides").alias("relation_type"))
    attributes = spark.createDataFrame(ATTRIBUTES, "attribute_id string, namespace string, name string")
    return _colliding(spark, sf_dir).unionByName(vendors), links, attributes, brand.unionByName(size)


@query("er15_ag29_reconcile_report", f"""WITH {RECONCILED}
SELECT (SELECT count(*) FROM ids) AS entities_merged, (SELECT count(*) FROM named WHERE {CANONICAL.format('entity_type')} <> entity_type) AS entities_normalized,
       (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM attribute GROUP BY {CANONICAL.format('namespace')}, lower(name))) AS attributes_merged, (SELECT count(*) FROM attribute WHERE {CANONICAL.format('namespace')} <> namespace) AS attributes_normalized,
       (SELECT count(*) FROM link) - (SELECT count(*) FROM (SELECT DISTINCT source_id, coalesce(new_id, target_id) FROM link LEFT JOIN ids ON target_id = old_id)) AS relations_deduped,
       (SELECT count(*) FROM stale) - (SELECT count(*) FROM (SELECT DISTINCT coalesce(new_id, entity_id), replace(attribute_id, 'item.BRAND', 'part.brand'), lower(trim(value)) FROM stale LEFT JOIN ids ON entity_id = old_id)) AS values_deduped""")
def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(*_stale(spark, sf_dir), SYNONYMS, REVIEWED)[1]


@query("er15_er12_er14_reconciled_entities", f"""WITH {RECONCILED}
SELECT n.entity_id, CASE WHEN {CANONICAL.format('n.entity_type')} <> n.entity_type THEN {CANONICAL.format('n.entity_type')} ELSE coalesce(p.chosen_type, n.entity_type) END AS entity_type, coalesce(p.label, n.name) AS name
FROM named n LEFT JOIN plan p ON n.entity_id = p.survivor WHERE n.entity_id NOT IN (SELECT old_id FROM ids)""")
def reconciled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(*_stale(spark, sf_dir), SYNONYMS, REVIEWED)[0]["entities"]


@query("er11_repoint_attributes", f"""WITH {RECONCILED}
SELECT entity_id, attribute_id, value_norm, arg_min(value, (moved, value_id)) AS value, arg_min(value_id, (moved, value_id)) AS value_id
FROM (SELECT coalesce(new_id, entity_id) AS entity_id, replace(attribute_id, 'item.BRAND', 'part.brand') AS attribute_id, lower(trim(value)) AS value_norm, value, value_id, new_id IS NOT NULL OR attribute_id = 'item.BRAND' AS moved FROM stale LEFT JOIN ids ON entity_id = old_id) GROUP BY ALL""")
def repoint_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(*_stale(spark, sf_dir), SYNONYMS, REVIEWED)[0]["values"].select("entity_id", "attribute_id", "value_norm", "value", "value_id")


@query("er1_resolve_by_name", f"""WITH named AS ({COLLIDING}), known AS (SELECT trim(lower(name)) AS name_norm, arg_min(entity_id, CAST(split_part(entity_id, ':', 2) AS BIGINT)) AS entity_id FROM named WHERE CAST(split_part(entity_id, ':', 2) AS BIGINT) % 5 <> 0 GROUP BY ALL)
SELECT DISTINCT a.name_norm, coalesce(k.entity_id, 'new:' || md5(a.name_norm)) AS entity_id, k.entity_id IS NULL AS created FROM (SELECT lower(trim(p_name)) AS name_norm FROM part UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part) a LEFT JOIN known k USING (name_norm)""")
def resolve_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alone tell entities apart, whatever their types; the oldest of a name is the one, and new names are created."""
    part = T.read(spark, sf_dir, "part")
    known = _colliding(spark, sf_dir).withColumn("seq", F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("long")).where("seq % 5 <> 0")
    asked = part.select(F.concat(F.lit("  "), F.upper("p_name")).alias("name")).unionByName(part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")))
    return R.resolve_or_create(asked, known)


@query("er3_chunk_links", f"""WITH named AS ({COLLIDING}), known AS (SELECT trim(lower(name)) AS name_norm, arg_min(entity_id, CAST(split_part(entity_id, ':', 2) AS BIGINT)) AS entity_id FROM named GROUP BY ALL)
SELECT d.doc_id AS chunk_id, k.entity_id FROM part p JOIN documents d ON p.p_partkey = d.doc_id JOIN known k ON k.name_norm = lower(split_part(p_name, ' ', 1))""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each chunk that an entity was derived from; mentions of chunks that are gone are left out."""
    mentions = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    known = _colliding(spark, sf_dir).withColumn("seq", F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("long"))
    named = mentions.withColumn("name_norm", F.lower(F.trim("name"))).join(R.resolve_or_create(mentions, known), "name_norm")
    return named.join(T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "entity_id")


@query("er6_fact_analysis", "SELECT o_custkey, o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS options, count(DISTINCT o_orderpriority) > 1 AS multivalue FROM orders GROUP BY ALL")
def fact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fact key the distinct values in order, and whether there are several."""
    made = T.read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"))
    return made.select("o_custkey", "o_orderstatus", F.array_join("a", ",").alias("options"), (F.size("a") > 1).alias("multivalue"))


@query("er17_sc48_register_or_requeue", T.sql("SELECT version_id, CASE WHEN first < version_id AND first % 12 = 0 THEN 'requeue' WHEN first < version_id THEN 'duplicate' WHEN version_number > 1 THEN 'next_version' ELSE 'new' END AS decision FROM version JOIN (SELECT checksum, min(version_id) AS first FROM version GROUP BY ALL) USING (checksum)", "version"))
def register_or_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that is known already is queued again if its job failed in a way that can pass (here: each twelfth)."""
    v = T.versions(spark, sf_dir)
    first = v.groupBy("checksum").agg(F.min("version_id").alias("first"))
    known = F.col("first") < F.col("version_id")
    decision = F.when(known & (F.col("first") % 12 == 0), "requeue").when(known, "duplicate").when(F.col("version_number") > 1, "next_version").otherwise("new")
    return v.join(first, "checksum").select("version_id", decision.alias("decision"))


@query("er7_jn10_jn11_supersession", T.sql("SELECT o.o_custkey AS value_id, NOT bool_or(o.o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderpriority, o_custkey % 100)) AS superseded FROM orders o GROUP BY ALL"))
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    current = o.groupBy("o_orderpriority", F.col("o_custkey") % 100).agg(F.max("o_orderkey").alias("version_id"))
    return R.supersession(o.select(F.col("o_custkey").alias("value_id"), F.col("o_orderkey").alias("version_id")), current)


@query("wn1_ag9_jn15_keep_first", "SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS kept, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = T.read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kept"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1")


@query("wn2_wn13_jn13_oldest_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("wn9_longest_value_survives", "SELECT p_brand, max_by(p_name, (length(p_name), p_partkey)) AS survivor FROM part GROUP BY p_brand")
def longest_survives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("survivor"))


@query("er2_er4_attribute_upsert", "SELECT o_custkey, o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS first_text, arg_max(o_orderpriority, o_orderkey) AS last_type FROM orders GROUP BY ALL")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_text"), F.max_by("o_orderpriority", "o_orderkey").alias("last_type"))


@query("er9_attribute_merge", T.sql("SELECT lower(attribute) AS name, min_by(namespace, (CASE WHEN namespace = 'customer' THEN 0 ELSE 1 END, namespace)) AS survivor, count(DISTINCT namespace) AS n FROM value GROUP BY ALL HAVING count(DISTINCT namespace) > 1", "value"))
def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = T.values(spark, sf_dir).groupBy(F.lower("attribute").alias("name")).agg(F.min_by("namespace", F.struct(F.when(F.col("namespace") == "customer", 0).otherwise(1), "namespace")).alias("survivor"), F.countDistinct("namespace").alias("n"))
    return grouped.where("n > 1")


@query("er12_er14_singletons_and_overrides", T.sql("SELECT entity_id, CASE WHEN name = 'FRANCE' THEN 'country' WHEN entity_type = 'nation' THEN 'place' ELSE entity_type END AS entity_type FROM entity WHERE entity_type IN ('nation', 'region')", "entity"))
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name, by_type = F.create_map(F.lit("FRANCE"), F.lit("country")), F.create_map(F.lit("nation"), F.lit("place"))
    rows = T.entities(spark, sf_dir).where(F.col("entity_type").isin("nation", "region"))
    return rows.select("entity_id", F.coalesce(F.try_element_at(by_name, F.col("name")), F.try_element_at(by_type, F.col("entity_type")), "entity_type").alias("entity_type"))


@query("er1_er3_resolve_or_create", T.sql("SELECT DISTINCT lower(trim(s.s_name)) AS name, e.entity_id IS NULL AS created FROM supplier s LEFT JOIN entity e ON lower(trim(s.s_name)) = lower(trim(e.name)) AND e.entity_type = 'supplier' AND e.entity_id < 'supplier:5'", "entity"))
def resolve_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = T.entities(spark, sf_dir).where("entity_type = 'supplier' AND entity_id < 'supplier:5'").select(F.lower(F.trim("name")).alias("name"), F.lit(False).alias("known")).distinct()
    asked = T.read(spark, sf_dir, "supplier").select(F.lower(F.trim("s_name")).alias("name")).distinct()
    return asked.join(known, "name", "left").select("name", F.col("known").isNull().alias("created"))


@query("er17_sc48_register_uploads", T.sql("SELECT version_id, CASE WHEN first < version_id THEN 'duplicate' WHEN version_number > 1 THEN 'next_version' ELSE 'new' END AS decision FROM version JOIN (SELECT checksum, min(version_id) AS first FROM version GROUP BY ALL) USING (checksum)", "version"))
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.versions(spark, sf_dir)
    first = v.groupBy("checksum").agg(F.min("version_id").alias("first"))
    return v.join(first, "checksum").select("version_id", F.when(F.col("first") < F.col("version_id"), "duplicate").when(F.col("version_number") > 1, "next_version").otherwise("new").alias("decision"))


def _named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("group"), F.col("p_name").alias("value"))


@query("ag28_ag29_collapse_statistics", "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS before, count(DISTINCT round(c_acctbal / 100)) AS after FROM customer GROUP BY ALL) SELECT CAST(sum(before - after) AS BIGINT) AS removed, count_if(before > after) AS affected, count(*) AS attributes FROM c")
def rounded_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("before"), F.countDistinct(F.round(F.col("c_acctbal") / 100)).alias("after"))
    return c.agg(F.sum(F.col("before") - F.col("after")).alias("removed"), F.count_if(F.col("before") > F.col("after")).alias("affected"), F.count(F.lit(1)).alias("attributes"))


@query("er5_jn18_collapse_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collapse_near_duplicates(_named_parts(spark, sf_dir))


@query("ag28_collapse_statistics")
def collapse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collapse of near-duplicates removes: values gone, and attributes that lost any."""
    parts = _named_parts(spark, sf_dir)
    return R.collapse_statistics(parts, R.collapse_near_duplicates(parts))


@query("sc1_er16_normalized_values")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.values(spark, sf_dir).select("entity_id", "attribute", normalize_value("value").alias("value_norm")).distinct()


@query("er16_normalization_migration", """
WITH v AS (SELECT p_partkey AS value_id, p_brand AS entity_id, p_size AS attribute_id, repeat(' ', p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE replace(p_name, ' ', '  ') END AS value FROM part),
n AS (SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS value_norm FROM v),
k AS (SELECT entity_id, attribute_id, value_norm, arg_max(value_id, (length(value), length(regexp_replace(value, '[^A-Z]', '', 'g')), CAST(value_id AS VARCHAR))) AS value_id, arg_max(value, (length(value), length(regexp_replace(value, '[^A-Z]', '', 'g')), CAST(value_id AS VARCHAR))) AS value FROM n GROUP BY ALL)
SELECT k.*, count(DISTINCT l_orderkey) AS versions, coalesce(min(l_orderkey), 0) AS first_version, CAST(coalesce(sum(DISTINCT l_orderkey), 0) AS BIGINT) AS versions_sum
FROM k JOIN n USING (entity_id, attribute_id, value_norm) LEFT JOIN lineitem ON l_partkey = n.value_id GROUP BY ALL""")
def normalization_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values made unique by their normalised text; a value's versions are the orders that its rows were told in."""
    spelt = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")))
    blanks = F.expr("repeat(' ', CAST(p_partkey % 3 AS INT))")
    values = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("value_id"), F.col("p_brand").alias("entity_id"), F.col("p_size").alias("attribute_id"), F.concat(blanks, spelt).alias("value"))
    kept, provenance = R.normalized_uniqueness(values, T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value_id"), F.col("l_orderkey").alias("version_id")))
    told = provenance.groupBy("value_id").agg(F.count(F.lit(1)).alias("versions"), F.min("version_id").alias("first_version"), F.sum("version_id").alias("versions_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return kept.join(told, "value_id", "left").select("value_id", "entity_id", "attribute_id", "value", "value_norm", zero("versions"), zero("first_version"), zero("versions_sum"))
