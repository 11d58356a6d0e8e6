"""Queries of listings, counts, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import extraction
from ..sources import tables as T
from .base import query


@query("ag1_table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "customer", "events"):
        part = T.read(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("ag2_facts_per_entity", T.sql("SELECT e.entity_id, count(v.value) AS fact_count FROM entity e LEFT JOIN value v ON e.entity_id = v.entity_id GROUP BY ALL", "entity", "value"))
def facts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.values(spark, sf_dir).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return T.entities(spark, sf_dir).join(counts, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).cast("long").alias("fact_count"))


@query("ag3_jobs_by_status", T.sql("SELECT status, failure_kind, count(*) AS n FROM job GROUP BY ALL", "job"))
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.jobs(spark, sf_dir).groupBy("status", "failure_kind").agg(F.count(F.lit(1)).alias("n"))


@query("ag4_ag26_entities_by_type", T.sql("SELECT entity_type, count(*) AS n FROM entity GROUP BY ALL ORDER BY n DESC, entity_type", "entity"))
def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entities(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_type")


@query("ag5_jn9_source_listing", T.sql("SELECT s.source_id, s.is_active, coalesce(n, 0) AS chunk_count FROM source s LEFT JOIN (SELECT source_id, count(*) AS n FROM chunk JOIN version USING (version_id) GROUP BY ALL) c ON s.source_id = c.source_id", "version", "source", "chunk"))
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.chunks(spark, sf_dir).select("version_id").join(T.versions(spark, sf_dir), "version_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return T.sources(spark, sf_dir).join(counts, "source_id", "left").select("source_id", "is_active", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))


@query("ag6_ag7_next_version", T.sql("SELECT s.source_id, CAST(coalesce(max(version_number), 0) + 1 AS BIGINT) AS next_version FROM source s LEFT JOIN version v ON s.source_id = v.source_id AND v.status = 'INDEXED' GROUP BY ALL", "version", "source"))
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = T.versions(spark, sf_dir).where("status = 'INDEXED'").groupBy("source_id").agg(F.max("version_number").alias("top"))
    return T.sources(spark, sf_dir).join(indexed, "source_id", "left").select("source_id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("next_version"))


@query("ag8_duplicate_checksums", T.sql("SELECT checksum, count(*) AS n FROM version GROUP BY checksum HAVING count(*) > 1", "version"))
def duplicate_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.versions(spark, sf_dir).groupBy("checksum").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("ag11_distinct_entities", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey")
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"))


@query("ag12_ordered_distinct_values", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_key) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = T.read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
    made = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("first_key", "o_orderpriority"))).alias("a"))
    return made.select("o_custkey", F.array_join(F.transform("a", lambda x: x["o_orderpriority"]), ",").alias("priorities"))


@query("ag13_multivalue_attributes", "SELECT o_orderstatus AS attribute, max(n) > 1 AS multivalue FROM (SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = T.read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("n"))
    return counted.groupBy(F.col("o_orderstatus").alias("attribute")).agg(F.bool_or(F.col("n") > 1).alias("multivalue"))


@query("ag14_window_merge", "SELECT conv_id, min_by(entity, turn) FILTER (WHERE entity IS NOT NULL) AS entity, array_to_string(flatten(list(facts ORDER BY turn)), '|') AS facts FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role || turn END AS entity, [role || turn, CAST(length(text) AS VARCHAR)] AS facts FROM conversations) GROUP BY conv_id")
def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the windows of one chunk: the first entity that any of them names, and the facts of all in order."""
    name = F.concat("role", F.col("turn").cast("string"))
    windows = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", name).alias("entity"), F.array(name, F.length("text").cast("string")).alias("facts"))
    first = F.min_by("entity", F.when(F.col("entity").isNotNull(), F.col("turn")))
    made = windows.groupBy("conv_id").agg(first.alias("entity"), F.array_sort(F.collect_list(F.struct("turn", "facts"))).alias("a"))
    return made.select("conv_id", "entity", F.array_join(F.flatten(F.transform("a", lambda x: x["facts"])), "|").alias("facts"))


@query("udf5_merged_facts", "SELECT conv_id, array_to_string(flatten(list([role || turn, CAST(length(text) AS VARCHAR)] ORDER BY turn)), '|') AS facts FROM conversations GROUP BY conv_id")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge by an aggregate function of our own."""
    facts = F.array(F.concat("role", F.col("turn").cast("string")), F.length("text").cast("string"))
    rows = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", facts.alias("facts"))
    return rows.groupBy("conv_id").agg(extraction.merged_facts("turn", "facts").alias("facts"))


@query("ag25_top_and_rest", "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rn FROM c) SELECT CASE WHEN rn <= 10 THEN p_type ELSE 'other' END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL")
def top_and_rest(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    counts = T.read(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    head = counts.orderBy(F.desc("n"), "p_type").limit(top).select(F.col("p_type").alias("bucket"), F.lit(True).alias("is_top"))
    joined = counts.join(F.broadcast(head), F.col("p_type") == F.col("bucket"), "left")
    return joined.groupBy(F.coalesce("bucket", F.lit("other")).alias("bucket")).agg(F.sum("n").alias("n"))


@query("ag27_page_counts", "SELECT count(*) AS pages, count_if(url LIKE 'https:%') AS secure, count_if(html LIKE '%<h1>%') AS with_heading FROM pages")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("url").startswith("https:")).alias("secure"), F.count_if(F.col("html").contains("<h1>")).alias("with_heading"))


@query("jn2_sources_with_categories", "SELECT c_custkey, n_name AS category, l.quality FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey LEFT JOIN labels l ON c_custkey = l.doc_id")
def sources_with_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions that a row may lack: nations of one region are not listed, and only some keys have a label."""
    nation = T.read(spark, sf_dir, "nation").where("n_regionkey <> 2").select("n_nationkey", F.col("n_name").alias("category"))
    labels = T.read(spark, sf_dir, "labels").select("doc_id", "quality")
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(labels, F.col("c_custkey") == F.col("doc_id"), "left").select("c_custkey", "category", "quality")


@query("jn8_job_listing", "SELECT o_orderkey AS job_id, o_orderstatus AS status, c_name AS source FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of customers; a job whose source is gone stays, without a name."""
    source = T.read(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", F.col("c_name").alias("source"))
    jobs = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return jobs.join(source, F.col("o_custkey") == F.col("c_custkey"), "left").select("job_id", "status", "source")


@query("jn2_jn8_job_listing", T.sql("SELECT j.job_id, j.status, s.version_id AS latest FROM job j LEFT JOIN (SELECT * FROM version WHERE version_number = 1) s ON j.source_id = s.version_id", "job", "version"))
def first_version_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = T.versions(spark, sf_dir).where("version_number = 1").select(F.col("version_id").alias("latest"))
    return T.jobs(spark, sf_dir).join(first, F.col("source_id") == F.col("latest"), "left").select("job_id", "status", "latest")


@query("jn7_three_way_listing", T.sql("SELECT s.source_id, v.status, v.version_number, l.quality FROM source s LEFT JOIN version v ON s.current_version = v.version_id LEFT JOIN labels l ON v.version_id = l.doc_id", "version", "source"))
def three_way_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = T.read(spark, sf_dir, "labels").select("doc_id", "quality")
    v = T.versions(spark, sf_dir).select("version_id", "version_number", "status")
    joined = T.sources(spark, sf_dir).join(v, F.col("current_version") == F.col("version_id"), "left").join(labels, F.col("version_id") == F.col("doc_id"), "left")
    return joined.select("source_id", "status", "version_number", "quality")


@query("jn20_nl20_domain_scope", T.sql("SELECT string_agg(source_id, ', ' ORDER BY current_version DESC) AS titles FROM (SELECT * FROM source s JOIN version v ON s.current_version = v.version_id WHERE is_active AND status = 'INDEXED' ORDER BY current_version DESC LIMIT 40)", "version", "source"))
def domain_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.versions(spark, sf_dir).where("status = 'INDEXED'").select("version_id")
    top = T.sources(spark, sf_dir).where("is_active").join(v, F.col("current_version") == F.col("version_id")).orderBy(F.desc("current_version")).limit(40)
    listed = top.agg(F.reverse(F.array_sort(F.collect_list(F.struct("current_version", "source_id")))).alias("a"))
    return listed.select(F.array_join(F.transform("a", lambda x: x["source_id"]), ", ").alias("titles"))


@query("pf8_prefix_count", "SELECT count(*) AS n FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).agg(F.count(F.lit(1)).alias("n"))


@query("pf12_pf15_status_sets", T.sql("SELECT version_id, status NOT IN ('INDEXED', 'STALE') AS fresh, lower(trim(status)) IN ('indexed', 'ready') AS usable FROM version", "version"))
def status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.versions(spark, sf_dir).select("version_id", (~F.col("status").isin("INDEXED", "STALE")).alias("fresh"), F.lower(F.trim("status")).isin("indexed", "ready").alias("usable"))


@query("pf16_non_terminal_sources", T.sql("SELECT DISTINCT v.source_id FROM version v JOIN job j ON v.version_id = j.source_id WHERE j.status IN ('QUEUED', 'RUNNING')", "version", "job"))
def non_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_jobs = T.jobs(spark, sf_dir).where(F.col("status").isin("QUEUED", "RUNNING")).select(F.col("source_id").alias("version_id"))
    return T.versions(spark, sf_dir).join(open_jobs, "version_id", "left_semi").select("source_id").distinct()


@query("pf17_so7_filtered_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = upper('f') ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == F.upper(F.lit("f"))).orderBy(F.desc("o_orderkey")).offset(100).limit(50).select("o_orderkey", "o_orderstatus")


@query("pf19_pf20_so6_pending_first", T.sql("SELECT job_id, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 0 ELSE 1 END AS done, coalesce(failure_kind, status) AS label FROM job ORDER BY done, started_at DESC NULLS LAST, job_id LIMIT 100", "job"))
def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.jobs(spark, sf_dir).select("job_id", F.when(F.col("status").isin("QUEUED", "RUNNING"), 0).otherwise(1).alias("done"), F.coalesce("failure_kind", "status").alias("label"), "started_at")
    return rows.orderBy("done", F.desc_nulls_last("started_at"), "job_id").limit(100).drop("started_at")


@query("pf28_domain_check", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'click', 'view') GROUP BY ALL")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").where(~F.col("event_type").isin("signup", "click", "view")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st5_sources_without_labels", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id").subtract(T.read(spark, sf_dir, "labels").select("doc_id"))


@query("st10_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(T.read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("so8_so12_longest_first", "SELECT p_partkey, p_name FROM part ORDER BY length(p_name) DESC, p_name, p_partkey LIMIT 25")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").orderBy(F.desc(F.length("p_name")), "p_name", "p_partkey").limit(25).select("p_partkey", "p_name")


@query("wn8_previous_version", T.sql("SELECT version_id, source_id, version_number, lag(version_id) OVER (PARTITION BY source_id ORDER BY version_number) AS previous FROM version", "version"))
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("version_id").over(W.partitionBy("source_id").orderBy("version_number"))
    return T.versions(spark, sf_dir).select("version_id", "source_id", "version_number", before.alias("previous"))


@query("st1_st4_undirected_ends", T.sql("SELECT DISTINCT source_id AS entity_id FROM relation UNION SELECT target_id FROM relation", "relation"))
def undirected_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.relations(spark, sf_dir)
    return r.select(F.col("source_id").alias("entity_id")).union(r.select("target_id")).distinct()


@query("src28_graph_export", T.sql("SELECT relation_type, source_id, md5(string_agg(source_id || '>' || target_id, ',' ORDER BY target_id)) AS links FROM relation GROUP BY ALL", "relation"))
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all relations in sorted chunks, one for each source, so that no list holds the whole graph."""
    rows = T.relations(spark, sf_dir).groupBy("relation_type", "source_id").agg(F.array_sort(F.collect_list("target_id")).alias("a"))
    return rows.select("relation_type", "source_id", F.md5(F.array_join(F.transform("a", lambda x: F.concat("source_id", F.lit(">"), x)), ",").cast("binary")).alias("links"))
