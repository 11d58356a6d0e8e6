"""Queries of messages, model answers, addresses and routing, and of small predicates, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import terms
from ..operators import graph as G
from ..operators import retrieval as R
from ..sources import tables as T
from .base import query

MESSAGES = """CASE event_id % 6 WHEN 0 THEN 'Please CANCEL that' WHEN 1 THEN '  Ann.Lee' || event_id || '@Mail.Example.COM ' WHEN 2 THEN 'stop@example.org' WHEN 3 THEN 'two..dots@example.org' WHEN 4 THEN 'oh, never mind' ELSE 'ann@localhost' END"""


@query("sc25_sc26_messages", f"SELECT event_id, event_id % 6 IN (0, 4) AS cancels, CASE event_id % 6 WHEN 1 THEN 'Ann.Lee' || event_id || '@mail.example.com' WHEN 2 THEN 'stop@example.org' END AS email FROM (SELECT event_id, {MESSAGES} AS m FROM events)")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "events").select("event_id", F.expr(MESSAGES).alias("m"))
    return rows.select("event_id", A.cancels(F.col("m")).alias("cancels"), A.email(F.col("m")).alias("email"))


@query("sc40_classification", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'OUT_OF_SCOPE' WHEN event_type = 'error' THEN 'OUT_OF_SCOPE' ELSE 'DOMAIN_REQUEST' END AS category,
       CASE WHEN event_id % 5 IN (0, 1) OR event_id % 7 = 0 THEN 'UNKNOWN' ELSE 'CREATE_TICKET' END AS intent, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0.0 ELSE least(1.0, user_id / 20.0) END AS confidence FROM events""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which some are no JSON, no object, or have no number as confidence."""
    k = F.col("event_id") % 5
    body = F.concat(F.lit('{"request_category":"'), F.when(F.col("event_type") == "error", "NONSENSE").otherwise("DOMAIN_REQUEST"), F.lit('","intent":"'), F.when(F.col("event_id") % 7 == 0, "SING").otherwise("CREATE_TICKET"), F.lit('","intent_confidence":'), F.when(k == 2, '"high"').otherwise((F.col("user_id") / 20.0).cast("string")), F.lit("}"))
    text = F.when(k == 0, "{oops").when(k == 1, "[1, 2]").otherwise(body)
    return T.read(spark, sf_dir, "events").select("event_id", A.parse_classification(text).alias("c")).select("event_id", "c.category", "c.intent", "c.confidence")


@query("sc46_intent_routing", """
WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GREETING' ELSE 'DOMAIN_REQUEST' END AS category, CASE event_type WHEN 'error' THEN 'UNKNOWN' WHEN 'click' THEN 'CREATE_TICKET' WHEN 'view' THEN 'CHECK_TICKET_STATUS' ELSE 'KNOWLEDGE_QUERY' END AS intent, event_id % 10 / 10.0 AS confidence, CAST(user_id % 4 AS INTEGER) AS attempts FROM events),
d AS (SELECT *, CASE WHEN category <> 'DOMAIN_REQUEST' THEN 'end' WHEN intent = 'CHECK_TICKET_STATUS' THEN 'status' WHEN intent = 'UNKNOWN' AND attempts + 1 >= 3 THEN 'escalate' WHEN intent = 'UNKNOWN' OR confidence < 0.8 THEN 'clarify' ELSE 'route' END AS way FROM c)
SELECT event_id, CASE way WHEN 'escalate' THEN 'ticket_agent' WHEN 'status' THEN 'ticket_status_agent' WHEN 'route' THEN CASE intent WHEN 'CREATE_TICKET' THEN 'ticket_agent' ELSE 'knowledge_agent' END ELSE 'none' END AS next_agent,
       CASE WHEN way = 'escalate' THEN 'escalation' WHEN way = 'route' AND intent = 'CREATE_TICKET' THEN 'standard' END AS ticket_type, way = 'clarify' AS clarify, CASE WHEN way IN ('escalate', 'clarify') THEN attempts + 1 ELSE 0 END AS attempts FROM d""")
def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_id") % 4 == 0, "GREETING").otherwise("DOMAIN_REQUEST")
    intent = F.when(F.col("event_type") == "error", "UNKNOWN").when(F.col("event_type") == "click", "CREATE_TICKET").when(F.col("event_type") == "view", "CHECK_TICKET_STATUS").otherwise("KNOWLEDGE_QUERY")
    route = A.decide_route(category, intent, F.col("event_id") % 10 / 10.0, (F.col("user_id") % 4).cast("int"))
    return T.read(spark, sf_dir, "events").select("event_id", route.alias("r")).select("event_id", "r.next_agent", "r.ticket_type", "r.clarify", "r.attempts")


@query("sc41_pf25_query_extraction", """
SELECT event_id, CASE WHEN event_id % 6 IN (1, 2, 3, 4) THEN event_type END AS entity_type, CAST(CASE event_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS n_filters,
       CASE WHEN event_id % 6 IN (1, 2) THEN 0.75 WHEN event_id % 6 = 3 THEN 0.0 END AS confidence, event_id % 6 IN (1, 2, 3) AS valid FROM events""")
def query_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No JSON; a fenced object with one filter; a list of a filter and a broken one; no confidence; one over 1; an array."""
    start = F.concat(F.lit('{"entity_type":" '), F.col("event_type"), F.lit('","attribute":" "'))
    texts = F.array(F.lit("nothing"), F.concat(F.lit("```json\n"), start, F.lit(',"filters":{"field":"a","value":"b"},"confidence":0.75}\n```')), F.concat(start, F.lit(',"filters":[{"field":"a","value":"b"},{"field":"x"}],"confidence":0.75}')), F.concat(start, F.lit("}")), F.concat(start, F.lit(',"confidence":1.5}')), F.lit("[1]"))
    parsed = A.parse_query(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")))
    return T.read(spark, sf_dir, "events").select("event_id", parsed.alias("q")).select("event_id", "q.entity_type", F.size("q.filters").alias("n_filters"), "q.confidence", "q.valid")


@query("sc47_strategy_of_query", "SELECT event_id, CASE WHEN event_id % 6 IN (1, 2, 3, 4) THEN 'hybrid' ELSE 'vector' END AS strategy FROM events")
def strategy_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the type of entity that the parsed query names; no JSON, and no object, name none."""
    start = F.concat(F.lit('{"entity_type":" '), F.col("event_type"), F.lit('","confidence":0.5'))
    texts = F.array(F.lit("nothing"), F.concat(F.lit("```json\n"), start, F.lit("}\n```")), F.concat(start, F.lit(',"filters":[]}')), F.concat(start, F.lit("}")), F.concat(start, F.lit(',"attribute":"x"}')), F.lit('{"entity_type":"  ","confidence":1}'))
    parsed = A.parse_query(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")))
    return T.read(spark, sf_dir, "events").select("event_id", A.strategy(parsed["entity_type"]).alias("strategy"))


@query("sc42_rewrite_and_answer", """SELECT event_id, CASE event_id % 9 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS rewritten_text, CAST(CASE event_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS INTEGER) AS n_references,
CASE event_id % 9 WHEN 5 THEN event_type WHEN 6 THEN event_type END AS answer, CASE event_id % 9 WHEN 5 THEN event_id % 2 = 0 WHEN 6 THEN TRUE END AS is_grounded, CASE event_id % 9 WHEN 5 THEN '1,' || user_id WHEN 6 THEN '' END AS citations FROM events""")
def rewrite_and_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites: whole, without references, with a number among them, blank, with references that are none; answers: whole,
    without indices, with true among them, not told whether grounded.
    """
    rewrite = F.concat(F.lit('{"rewritten_text":" '), F.col("event_type"), F.lit('\\n"'))
    answer = F.concat(F.lit('{"answer":"'), F.col("event_type"), F.lit(' "'))
    truth, user = (F.col("event_id") % 2 == 0).cast("string"), F.col("user_id").cast("string")
    texts = F.array(
        F.concat(F.lit("```json\n"), rewrite, F.lit(',"resolved_references":["it","that"]}\n```')), F.concat(rewrite, F.lit("}")), F.concat(rewrite, F.lit(',"resolved_references":["it",1]}')), F.lit('{"rewritten_text":"  "}'), F.concat(rewrite, F.lit(',"resolved_references":null}')),
        F.concat(answer, F.lit(',"is_grounded":'), truth, F.lit(',"citation_indices":[1,'), user, F.lit("]}")), F.concat(answer, F.lit(',"is_grounded":true}')), F.concat(answer, F.lit(',"is_grounded":true,"citation_indices":[1,true]}')), F.concat(answer, F.lit(',"is_grounded":"yes"}')),
    )
    text = F.element_at(texts, (F.col("event_id") % 9 + 1).cast("int"))
    rows = T.read(spark, sf_dir, "events").select("event_id", A.parse_rewrite(text).alias("r"), A.parse_answer(text).alias("a"))
    indices = F.array_join(F.transform("a.citation_indices", lambda i: i.cast("string")), ",")
    return rows.select("event_id", "r.rewritten_text", F.when(F.col("r").isNotNull(), F.size("r.resolved_references")).alias("n_references"), "a.answer", "a.is_grounded", indices.alias("citations"))


OCTETS = [
    "CASE event_id % 8 WHEN 0 THEN 10 WHEN 1 THEN 127 WHEN 2 THEN 169 WHEN 3 THEN 100 WHEN 4 THEN 172 WHEN 5 THEN 192 WHEN 6 THEN 224 + event_id % 32 ELSE 8 END AS a",
    "CASE event_id % 8 WHEN 2 THEN 253 + event_id % 3 WHEN 3 THEN 60 + event_id % 70 WHEN 4 THEN event_id % 40 WHEN 5 THEN 160 + event_id % 16 ELSE event_id % 256 END AS b",
    "event_id % 256 AS c", "user_id % 256 AS d",
]


@query("pf24_unsafe_addresses", f"""
SELECT event_id, CASE WHEN b > 255 THEN 'not an address' WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a BETWEEN 224 AND 239 THEN 'multicast' WHEN a >= 240 THEN 'reserved'
            WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'not globally routable' END AS unsafe FROM (SELECT event_id, {', '.join(OCTETS)} FROM events)""")
def unsafe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.read(spark, sf_dir, "events").select("event_id", *(F.expr(x) for x in OCTETS))
    address = F.concat(F.when(F.col("event_id") % 2 == 0, "::ffff:").otherwise(""), F.concat_ws(".", *(F.col(x).cast("string") for x in "abcd")))
    return parts.select("event_id", A.unsafe_address(address).alias("unsafe"))


@query("pf13_retry_ready", T.sql("SELECT job_id FROM job WHERE status = 'QUEUED' AND (job_id % 3 = 0 OR started_at + attempt_count * INTERVAL 1 HOUR <= TIMESTAMP '2024-01-03 00:00:00')", "job"))
def retry_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.jobs(spark, sf_dir).withColumn("next_attempt_at", F.expr("CASE WHEN job_id % 3 <> 0 THEN started_at + make_interval(0, 0, 0, 0, CAST(attempt_count AS INT)) END"))
    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return jobs.where((F.col("status") == "QUEUED") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at").cast("timestamp_ntz") <= now))).select("job_id")


@query("pf18_chunks_without_vectors", T.sql("SELECT chunk_id, version_id, length(text) AS n_chars FROM chunk", "chunk"))
def chunks_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(spark, sf_dir).select("chunk_id", "version_id", F.length("text").cast("long").alias("n_chars"))


@query("pf21_upload_references", "SELECT page_id, page_id % 3 = 0 AS is_file, url AS reference FROM pages")
def upload_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = T.read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("manual_upload://"), F.col("url"))).otherwise(F.col("url")).alias("r"))
    is_file = F.col("r").startswith("manual_upload://")
    return given.select("page_id", is_file.alias("is_file"), F.when(is_file, F.expr("substring(r, length('manual_upload://') + 1)")).otherwise(F.col("r")).alias("reference"))


@query("sc31_reported_scores", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE) + i FOR i IN range(len(embedding))]), 4) AS score FROM embeddings WHERE embedding IS NOT NULL")
def reported_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    other = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.col("label").cast("double") + i)
    from ..functions.vectors import cosine

    return e.select("vec_id", F.round(cosine(F.col("embedding"), other), 4).alias("score"))


@query("so2_top_k_fallback", "SELECT query_id, vec_id, CAST(rank AS BIGINT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 3")
def top_k_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each stated query without a threshold."""
    e = T.read(spark, sf_dir, "embeddings")
    scored = R.score(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe")), k=3)
    return R.top_hits(scored, threshold=-1.0, k=3, margin=0).select("query_id", F.col("chunk_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query("so4_newest_first", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS orders FROM orders GROUP BY ALL")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = T.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("age"), "o_orderkey"))).alias("a"))
    return listed.select("o_custkey", F.array_join(F.transform("a", lambda x: x["o_orderkey"]), ",").alias("orders"))


@query("st6_st7_word_sets", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'all', 'any', 'new') OR x = 'new'), list_filter(regexp_split_to_array(lower(p_type), '[^0-9a-z]+'), lambda x: length(x) >= 3)))), ' ') AS terms, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS in_order FROM (SELECT p_partkey, p_name, p_type, string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ') AS w FROM part)")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array_sort(F.array_union(terms(F.col("p_name")), terms(F.col("p_type"))))
    in_order = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")), " "))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(both, " ").alias("terms"), F.array_join(in_order, " ").alias("in_order"))


@query("st9_node_merge", T.sql("SELECT id, min(seen) AS seen FROM (SELECT entity_id AS id, 0 AS seen FROM entity WHERE entity_type = 'nation' UNION ALL SELECT source_id, 1 FROM relation UNION ALL SELECT target_id, 2 FROM relation) GROUP BY id", "entity", "relation"))
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on view, then those that two answers bring which are not on view yet."""
    r = T.relations(spark, sf_dir)
    shown = T.entities(spark, sf_dir).where("entity_type = 'nation'").select(F.col("entity_id").alias("id"), F.lit(0).alias("seen"))
    both = shown.unionByName(r.select(F.col("source_id").alias("id"), F.lit(1).alias("seen"))).unionByName(r.select(F.col("target_id").alias("id"), F.lit(2).alias("seen")))
    return both.groupBy("id").agg(F.min("seen").alias("seen"))


DEGREES = "d AS (SELECT e.entity_id, e.entity_type, count(r.a) AS degree, min(r.b) AS other FROM entity e LEFT JOIN (SELECT source_id AS a, target_id AS b FROM relation UNION SELECT target_id, source_id FROM relation) r ON e.entity_id = r.a GROUP BY ALL)"


@query("gr8_isolated_and_folded", T.sql("", "entity", "relation").rstrip() + f", {DEGREES} SELECT CASE degree WHEN 0 THEN 'isolated' ELSE other END AS at, entity_type, count(*) AS n FROM d WHERE degree <= 1 GROUP BY ALL")
def isolated_and_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a link, and nodes with one folded into their neighbour, by type."""
    return G.isolated_and_folded(T.entities(spark, sf_dir), G.undirected(T.relations(spark, sf_dir, distinct=False), distinct=False))


@query("gr11_depth_filter", T.sql("", "relation").rstrip() + ", e AS (SELECT source_id AS a, target_id AS b FROM relation UNION SELECT target_id, source_id FROM relation), one AS (SELECT DISTINCT b AS node FROM e WHERE a = 'nation:3'), two AS (SELECT DISTINCT b AS node FROM e JOIN one ON a = node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT 'nation:3' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node")
def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all relations at most two links from a root; the root has depth 0."""
    start = T.entities(spark, sf_dir).where("entity_id = 'nation:3'")
    return G.reach(G.undirected(T.relations(spark, sf_dir, distinct=False), distinct=False), start, 2).select("node", F.col("depth").cast("int").alias("depth"))


QUESTIONS = "q(query_id, entity_id) AS (VALUES (1, 'nation:3'), (2, 'region:1'), (3, 'supplier:2'))"


@query("nl12_fact_constructors", T.sql("", "entity", "relation").rstrip() + f", {QUESTIONS} SELECT query_id, s.entity_id AS subject, relation_type AS attribute, t.name AS value, r.source_id = q.entity_id AS outgoing FROM q JOIN relation r ON q.entity_id IN (r.source_id, r.target_id) JOIN entity s ON r.source_id = s.entity_id JOIN entity t ON r.target_id = t.entity_id")
def fact_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of asked entities as facts of their sources: outgoing ones of the entity itself, incoming ones of others."""
    asked = F.broadcast(spark.createDataFrame([(1, "nation:3"), (2, "region:1"), (3, "supplier:2")], "query_id int, asked string"))
    r, names = T.relations(spark, sf_dir), T.entities(spark, sf_dir)
    out = r.join(asked, F.col("source_id") == F.col("asked")).withColumn("outgoing", F.lit(True))
    into = r.join(asked, F.col("target_id") == F.col("asked")).where("source_id <> target_id").withColumn("outgoing", F.lit(False))
    named = out.unionByName(into).join(names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("value")), "target_id")
    return named.join(names.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi").select("query_id", F.col("source_id").alias("subject"), F.col("relation_type").alias("attribute"), "value", "outgoing")


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query("str16_ticket_status", f"""WITH t AS (SELECT event_id, event_type AS status, {UUID} AS ticket_id FROM (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS h FROM events))
SELECT m.event_id, CASE WHEN m.event_id % 4 = 0 THEN 'no ticket id' WHEN t.status IS NULL THEN 'not found' ELSE t.status END AS answer FROM events m LEFT JOIN t ON m.event_id % 4 <> 0 AND t.event_id = m.event_id * 2""")
def ticket_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of the ticket whose id stands in a message; upper case and words around it don't matter."""
    e = T.read(spark, sf_dir, "events")
    made = lambda x: F.regexp_replace(F.md5(x.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    tickets = e.select(made(F.col("event_id")).alias("ticket_id"), F.col("event_type").alias("status"))
    text = F.when(F.col("event_id") % 4 == 0, "what about my ticket?").otherwise(F.concat(F.lit("status of "), F.upper(made(F.col("event_id") * 2)), F.lit(", please")))
    asked = e.select("event_id", F.lower(F.regexp_extract(text, "(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", 0)).alias("asked"))
    found = asked.join(tickets, F.col("asked") == F.col("ticket_id"), "left")
    return found.select("event_id", F.when(F.col("asked") == "", "no ticket id").otherwise(F.coalesce("status", F.lit("not found"))).alias("answer"))
