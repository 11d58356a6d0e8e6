"""Queries of vector search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import HashingEmbedder, embed
from ..functions.vectors import cosine
from ..operators import retrieval as R
from ..sources import tables as T
from ..sources.shared import written
from .base import query

#: The stated query set, as a condition that Spark and DuckDB both read; it grows with the table.
PROBES = "vec_id % 20 = 0"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "embeddings").where(PROBES).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.live_chunks(T.chunks(spark, sf_dir), T.versions(spark, sf_dir), T.sources(spark, sf_dir), current_only=False)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_hits(R.score(_live(spark, sf_dir).drop("text"), _queries(spark, sf_dir), threshold=0.2, k=R.TOP_K), threshold=0.2, margin=0.75)


LIVE = "live AS (SELECT c.*, s.source_id, version_number, site FROM chunk c JOIN version v USING (version_id) JOIN source s USING (source_id) WHERE status = 'INDEXED' AND is_active)"
SCORED = f"{LIVE}, scored AS (SELECT vec_id AS query_id, live.*, list_cosine_similarity(live.embedding, CAST(e.embedding AS DOUBLE[])) AS sim FROM live, embeddings e WHERE {PROBES})"
TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM scored WHERE sim >= 0.2) WHERE rank <= 8)"
HITS = f"{SCORED}, {TOP}, hits AS (SELECT * FROM (SELECT *, max(sim) OVER (PARTITION BY query_id) AS best FROM top) WHERE sim >= best - 0.75)"


def _with(text: str, tail: str) -> str:
    return T.sql("", "chunk", "version", "source").rstrip() + ", " + text + " " + tail


@query("nl9_vector_search", _with(HITS, "SELECT query_id, chunk_id, source_id, CAST(rank AS BIGINT) AS rank, round(sim, 4) AS score FROM hits"))
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "chunk_id", "source_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 4).alias("score"))


@query("jn1_live_corpus", T.sql("SELECT c.chunk_id, s.source_id, s.site, v.version_number, sha256(c.text) AS text_checksum FROM chunk c JOIN version v USING (version_id) JOIN source s USING (source_id) WHERE status = 'INDEXED' AND is_active AND v.version_id = s.current_version", "chunk", "version", "source"))
def live_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.live_chunks(T.chunks(spark, sf_dir), T.versions(spark, sf_dir), T.sources(spark, sf_dir))
    return rows.select("chunk_id", "source_id", "site", "version_number", F.sha2("text", 256).alias("text_checksum"))


@query("jn19_pf9_cosine_over_threshold", _with(SCORED, "SELECT query_id, chunk_id, round(sim, 4) AS sim FROM scored WHERE sim >= 0.25"))
def over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score(_live(spark, sf_dir).drop("text"), _queries(spark, sf_dir), threshold=0.25).select("query_id", "chunk_id", F.round("sim", 4).alias("sim"))


@query("sc29_cosine_within_label", "SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id AND a.label = b.label")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"), F.col("embedding").alias(x)) for x in "ab")
    joined = a.join(b, (F.col("a_id") + 1 == F.col("b_id")) & (F.col("a_label") == F.col("b_label")))
    return joined.select("a_id", "b_id", F.round(cosine(F.col("a"), F.col("b")), 4).alias("sim"))


FACTS = "facts AS (SELECT query_id, 'fact' AS kind, source_id AS item, max(1.0 - rank / 10.0) AS score FROM hits GROUP BY ALL)"
RANKED = f"{HITS}, {FACTS}, results AS (SELECT query_id, 'chunk' AS kind, CAST(chunk_id AS VARCHAR) AS item, 0.70 * sim + 0.10 * (version_number / (version_number + 1)) AS score FROM hits UNION ALL SELECT * FROM facts)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = written(_hits(spark, sf_dir))  # read twice below
    facts = hits.groupBy("query_id", F.col("source_id").alias("item")).agg(F.max(1.0 - F.col("rank") / 10.0).alias("confidence"))
    return R.deduplicated(R.ranked(hits, facts))


@query("so3_st8_hybrid_rank", _with(RANKED, "SELECT query_id, kind, item, round(score, 4) AS score FROM results"))
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("query_id", "kind", "item", F.round("score", 4).alias("score"))


@query("nl14_so9_context", _with(RANKED, """, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, item) AS n FROM results)
SELECT query_id, coalesce(string_agg(n || '. ' || item, chr(10) ORDER BY n) FILTER (WHERE kind = 'fact' AND n <= 20), 'No structured facts.') AS facts,
       coalesce(string_agg(n || '. ' || item, chr(10) ORDER BY n) FILTER (WHERE kind = 'chunk' AND n <= 12), 'No documentation.') AS chunks FROM placed GROUP BY query_id"""))
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context(_results(spark, sf_dir))


@query("jn21_checksum_reuse", T.sql("SELECT n.version_id, n.checksum, min(o.version_id) AS reused_from FROM version n LEFT JOIN version o ON n.checksum = o.checksum AND o.version_id < n.version_id GROUP BY ALL", "version"))
def checksum_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.versions(spark, sf_dir).select("version_id", "checksum")
    first = v.groupBy("checksum").agg(F.min("version_id").alias("first"))
    return v.join(first, "checksum").select("version_id", "checksum", F.when(F.col("first") < F.col("version_id"), F.col("first")).alias("reused_from"))


#: Dimension of the local embedder here, and the words that its instruction adds to each query.
SMALL, INSTRUCTION = 64, "find passages: "
HASHED = f"""word AS (SELECT kind, id, lower(unnest(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w FROM (
  SELECT 'c' AS kind, doc_id AS id, text FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'q', item_id, '{INSTRUCTION}' || text FROM benchmark)),
cell AS (SELECT kind, id, CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % {SMALL} AS place, CAST(sum(CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS UBIGINT) % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS x FROM word GROUP BY ALL),
norm AS (SELECT kind, id, sqrt(sum(x * x)) AS n FROM cell GROUP BY ALL)"""


def _embedded(spark: SparkSession, sf_dir: str, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    local = HashingEmbedder(SMALL)
    docs = T.read(spark, sf_dir, "documents").where("trim(text) <> ''").select(F.col("doc_id").alias("chunk_id"), "text")
    items = T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embed(docs, local, SMALL, normalize=normalize).drop("text"), embed(items, local, SMALL, instruction=INSTRUCTION, normalize=normalize, name="probe").drop("text")


@query("nl7_udf2_embedded_chunks", f"WITH {HASHED} SELECT id AS chunk_id, CAST(place AS BIGINT) AS place, round(x / n, 9) AS x FROM cell JOIN norm USING (kind, id) WHERE kind = 'c' AND x <> 0")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers other than zero of all chunks' vectors."""
    placed = _embedded(spark, sf_dir)[0].select("chunk_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0")
    return placed.select("chunk_id", F.col("place").cast("long").alias("place"), F.round("x", 9).alias("x"))


@query("nl8_query_instruction_search", f"WITH {HASHED}, sims AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.x * c.x) / (any_value(qn.n) * any_value(cn.n)), 12) AS sim FROM cell q JOIN cell c ON q.kind = 'q' AND c.kind = 'c' AND q.place = c.place JOIN norm qn ON qn.kind = 'q' AND qn.id = q.id JOIN norm cn ON cn.kind = 'c' AND cn.id = c.id GROUP BY ALL) SELECT query_id, chunk_id, round(sim, 6) AS score FROM sims WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= 3")
def instructed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, embedded with the instruction, against chunks that are embedded bare. Vectors stay whole numbers, whose
    products are exact, so that ties are ties.
    """
    chunks, queries = _embedded(spark, sf_dir, normalize=False)
    return R.top_hits(R.score(chunks, queries, threshold=0.3, k=3), threshold=0.3, k=3, margin=0).select("query_id", "chunk_id", F.round("sim", 6).alias("score"))
