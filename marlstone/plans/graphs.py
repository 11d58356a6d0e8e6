"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import tables as T
from .base import query

EDGES = "edges AS (SELECT source_id AS a, target_id AS b FROM relation UNION SELECT target_id, source_id FROM relation)"


def _reach_sql(start: str, hops: int) -> str:
    levels = [f"l0 AS (SELECT '{start}' AS node, 0 AS depth)"]
    for d in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(d))
        levels.append(f"l{d} AS (SELECT DISTINCT b AS node, {d} AS depth FROM l{d - 1} JOIN edges ON node = a WHERE b NOT IN ({seen}))")
    return T.sql("", "relation").rstrip() + f", {EDGES}, {', '.join(levels)}, reached AS ({' UNION ALL '.join(f'SELECT * FROM l{i}' for i in range(hops + 1))})"


@query("gr4_gr7_gr9_k_hop_depths", _reach_sql("region:3", 3) + " SELECT node, CAST(depth AS INTEGER) AS depth FROM reached")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = T.entities(spark, sf_dir).where("entity_id = 'region:3'")
    return G.reach(G.undirected(T.relations(spark, sf_dir, distinct=False), distinct=False), start, 3).select("node", "depth")


def _path_sql(start: str, end: str, most_nodes: int) -> str:
    levels = [f"l0 AS (SELECT '{start}' AS node, ['{start}'] AS path)"]
    for d in range(1, most_nodes):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(d))
        levels.append(f"l{d} AS (SELECT b AS node, list_append(min(path), b) AS path FROM l{d - 1} JOIN edges ON node = a WHERE b NOT IN ({seen}) GROUP BY b)")
    found = " UNION ALL ".join(f"SELECT path FROM l{i} WHERE node = '{end}'" for i in range(most_nodes))
    return T.sql("", "relation", "entity").rstrip() + f", {EDGES}, {', '.join(levels)}, best AS ({found}) SELECT CAST(u.pos - 1 AS INTEGER) AS position, u.id AS entity_id, name FROM (SELECT unnest(path) AS id, unnest(range(1, len(path) + 1)) AS pos FROM best) u JOIN entity ON u.id = entity_id"


@query("gr6_jn24_so8_shortest_path", _path_sql("supplier:1", "supplier:2", 4))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two suppliers, by way of a nation or of a part that both provide."""
    path = G.shortest_path(G.undirected(T.relations(spark, sf_dir, distinct=False), distinct=False), "supplier:1", "supplier:2")
    return path.join(T.entities(spark, sf_dir), "entity_id").select("position", "entity_id", "name")


@query("jn16_recursive_walk", T.sql("", "relation").rstrip().replace("WITH", "WITH RECURSIVE", 1) + ", walk AS (SELECT 'customer:' || c_custkey AS start, 'customer:' || c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT start, target_id, depth + 1 FROM walk JOIN relation ON node = source_id WHERE depth < 3) SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL")
def recursive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk along the relations' direction from every customer: a recursive join, each level written once."""
    along = T.relations(spark, sf_dir, distinct=False).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return G.reach(along, T.entities(spark, sf_dir).where("entity_type = 'customer'"), 3)


@query("ag23_gr8_leaf_folds", T.sql("", "relation").rstrip() + f""", {EDGES}, leaf AS (SELECT id FROM (SELECT source_id AS id FROM relation UNION ALL SELECT target_id FROM relation) GROUP BY id HAVING count(*) = 1)
SELECT b AS hub, count(*) AS leaves FROM edges JOIN leaf ON a = id GROUP BY ALL HAVING count(*) >= 3""")
def leaf_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leaf_folds(T.entities(spark, sf_dir), T.relations(spark, sf_dir))


def _histogram(relations: DataFrame) -> DataFrame:
    kind = lambda c: F.substring_index(c, ":", 1)
    return relations.groupBy("relation_type", kind("source_id").alias("source_type"), kind("target_id").alias("target_type")).agg(F.count(F.lit(1)).alias("n"))


@query("gr10_cluster_grid", T.sql("SELECT entity_type, n, CAST((i % 5) * 150 AS BIGINT) AS x, CAST(i // 5 * 150 AS BIGINT) AS y FROM (SELECT *, row_number() OVER (ORDER BY entity_type) - 1 AS i FROM (SELECT entity_type, count(*) AS n FROM entity GROUP BY ALL))", "entity"))
def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.entities(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("i", F.row_number().over(W.orderBy("entity_type")) - 1)  # one row for each type
    return placed.select("entity_type", "n", (F.col("i") % 5 * 150).cast("long").alias("x"), (F.floor(F.col("i") / 5) * 150).alias("y"))


def _visible(spark: SparkSession, sf_dir: str, r: DataFrame) -> DataFrame:
    ends = r.select(F.col("source_id").alias("entity_id")).union(r.select("target_id"))
    counts = T.values(spark, sf_dir).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    shown = T.entities(spark, sf_dir).where("entity_type <> 'customer'").join(ends, "entity_id", "left_semi").join(counts, "entity_id", "left")
    return shown.select("entity_id", F.round(F.least(F.lit(14.0), 5 + 1.6 * F.sqrt(F.coalesce("n", F.lit(0)))), 4).alias("radius"))


@query("gr3_ag22_degrees", T.sql("SELECT e.entity_id, count(r.id) AS degree FROM entity e LEFT JOIN (SELECT source_id AS id FROM relation UNION ALL SELECT target_id FROM relation) r ON e.entity_id = r.id GROUP BY ALL", "entity", "relation"))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(T.entities(spark, sf_dir), T.relations(spark, sf_dir))


@query("gr5_induced_subgraph", T.sql("", "relation").rstrip() + """, edges AS (SELECT source_id AS a, target_id AS b FROM relation UNION SELECT target_id, source_id FROM relation),
one AS (SELECT 'nation:7' AS node UNION SELECT b FROM edges WHERE a = 'nation:7'), two AS (SELECT node FROM one UNION SELECT b FROM one JOIN edges ON node = a WHERE node LIKE 'supplier:%')
SELECT source_id, target_id FROM relation WHERE source_id IN (SELECT node FROM two) AND target_id IN (SELECT node FROM two)""")
def induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of a nation, its neighbours, and all that its suppliers provide."""
    edges = G.undirected(T.relations(spark, sf_dir, distinct=False), distinct=False)
    one = G.reach(edges, T.entities(spark, sf_dir).where("entity_id = 'nation:7'"), 1).select(F.col("node").alias("entity_id"))
    two = one.union(G.reach(edges, one.where(F.col("entity_id").startswith("supplier:")), 1).select("node"))
    return G.induced(T.relations(spark, sf_dir, distinct=False), two).select("source_id", "target_id").distinct()


@query("ag24_gr12_relation_histogram", T.sql("SELECT relation_type, split_part(source_id, ':', 1) AS source_type, split_part(target_id, ':', 1) AS target_type, count(*) AS n FROM relation GROUP BY ALL", "relation"))
def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(T.relations(spark, sf_dir))


@query("pf27_sc45_visible_nodes", T.sql("SELECT e.entity_id, round(least(14, 5 + 1.6 * sqrt(count(v.value))), 4) AS radius FROM entity e LEFT JOIN value v ON e.entity_id = v.entity_id WHERE entity_type <> 'customer' AND (e.entity_id IN (SELECT source_id FROM relation) OR e.entity_id IN (SELECT target_id FROM relation)) GROUP BY ALL", "entity", "value", "relation"))
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir, T.relations(spark, sf_dir))
