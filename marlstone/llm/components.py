"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node is a hub if it has more than this share of all rows (and more than LEAST_HUB); so there are 1,000 hubs at most.
HUB_SHARE, LEAST_HUB = 0.001, 500


def _with_least(rows: DataFrame, n: int, own: bool = False) -> DataFrame:
    """rows (u, v) with m, the least v of each u (with own, or u itself). The minima are made by partial sums. Hubs' rows
    stay where they are and get their minimum by a broadcast of at most 1 / HUB_SHARE rows; the others are joined.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if own:
        least = least.withColumn("m", F.least("u", "m"))
    is_hub = F.col("n") > max(int(HUB_SHARE * n), LEAST_HUB)
    hubs = cut(least.where(is_hub).select("u", "m"))
    if hubs.isEmpty():
        return rows.join(least.drop("n"), "u")
    hubs = F.broadcast(hubs)
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(least.where(~is_hub).drop("n"), "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n, own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("v"))
    return _with_least(down, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): each node that reaches a lesser one, with the least it reaches. Others have no row.

    Links are undirected; loops, nulls and repeats are ignored. Nodes can be of any type with an order. Every round ends
    in a written checkpoint; nothing but two numbers and whether there are hubs comes to the driver. Links of a node with
    very many are not brought together in one task.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    n, before = edges.count(), None
    for _ in range(most_rounds):
        edges = cut(_large_star(edges, n).distinct())
        edges = cut(_small_star(edges, edges.count()).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n, before = now[0], now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
