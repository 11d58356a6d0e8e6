"""Entity-attribute-value lookup: facts of entities by attribute or relation, with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Entities that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def resolve(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id, ...): entities that a query names, without regard to case; if none has the query's type too,
    those that have the name alone.
    """
    named = entities.join(queries, F.lower("name") == F.lower("q_name"))
    tier = F.when(F.col("q_type").isNull() | (F.lower("entity_type") == F.lower("q_type")), 0).otherwise(1)
    found = named.withColumn("tier", tier).withColumn("best", F.min("tier").over(W.partitionBy("query_id")))
    return found.where("tier = best").drop("best")


def facts(values: DataFrame, relations: DataFrame, entities: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(entity_id, branch, attribute, value): current values, then outgoing relations with their targets' names, then
    incoming ones with their sources' names; with `of` only those of the entities it names (entity_id), which is applied
    where rows are read: relations may then repeat, as they are made distinct behind it, and before names are joined.
    """
    if of is not None:
        ids = written(of.select(F.col("entity_id").alias("wanted")).distinct())
        small = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        only = lambda df, c: df.join(F.broadcast(ids) if small else ids, F.col(c) == F.col("wanted"), "left_semi")
    else:
        only = lambda df, c: df
    names = entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name"))
    own = only(values.where(~F.col("superseded")), "entity_id").select("entity_id", F.lit(0).alias("branch"), "attribute", "value")
    end = lambda branch, own_id, with_id: F.struct(F.col(own_id).alias("entity_id"), F.lit(branch).alias("branch"), F.col("relation_type").alias("attribute"), F.col(with_id).alias("with_id"))
    ends = only(relations.select(F.explode(F.array(end(1, "source_id", "target_id"), end(2, "target_id", "source_id"))).alias("e")).select("e.*"), "entity_id")
    related = (ends if of is None else ends.distinct()).join(names, F.col("with_id") == F.col("other"))
    return own.unionByName(related.select("entity_id", "branch", "attribute", F.col("other_name").alias("value")))


def lookup(resolved: DataFrame, all_facts: DataFrame) -> DataFrame:
    """Facts of the resolved entities with the query's attribute; all facts of a query whose attribute has none."""
    joined = resolved.select("query_id", "entity_id", "q_attribute").join(all_facts, "entity_id")
    tier = F.when(F.col("q_attribute").isNull() | (F.lower("attribute") == F.lower("q_attribute")), 0).otherwise(1)
    found = joined.withColumn("tier", tier).withColumn("best", F.min("tier").over(W.partitionBy("query_id")))
    return found.where("tier = best").select("query_id", "entity_id", "branch", "attribute", "value", F.col("tier").alias("fallback"))
