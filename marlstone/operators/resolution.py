"""Entity resolution and maintenance: merge plans, repointing, supersession, near-duplicate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capitals, normalize_name, normalize_value, strip
from ..sources.shared import written
from .near_values import collapse_near_duplicates as collapse_near_duplicates  # noqa: F401


def _mapped(names: dict[str, str], key: Column, other: Column) -> Column:
    """The name that `names` gives for key, else other."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key), other) if names else other


def canonical_type(entity_type: Column, synonyms: dict[str, str]) -> Column:
    """The type that a synonym (in lower case, one blank for white space) stands for; other types as they are."""
    return _mapped(synonyms, normalize_name(entity_type), entity_type)


def merge_plan(entities: DataFrame, fact_counts: DataFrame, synonyms: dict[str, str] | None = None, reviewed: dict[str, str] | None = None) -> DataFrame:
    """(name_norm, survivor, chosen_type, label, size) for each normalised name of two or more entities.

    The type is the one that `reviewed` gives for the name; else the canonical type that the fewest entities are stored
    with, of those entities with a fifth of the bucket's most facts (at least one; all if none has), then the one with
    more facts. The survivor has the most facts, then the chosen type, then a synonym of it, then the least id. The
    label is the name with most capitals, then the longest, then the last in order. Everything is counted by partial
    aggregates; no bucket is brought together.
    """
    frequency = entities.groupBy(F.col("entity_type").alias("canonical")).agg(F.count(F.lit(1)).alias("freq"))
    rows = entities.join(fact_counts, "entity_id", "left").select("entity_id", "entity_type", "name", F.coalesce("facts", F.lit(0)).alias("facts"), normalize_name(F.col("name")).alias("name_norm"), canonical_type(F.col("entity_type"), synonyms or {}).alias("canonical"))
    rows = rows.join(frequency, "canonical", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    buckets = rows.groupBy("name_norm").agg(F.count(F.lit(1)).alias("size"), F.max("facts").alias("top")).where("size >= 2")
    members = rows.join(buckets, "name_norm")
    supported = (F.col("top") == 0) | (F.col("facts") >= F.greatest(F.lit(1.0), F.col("top") * 0.2))
    rarest = F.min(F.when(supported, F.struct("freq", -F.col("facts"), "canonical", "entity_id")))["canonical"]
    chosen = members.groupBy("name_norm").agg(rarest.alias("rarest"))
    chosen = chosen.select("name_norm", _mapped(reviewed or {}, F.col("name_norm"), F.col("rarest")).alias("chosen_type"))
    typed = members.join(chosen, "name_norm")
    return typed.groupBy("name_norm", "chosen_type", "size").agg(
        F.min_by("entity_id", F.struct(-F.col("facts"), F.col("entity_type") != F.col("chosen_type"), F.col("canonical") != F.col("chosen_type"), F.col("entity_id"))).alias("survivor"),
        F.max_by("name", F.struct(capitals(F.col("name")), F.length("name"), F.col("entity_id"))).alias("label"),
    )


def merged_ids(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """(old_id, new_id) of the entities that merge_plan() merges into others."""
    named = entities.select(F.col("entity_id").alias("old_id"), normalize_name(F.col("name")).alias("name_norm"))
    return named.join(plan.select("name_norm", F.col("survivor").alias("new_id")), "name_norm").where("old_id <> new_id").select("old_id", "new_id")


def repointed(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """rows with the ids in some columns replaced where ids (old_id, new_id) has them."""
    for c in columns:
        moved = rows.join(ids.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")), F.col(c) == F.col("_old"), "left")
        rows = moved.withColumn(c, F.coalesce("_new", c)).select(*rows.columns)
    return rows


def repoint(values: DataFrame, id_map: DataFrame) -> DataFrame:
    """Values of merged entities moved to their survivors, one row for each (entity, attribute, normalised value), with its
    value_norm. The survivor's own row stays; of moved rows the one of the least entity, then the least text.
    """
    moved = repointed(values.withColumn("_from", F.col("entity_id")), id_map, "entity_id").withColumn("value_norm", normalize_value("value"))
    rest = [c for c in values.columns if c not in ("entity_id", "attribute")]
    order = F.struct(F.col("_from") != F.col("entity_id"), F.col("_from"), F.col("value"))
    best = moved.groupBy("entity_id", "attribute", "value_norm").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*(F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in values.columns), "value_norm")


def normalized_uniqueness(values: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values with value_norm, provenance): values (value_id, entity_id, attribute_id, value) made unique by
    (entity_id, attribute_id, value_norm), and provenance (value_id, version_id) moved to the rows that stay.

    Of rows that agree the one with the longest text stays, then with most capitals, then with the greatest id as text.
    Its provenance is the union of all of theirs, without repeats; that of values that are not there goes.
    """
    rows = values.select("value_id", "entity_id", "attribute_id", "value").where("value IS NOT NULL").withColumn("value_norm", normalize_value("value"))
    order = F.struct(F.length("value"), capitals(F.col("value")), F.col("value_id").cast("string"))
    key = ["entity_id", "attribute_id", "value_norm"]
    kept = written(rows.groupBy(*key).agg(F.max_by(F.struct("value_id", "value"), order).alias("_row")).select("_row.value_id", *key[:2], "_row.value", "value_norm"))
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}"))
    moved = rows.alias("o").join(kept.alias("k"), same(key[0]) & same(key[1]) & same(key[2])).select(F.col("o.value_id").alias("old_id"), F.col("k.value_id").alias("new_id"))
    union = provenance.join(moved, F.col("value_id") == F.col("old_id")).select(F.col("new_id").alias("value_id"), "version_id").distinct()
    return kept, union


def resolve_or_create(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(name_norm, entity_id, created) of each name asked for: the oldest entity (least seq) of that name, without regard to
    case, blanks around it and type; else a new one, whose id is a hash of the name.
    """
    norm = F.lower(strip(F.col("name"))).alias("name_norm")
    known = entities.select(norm, "entity_id", "seq").groupBy("name_norm").agg(F.min_by("entity_id", F.struct("seq", "entity_id")).alias("known"))
    rows = asked.select(norm).distinct().join(known, "name_norm", "left")
    return rows.select("name_norm", F.coalesce("known", F.concat(F.lit("new:"), F.md5(F.col("name_norm").cast("binary")))).alias("entity_id"), F.col("known").isNull().alias("created"))


def first_of(rows: DataFrame, key: str, *same: str) -> DataFrame:
    """Of rows that agree in `same` the one with the least key; key, same and no other columns."""
    return rows.groupBy(*same).agg(F.min(key).alias(key))


def attribute_plan(attributes: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(old_id, new_id, namespace): attributes (attribute_id, namespace, name) that agree in canonical namespace and in name
    without regard to case, with the one they become: one that has the canonical namespace, else the least id.
    """
    name = F.lower(strip(F.col("name"))).alias("name_norm")
    rows = attributes.select("attribute_id", "namespace", canonical_type(F.col("namespace"), synonyms).alias("canonical"), name)
    new = rows.groupBy("canonical", "name_norm").agg(F.min_by("attribute_id", F.struct(F.col("namespace") != F.col("canonical"), F.col("attribute_id"))).alias("new_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(new, ["canonical", "name_norm"]).select(F.col("attribute_id").alias("old_id"), "new_id", F.col("canonical").alias("namespace"))


def reconcile(entities: DataFrame, relations: DataFrame, attributes: DataFrame, values: DataFrame, synonyms: dict[str, str], reviewed: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables after merging, and a report of one row: entities, then their types, relations, attributes, values.

    entities (entity_id, entity_type, name), relations (relation_id, source_id, target_id, relation_type), attributes
    (attribute_id, namespace, name), values (value_id, entity_id, attribute_id, value). A stored type that is a synonym is
    replaced by its canonical one last, also on a survivor. Values are one where their normalised texts are (column
    value_norm of the result): a row that is not moved stays before moved ones, then the least value_id. Counters of
    normalised rows count all rows as given; those of relations and values count what goes because an equal row stays.
    """
    facts = values.groupBy("entity_id").agg(F.count(F.lit(1)).alias("facts"))
    plan = written(merge_plan(entities, facts, synonyms, reviewed))
    ids = written(merged_ids(entities, plan))
    canonical = canonical_type(F.col("entity_type"), synonyms)
    kept = entities.join(ids, F.col("entity_id") == F.col("old_id"), "left_anti")
    kept = kept.join(plan.select(F.col("survivor").alias("entity_id"), "chosen_type", "label"), "entity_id", "left")
    kept = kept.select("entity_id", F.when(canonical != F.col("entity_type"), canonical).otherwise(F.coalesce("chosen_type", "entity_type")).alias("entity_type"), F.coalesce("label", "name").alias("name"))
    links = written(first_of(repointed(relations, ids, "source_id", "target_id"), "relation_id", "source_id", "target_id", "relation_type"))
    moved = written(attribute_plan(attributes, synonyms))
    gone = moved.where("old_id <> new_id").select("old_id", "new_id")
    namespace = canonical_type(F.col("namespace"), synonyms)
    left = attributes.join(gone, F.col("attribute_id") == F.col("old_id"), "left_anti").select("attribute_id", namespace.alias("namespace"), "name")
    own = values.select("value_id", "entity_id", "attribute_id", "value", F.struct("entity_id", "attribute_id").alias("_from"))
    facts = repointed(repointed(own, ids, "entity_id"), gone, "attribute_id").withColumn("value_norm", normalize_value("value"))
    order = F.struct(F.col("_from") != F.struct("entity_id", "attribute_id"), F.col("value_id"))
    facts_left = facts.groupBy("entity_id", "attribute_id", "value_norm").agg(F.min_by(F.struct("value_id", "value"), order).alias("_row"))
    facts_left = written(facts_left.select("_row.value_id", "entity_id", "attribute_id", "_row.value", "value_norm"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = n(ids, "entities_merged").crossJoin(n(entities.where(canonical != F.col("entity_type")), "entities_normalized")).crossJoin(n(gone, "attributes_merged"))
    report = report.crossJoin(n(attributes.where(namespace != F.col("namespace")), "attributes_normalized")).crossJoin(n(relations, "r")).crossJoin(n(links, "r_left")).crossJoin(n(values, "v")).crossJoin(n(facts_left, "v_left"))
    report = report.select("entities_merged", "entities_normalized", "attributes_merged", "attributes_normalized", (F.col("r") - F.col("r_left")).alias("relations_deduped"), (F.col("v") - F.col("v_left")).alias("values_deduped"))
    return {"entities": kept, "relations": links, "attributes": left, "values": facts_left}, report


def supersession(provenance: DataFrame, current: DataFrame) -> DataFrame:
    """(value_id, superseded): true if no current version asserts the value. provenance (value_id, version_id), current
    (version_id); a value without provenance has no row and is left as it was.
    """
    marked = provenance.join(current.select(F.col("version_id").alias("current_id")).distinct(), F.col("version_id") == F.col("current_id"), "left")
    return marked.groupBy("value_id").agg((~F.max(F.col("current_id").isNotNull())).alias("superseded"))


def collapse_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(removed, affected, attributes): rows (group, value) that a collapse took away, groups that lost any, all groups."""
    n = lambda df, name: df.where("value IS NOT NULL").groupBy("group").agg(F.count(F.lit(1)).alias(name))
    both = n(before, "n").join(n(after, "m").withColumnRenamed("group", "kept_group"), F.col("group").eqNullSafe(F.col("kept_group")))
    return both.agg(F.coalesce(F.sum(F.col("n") - F.col("m")), F.lit(0)).alias("removed"), F.count_if(F.col("n") > F.col("m")).alias("affected"), F.count(F.lit(1)).alias("attributes"))
