"""Extraction results: batches of windows, split on rejection, answers matched to windows, facts, folds, upserts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip, value_type

# Windows of one request, and the namespace of extracted facts.
BATCH, NAMESPACE = 3, "general"


def batches(windows: DataFrame, document: str = "doc_id", place: str = "place", size: int = BATCH) -> DataFrame:
    """windows with batch and slot: windows of a document in order of place (from 0, across chunks), in groups of size."""
    return windows.withColumns({"batch": F.floor(F.col(place) / size).cast("long"), "slot": (F.col(place) % size).cast("int")})


def split_on_reject(windows: DataFrame, rejected: Callable[[], Column], document: str = "doc_id") -> DataFrame:
    """windows (of batches()) with lost.

    `rejected` gives an aggregate over the windows of one request that says whether the model turns it down for good. A
    request that is turned down is halved (the left half is the smaller) until it passes or is one window, which is
    lost. Each round asks all open requests of all documents at once; there are as many rounds as halvings of a batch.
    """
    request = [document, "batch", "low", "n"]
    rows = windows if "batch" in windows.columns else batches(windows, document)
    sized = rows.groupBy(document, "batch").agg(F.count(F.lit(1)).cast("int").alias("n"))
    todo = rows.join(sized, [document, "batch"]).withColumns({"low": F.lit(0), "lost": F.lit(False)})
    for _ in range(1 + (BATCH - 1).bit_length()):
        answered = todo.join(todo.groupBy(*request).agg(rejected().alias("no")), request)
        half = F.floor(F.col("n") / 2).cast("int")
        left, split = F.col("slot") < F.col("low") + half, F.col("no") & (F.col("n") > 1)
        todo = answered.select(
            *rows.columns, F.when(split & ~left, F.col("low") + half).otherwise(F.col("low")).alias("low"),
            F.when(split, F.when(left, half).otherwise(F.col("n") - half)).otherwise(F.col("n")).alias("n"), (F.col("lost") | (F.col("no") & (F.col("n") == 1))).alias("lost"),
        )
    return todo.select(*rows.columns, "lost")


def match_answers(windows: DataFrame, answers: DataFrame, document: str = "doc_id") -> DataFrame:
    """windows (document, batch, slot, ...) with the output of answers (document, batch, position, window_id, output): by
    window_id; by position where all ids of a batch are -1; an empty array where the batch has no answer for a window. Of
    several answers with one id the last by position counts.
    """
    keys = [document, "batch"]
    named = answers.groupBy(*keys).agg(F.max(F.col("window_id") != -1).alias("named"))
    placed = answers.join(named, keys).withColumn("slot", F.when(F.col("named"), F.col("window_id")).otherwise(F.col("position")).cast("int"))
    last = placed.groupBy(*keys, "slot").agg(F.max_by("output", "position").alias("output"))
    empty = F.array().cast(dict(answers.dtypes)["output"])
    return windows.join(last, [*keys, "slot"], "left").withColumn("output", F.coalesce("output", empty))


#: The shape of an answer's text.
ANSWER = "entities array<struct<entity_type: string, name: string>>, attributes array<struct<entity_type: string, entity_name: string, attribute_name: string, value: string, value_type: string>>"


def facts_of(answer: Column, canonical: Column | None = None) -> Column:
    """Facts of a JSON answer: an array of (entity_type, entity_name, namespace, attribute, value, value_type, searchable).
    A value type that is none of the known ones is read off the value; text that is no JSON gives none. canonical: a map
    of entity types in lower case to the ones to use.
    """
    parsed = F.from_json(answer, ANSWER)
    kind = lambda t: t if canonical is None else F.coalesce(F.try_element_at(canonical, F.lower(strip(t))), strip(t))
    fact = lambda a: F.struct(
        kind(a["entity_type"]).alias("entity_type"), a["entity_name"].alias("entity_name"), F.lit(NAMESPACE).alias("namespace"), strip(a["attribute_name"]).alias("attribute"), a["value"].alias("value"),
        F.when(a["value_type"].isin("string", "number", "boolean"), a["value_type"]).otherwise(value_type(a["value"])).alias("value_type"), F.lit(True).alias("searchable"),
    )
    return F.transform(F.coalesce(parsed["attributes"], F.array().cast("array<struct<entity_type: string, entity_name: string, attribute_name: string, value: string, value_type: string>>")), fact)


def fold_tool_calls(calls: Column) -> Column:
    """One extraction of an array of calls (tool, subject, value) in order: the last resolved entity, the recorded facts
    and relations. Calls of unknown tools are left out.
    """
    empty = F.struct(F.lit(None).cast("string").alias("entity"), F.array().cast("array<string>").alias("facts"), F.array().cast("array<string>").alias("relations"))
    line = lambda c: F.concat_ws("=", c["subject"], c["value"])
    step = lambda a, c: F.struct(
        F.when(c["tool"] == "resolve_entity", c["subject"]).otherwise(a["entity"]).alias("entity"),
        F.when(c["tool"] == "record_attribute", F.concat(a["facts"], F.array(line(c)))).otherwise(a["facts"]).alias("facts"),
        F.when(c["tool"] == "record_relation", F.concat(a["relations"], F.array(line(c)))).otherwise(a["relations"]).alias("relations"),
    )
    return F.aggregate(calls, empty, step)


def replace_chunks(existing: DataFrame, new: DataFrame, embedding: str = "embedding") -> DataFrame:
    """existing without the chunks of any version in new, and new; a new chunk whose checksum has an embedding in existing
    takes it over (the one of the least version), else its embedding stays null. Columns: version_id, chunk_index,
    checksum, embedding.
    """
    known = existing.where(F.col(embedding).isNotNull()).groupBy("checksum").agg(F.min_by(embedding, "version_id").alias("known"))
    kept = existing.join(new.select("version_id").distinct(), "version_id", "left_anti")
    made = new.join(known, "checksum", "left").select("version_id", "chunk_index", "checksum", F.coalesce(F.col(embedding), "known").alias(embedding))
    return kept.select("version_id", "chunk_index", "checksum", embedding).unionByName(made)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the chunks of the versions that occur in chunks, and no others, in a table partitioned by version."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def upsert_values(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (entity_id, attribute, value_norm) of both tables: the text that came first stays, searchable is
    that of the last. Order is by seq, which both tables have; existing rows must have the lesser ones.
    """
    return existing.unionByName(new).groupBy("entity_id", "attribute", "value_norm").agg(F.min_by("value", "seq").alias("value"), F.max_by("searchable", "seq").alias("searchable"))


def upsert_attributes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (namespace, name) of both tables (value_type, multivalue, seq): the value type is the last one told,
    multivalue that of the row that came first. Existing rows must have the lesser seq.
    """
    return existing.unionByName(new).groupBy("namespace", "name").agg(F.max_by("value_type", "seq").alias("value_type"), F.min_by("multivalue", "seq").alias("multivalue"))


@F.pandas_udf(StringType())
def merged_facts(turn: pd.Series, facts: pd.Series) -> str:
    """The facts of a group's windows in order of their turns, joined by bars: an aggregate function."""
    order = turn.argsort(kind="stable")
    return "|".join(f for i in order for f in facts.iloc[i])
