"""Golden questions and passages: their source, and where passages stand."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of passages that one automaton holds.
AUTOMATON_CHARS = 4 << 20


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_sources, answerable) of a JSON file {"positives": [{question, expected_sources}], "negatives":
    [{question}]}, which may go over many lines. Missing lists are empty.
    """
    item = "struct<question: string, expected_sources: array<string>>"
    read = spark.read.option("multiLine", True).schema(f"positives array<{item}>, negatives array<{item}>").json(path)
    rows = lambda c, yes: read.select(F.explode(c).alias("x")).select("x.question", F.coalesce("x.expected_sources", F.array().cast("array<string>")).alias("expected_sources"), F.lit(yes).alias("answerable"))
    return rows("positives", True).unionByName(rows("negatives", False))


def _blocks(items: DataFrame) -> Iterator[dict[str, list]]:
    """Passages with the keys of their items, AUTOMATON_CHARS at a time."""
    block, held = {}, 0
    for key, text in items.where("text IS NOT NULL").select("item", "text").toLocalIterator():
        block.setdefault(text, []).append(key)
        held += len(text)
        if held > AUTOMATON_CHARS:
            yield block
            block, held = {}, 0
    if block:
        yield block


def containing(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key): each row of docs whose text contains an item's passage whole, character by character, for each item.

    Items are a stated set; they go to the tasks in blocks of AUTOMATON_CHARS, each as an Aho-Corasick automaton that reads
    a text once. An empty passage is in every text but null ones, a null passage in none; items with one passage all
    have their rows, as have repeated rows of docs.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    schema, out = f"item {kinds[1]}, key {kinds[0]}", None
    for block in _blocks(items.select(F.col(item).alias("item"), F.col(text).alias("text"))):

        def run(batches: Iterator[pa.RecordBatch], block: dict[str, list] = block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for passage, keys in block.items():
                if passage:
                    automaton.add_word(passage, keys)
            automaton.make_automaton()
            for batch in batches:
                found, at = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    hits = {id(keys): keys for _, keys in automaton.iter(t)} if len(automaton) else {}
                    own = [k for keys in (*hits.values(), block.get("", [])) for k in keys]
                    found += own
                    at += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column(0).take(pa.array(at, pa.int64()))], names=["item", "key"])

        kind = _arrow_kind(items, item)
        some = rows.mapInArrow(run, schema)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = rows.limit(0).select(F.lit(None).cast(kinds[1]).alias("item"), "key")
    return out.select(F.col("item").alias(item), F.col("key").alias(key))


def _arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
