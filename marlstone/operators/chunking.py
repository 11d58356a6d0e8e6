"""Chunking: sections by heading, token windows, extraction windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_windows
from .stages import page_range

# Tokens of a chunk and of an overlap; characters of an extraction window, its overlap and least share.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 75
WINDOW_SIZE, WINDOW_OVERLAP, WINDOW_LEAST = 1800, 150, 0.6
_BREAKS = [re.compile(r"[.!?]\s+|\n+"), re.compile(r"\s+")]


def chunk_tokens(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, token_count, chunk): a text of at most `size` tokens is one chunk with its own text; longer
    ones are windows of tokens joined by blanks. Texts without a token give no row.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda t: t != "")
    rows = docs.select(key, text, tokens.alias("tokens")).where(F.size("tokens") > 0)
    windows = rows.select(key, text, F.size("tokens").alias("n"), F.posexplode(token_windows(F.col("tokens"), size, overlap)).alias("chunk_index", "window"))
    return windows.select(key, "chunk_index", F.size("window").alias("token_count"), F.when(F.col("n") <= size, F.col(text)).otherwise(F.array_join("window", " ")).alias("chunk"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_index, section): a text cut before each line that begins with `#`; empty sections go."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^#)"), lambda x: F.trim(x) != "")
    return docs.select(key, F.posexplode(parts).alias("section_index", "section"))


def chunk_document(docs: DataFrame, long_form: list[str], structured: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, key: str = "doc_id", text: str = "text", kind: str = "source_type", page_chars: int | None = None) -> DataFrame:
    """(key, chunk_index, token_count, section_index, heading, chunk[, pages]): chunks by the category of a document's kind.
    Long forms are cut before each line that begins with `#`, and each section into token windows; structured ones are one
    record, which is cut into windows only if it is longer than `size` tokens. A kind in neither list, or in both, fails the
    query. Null and empty texts give no row. With page_chars, pages has the page range of a chunk's section.
    """
    is_long, is_structured = F.col(kind).isin(*long_form), F.col(kind).isin(*structured)
    known = F.coalesce(is_long != is_structured, F.lit(False))
    checked = F.when(known, F.col(text)).otherwise(F.raise_error(F.concat(F.lit("source type in not exactly one category: "), F.coalesce(F.col(kind), F.lit("null")))))
    cut = F.when(is_long, F.split(checked, r"(?m)(?=^#)")).otherwise(F.array(checked))
    parts = docs.where(F.col(text) != "").select(key, F.posexplode(F.filter(cut, lambda x: x != "")).alias("section_index", "part"), F.transform(cut, lambda x: F.length(x)).alias("lengths"), is_long.alias("is_long"))
    tokens = F.filter(F.split("part", r"[\x20\x09-\x0D]+"), lambda t: t != "")
    windows = parts.withColumn("tokens", tokens).where(F.size("tokens") > 0).select("*", F.posexplode(token_windows(F.col("tokens"), size, overlap)).alias("i", "window"))
    heading = F.when(F.col("is_long") & F.col("part").startswith("#"), F.trim(F.regexp_extract("part", r"^#+[\x20\x09]*([^\n]*)", 1)))
    before = F.aggregate(F.slice("lengths", 1, F.col("section_index")), F.lit(0), lambda a, n: a + n)
    number = (F.row_number().over(W.partitionBy(key).orderBy("section_index", "i")) - 1).alias("chunk_index")
    pages = [page_range(before, before + F.length("part"), page_chars).alias("pages")] if page_chars else []
    return windows.select(key, number, F.size("window").alias("token_count"), "section_index", heading.alias("heading"), F.when(F.size("tokens") <= size, F.col("part")).otherwise(F.array_join("window", " ")).alias("chunk"), *pages)


def marked_sections(text: Column, structure: Column) -> Column:
    """(start, end, heading, heading_level) of a text's sections as an array: from each marker (position, level,
    heading_text) to the next one, and before the first what stands there. Without markers the text is one section. Empty
    sections go, so an empty text has none.
    """
    none = F.struct(F.lit(0).alias("position"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading_text"))
    marks = F.coalesce(F.transform(structure, lambda m: F.struct(m["position"].cast("int").alias("position"), m["level"].cast("int").alias("level"), m["heading_text"].alias("heading_text"))), F.array().cast("array<struct<position: int, level: int, heading_text: string>>"))
    starts = F.when(F.coalesce(F.get(marks, F.lit(0))["position"], F.lit(-1)) == 0, marks).otherwise(F.concat(F.array(none), marks))
    size = F.length(text)
    cut = F.transform(starts, lambda m, i: F.struct(m["position"].alias("start"), F.least(F.coalesce(F.get(starts, i + 1)["position"], size), size).alias("end"), m["heading_text"].alias("heading"), m["level"].alias("heading_level")))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def chunk_marked(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, key: str = "doc_id", text: str = "text", structure: str = "structure", inherit: tuple[str, ...] = ("source_type", "title")) -> DataFrame:
    """(key, chunk_index, token_count, section_index, start, end, heading, heading_level, *inherit, chunk): token windows of
    each section of marked_sections(), with what the document hands down. Sections without a token give no row, nor do
    null texts.
    """
    kept = docs.where(F.col(text).isNotNull()).select(key, text, *inherit, F.posexplode(marked_sections(F.col(text), F.col(structure))).alias("section_index", "s"))
    parts = kept.select(key, *inherit, "section_index", "s.*", F.col(text).substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("part"))
    tokens = F.filter(F.split("part", r"[\x20\x09-\x0D]+"), lambda t: t != "")
    windows = parts.withColumn("tokens", tokens).where(F.size("tokens") > 0).select("*", F.posexplode(token_windows(F.col("tokens"), size, overlap)).alias("i", "window"))
    number = (F.row_number().over(W.partitionBy(key).orderBy("section_index", "i")) - 1).alias("chunk_index")
    chunk = F.when(F.size("tokens") <= size, F.col("part")).otherwise(F.array_join("window", " ")).alias("chunk")
    return windows.select(key, number, F.size("window").alias("token_count"), "section_index", "start", "end", "heading", "heading_level", *inherit, chunk)


@F.udtf(returnType="window_index int, n_chars int, window string")
class ExtractionWindows:
    """A text's extraction windows as rows, for a lateral join; null and empty texts have none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        for i, w in enumerate(extraction_windows(text) if text else []):
            yield i, len(w), w


def extraction_windows(text: str, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> list[str]:
    """Windows that end after a sentence, else after a blank, not before WINDOW_LEAST of their size; the next one begins
    at the first blank of the overlap. The cursor depends on the window before, so this is no set operation.
    """
    out, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            return [*out, text[start:]]
        floor = start + int(size * WINDOW_LEAST)
        for pattern in _BREAKS:
            ends = [m.end() for m in pattern.finditer(text, floor, end)]
            if ends:
                end = ends[-1]
                break
        out.append(text[start:end])
        blank = _BREAKS[1].search(text, end - overlap, end)
        start = blank.end() if blank and blank.end() < end else end - overlap


def chunk_for_extraction(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, window_index, n_chars, window), by Arrow batches; one row for each window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, len(w), w) for k, t in zip(pdf["key"], pdf["text"], strict=True) if t for i, w in enumerate(extraction_windows(t))]
            yield pd.DataFrame(rows, columns=["key", "window_index", "n_chars", "window"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, window_index int, n_chars int, window string").withColumnRenamed("key", key)
