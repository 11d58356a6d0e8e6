"""Fuzzy matching against a small vocabulary, by Arrow batches (no built-in has this ratio)."""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Matches that are looked for, and the least ratio of one.
MATCHES, CUTOFF = 3, 0.6
#: Classes of characters that are counted to bound a ratio.
LETTERS = 64
#: Confidence of a relation that no entry is close to.
FREE = 0.30
MATCH = StructType([StructField("canonical", StringType()), StructField("confidence", DoubleType()), StructField("alternates", StringType())])


def _find(term: str, vocabulary: dict[str, str]) -> tuple[str | None, float | None, str | None]:
    if term in vocabulary:
        return vocabulary[term], 1.0, ""
    close = get_close_matches(term, list(vocabulary), MATCHES, CUTOFF) if term else []
    if not close:
        return None, None, None
    best, *others = dict.fromkeys(vocabulary[c] for c in close)
    return best, round(SequenceMatcher(None, term, close[0]).ratio(), 2), ",".join(others)


def match(term: Column, vocabulary: dict[str, str]) -> Column:
    """(canonical, confidence, alternates) of a term: its own entry with 1, else the closest entry of at least CUTOFF with
    its ratio to two places, and the other canonical terms of the next ones; nulls where nothing is close, or the term is
    null or empty. The vocabulary (synonym to canonical, in lower case) goes along with the function, so it must be small;
    each distinct term of a batch is matched once.
    """

    @F.pandas_udf(MATCH)
    def run(terms: pd.Series) -> pd.DataFrame:
        found = {t: _find(t, vocabulary) for t in terms.dropna().unique()}
        return pd.DataFrame([found.get(t, (None, None, None)) for t in terms], columns=["canonical", "confidence", "alternates"])

    return run(term)


def match_relation(term: Column, vocabulary: dict[str, str]) -> Column:
    """As match(), but a relation that is close to no entry stays, in snake case and with the confidence FREE."""
    free = F.struct(F.replace(term, F.lit(" "), F.lit("_")).alias("canonical"), F.lit(FREE).alias("confidence"), F.lit("").alias("alternates"))
    found = match(term, vocabulary)
    return F.when(term.isNull() | (term == ""), F.lit(None).cast(MATCH)).when(found["canonical"].isNull(), free).otherwise(found)


def match_attribute(entity_type: Column, term: Column, attributes: dict[str, list[str]], synonyms: dict[str, str]) -> Column:
    """As match(), among the attributes of the entity type and those synonyms (to canonical attributes, in lower case) that
    name one of them; nulls where the type has no attributes of its own.
    """
    scoped = {kind: {a.lower().translate(str.maketrans("-_", "  ")): a for a in own} | {s: a for s, a in synonyms.items() if a in own} for kind, own in attributes.items()}

    @F.pandas_udf(MATCH)
    def run(kinds: pd.Series, terms: pd.Series) -> pd.DataFrame:
        found = {(k, t): _find(t, scoped[k]) for k, t in set(zip(kinds, terms, strict=True)) if k in scoped and isinstance(t, str)}
        return pd.DataFrame([found.get(kt, (None, None, None)) for kt in zip(kinds, terms, strict=True)], columns=["canonical", "confidence", "alternates"])

    return run(entity_type, term)


def vocabulary_of(terms: DataFrame, normalized: Column, most: int = 10_000) -> dict[str, str]:
    """(lower-case term to canonical) of a table of canonical terms (one column, term), to go along with tasks. One of more
    than `most` entries is an error: match_table() takes those.
    """
    rows = vocabulary_rows(terms, normalized).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: use match_table()")
    return {r["n"]: r["canonical"] for r in sorted(rows)}


def vocabulary_rows(terms: DataFrame, normalized: Column) -> DataFrame:
    """(n, canonical): the vocabulary of a table of canonical terms as a table; of terms that agree the least."""
    return terms.select(normalized.alias("n"), F.col("term")).where("n IS NOT NULL").groupBy("n").agg(F.min("term").alias("canonical"))


def _letters(terms: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(terms)), np.fromiter(map(len, terms), np.int64, len(terms)))
    return np.bincount(owner * LETTERS + points % LETTERS, minlength=len(terms) * LETTERS).reshape(len(terms), LETTERS).astype(np.int32)


def match_table(terms: DataFrame, vocabulary: DataFrame, block: int = 10_000) -> DataFrame:
    """(term, canonical, confidence, alternates) of each distinct term (column term) that is not null, as match() gives them,
    for a vocabulary (n, canonical) of any size.

    Entries are dealt to blocks, terms to parts, and each block meets each part in one task, which compares a term only
    with entries whose lengths and counts of characters allow the ratio. The best MATCHES of each block are told apart by
    ratio, then by the entry that is last in order, as in one list.
    """
    spark = terms.sparkSession
    blocks = max(1, -(-vocabulary.count() // block))
    parts = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    exact = asked.join(vocabulary, F.col("term") == F.col("n")).select("term", "canonical", F.lit(1.0).alias("confidence"), F.lit("").alias("alternates"))
    rest = asked.join(vocabulary, F.col("term") == F.col("n"), "left_anti")
    left = rest.where("term <> ''").select("term", each(blocks).alias("b"), F.pmod(F.xxhash64("term"), F.lit(parts)).alias("p")).groupBy("b", "p")
    right = vocabulary.select("n", "canonical", F.pmod(F.xxhash64("n"), F.lit(blocks)).alias("b"), each(parts).alias("p")).groupBy("b", "p")

    def close(asked: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        n, out = entries["n"].tolist(), []
        counts, lengths = _letters(n), np.fromiter(map(len, n), np.int64, len(n))
        for term, own in zip(asked["term"], _letters(asked["term"].tolist()), strict=True):
            may = np.flatnonzero(2.0 * np.minimum(counts, own).sum(axis=1) >= CUTOFF * (lengths + len(term)) - 1e-9)
            matcher, found = SequenceMatcher(), []
            matcher.set_seq2(term)
            for i in may.tolist():
                matcher.set_seq1(n[i])
                if matcher.quick_ratio() >= CUTOFF and (ratio := matcher.ratio()) >= CUTOFF:
                    found.append((ratio, n[i], i))
            out += [(term, r, x, entries["canonical"].iloc[i], round(SequenceMatcher(None, term, x).ratio(), 2)) for r, x, i in nlargest(MATCHES, found)]
        return pd.DataFrame(out, columns=["term", "ratio", "n", "canonical", "confidence"])

    found = left.cogroup(right).applyInPandas(close, "term string, ratio double, n string, canonical string, confidence double")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("n")))).where(F.col("k") <= MATCHES)
    listed = best.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("k", "canonical", "confidence"))).alias("a"))
    names = F.array_distinct(F.transform("a", lambda x: x["canonical"]))
    near = listed.select("term", F.get(names, F.lit(0)).alias("canonical"), F.get("a", F.lit(0))["confidence"].alias("confidence"), F.array_join(F.slice(names, 2, MATCHES), ",").alias("alternates"))
    others = rest.join(near, "term", "left").select("term", "canonical", "confidence", "alternates")
    return exact.unionByName(others)
