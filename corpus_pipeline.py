"""A training corpus from documents: quality, near duplicates, shared passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all rows that the stage before
it kept; the last returns the packed pieces. run() writes each stage's rows to the shared folder and reads them again; a
stage's folder goes when the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import crc_remainder, free_name, read_table, shared_dir
from marlstone.llm.decontamination import drop_contaminated
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality import score, train
from marlstone.llm.simhash import drop_near_duplicates
from marlstone.llm.substrings import remove_duplicate_spans
from marlstone.sources.shared import drop_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; it learns from labels outside the held-out fifth."""
    model = train(docs, read_table(spark, sf_dir, "labels").where(crc_remainder(F.col("doc_id"), 5) != 0))
    verdict = free_name(docs, "predicted")
    return score(docs, model, keep=True, names=("score", verdict)).where(F.col(verdict) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each class of near duplicates."""
    return drop_near_duplicates(docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows but those that lose all their words, without the passages that stand in a document with a smaller doc_id;
    a text that loses nothing stays as it is.
    """
    words, removed = counts = free_name(docs, "n_words"), free_name(docs, "n_removed")
    rows = remove_duplicate_spans(docs, layout=True, counts=counts).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    return rows.select(*(F.when(F.col("text").isNotNull(), F.length("text")).cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts hold no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be reached."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", shared_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packing),
]

#: A learned classifier, SimHash classes and a tokenizer are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop_folder(spark, f"{folder}/{last}")
        last = name
    return docs
