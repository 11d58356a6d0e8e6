"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from marlstone.llm import chat, decontamination, language, packing, quality, rules, simhash, substrings, tokens, toxicity

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "Same text here twice over and over again today", "Same text here twice over and over again today", LONG, "ab" * 40_000, "été \U0001f600 日本語 \x00 end"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, words int, label string, c0 string, runs string, n_words int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "k", 1, 1, "l", "c", "r", 1, "s") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, TEXTS[4], "en", None, 1, "k", 1, 1, "l", "c", "r", 1, "s")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


BENCHMARK = [(1, "same text here twice over and over again"), (2, None), (3, ""), (3, "one")]


def operators(spark, docs, labels):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    piece, word = (public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "word_bpe_49k.json"))
    return {
        "rules": lambda: rules.quality_rules(docs),
        "language": lambda: language.identify(docs, language.train(docs)),
        "tokens": lambda: tokens.token_counts(docs, piece),
        "packing": lambda: packing.pack_documents(docs, word),
        "substrings": lambda: substrings.remove_duplicate_spans(docs),
        "layout": lambda: substrings.remove_duplicate_spans(docs, layout=True),
        "quality": lambda: quality.score(docs, quality.train(docs, labels), keep=True),
        "simhash": lambda: simhash.near_duplicates(docs),
        "dropped": lambda: simhash.drop_near_duplicates(docs),
        "toxicity": lambda: toxicity.severity(docs, toxicity.train(docs, labels)),
        "contamination": lambda: decontamination.find_contamination(docs, bench),
        "clean": lambda: decontamination.drop_contaminated(docs, bench),
    }


NAMES = ["rules", "language", "tokens", "packing", "substrings", "layout", "quality", "simhash", "dropped", "toxicity", "contamination", "clean"]
ONE_ROW_EACH = {"rules", "language", "tokens", "substrings", "layout", "quality", "simhash", "toxicity"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, docs, labels, name):
    found = operators(spark, docs, labels)[name]().collect()
    if name in ONE_ROW_EACH:
        assert len(found) == docs.count()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())
        twice = [tuple(r) for r in found if r["doc_id"] == 4]
        assert len(twice) == 2 and twice[0] == twice[1]
    elif name == "packing":
        assert {r["doc_id"] for r in found} == {None, *range(len(TEXTS))}
    elif name == "dropped":
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [0, 3, 4, 6, 7, 8]
    elif name == "contamination":
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(3, 3), (4, 1), (5, 1), (None, 1)}
    else:
        assert sorted(r["doc_id"] for r in found) == [0, 1, 2, 6, 7, 8] and found[0].__fields__ == docs.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    assert operators(spark, docs.limit(0), labels.limit(0))[name]().collect() == []


@pytest.mark.parametrize("name", ["language", "quality", "toxicity"])
def test_no_labels(spark, docs, labels, name):
    assert operators(spark, docs.withColumn("lang", F.lit(None).cast("string")), labels.limit(0))[name]().count() == docs.count()


def test_chat_edges(spark):
    rows = [(1, 0, "USER", "Hello there"), (1, 1, "bot", "> hello  THERE\nHi"), (1, 1, "bot", "> hello  THERE\nHi"), (1, None, None, None), (None, 0, "user", ">"), (None, 1, "user", "> x"), (2, 0, "user", "> nobody said this")]
    messages = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, position string")
    found = {(r.conv_id, r.turn): r for r in chat.link_conversations(messages).collect()}
    assert chat.link_conversations(messages).count() == len(rows)
    assert found[1, 1].reply_to == 0 and found[1, 1].text == "Hi" and found[1, 1].role == "assistant" and found[1, 1].position == 2
    assert found[1, None].position == 0 and found[1, None].text == ""
    assert found[2, 0].reply_to is None and found[2, 0].quoted_lines == 1
    assert chat.link_conversations(messages.limit(0)).collect() == []
