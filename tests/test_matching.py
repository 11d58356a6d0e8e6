"""Vocabulary matches against a plain search of all entries by difflib's ratio."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marlstone.functions import fuzzy
from marlstone.functions.text import normalize_term


def plain(term, vocabulary):
    if not term:
        return None, None, None
    if term in vocabulary:
        return vocabulary[term], 1.0, ""
    ratio = lambda k: SequenceMatcher(None, k, term).ratio()  # noqa: E731  as get_close_matches has it
    close = sorted((k for k in vocabulary if ratio(k) >= 0.6), key=lambda k: (ratio(k), k), reverse=True)[:3]
    if not close:
        return None, None, None
    names = []
    for k in close:
        if vocabulary[k] not in names:
            names.append(vocabulary[k])
    return names[0], round(SequenceMatcher(None, term, close[0]).ratio(), 2), ",".join(names[1:])


def words(n, seed):
    drawn = random.Random(seed)
    return ["".join(drawn.choice("abcde ") for _ in range(drawn.randrange(3, 9))).strip() for _ in range(n)]


def test_match_is_the_plain_search(spark):
    vocabulary = {w: w[:2].upper() for w in words(40, 1) if w}
    asked = words(200, 2) + list(vocabulary)[:5] + ["", None, "zzzz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string").withColumn("m", fuzzy.match(F.col("t"), vocabulary))
    found = {r.i: (r.m.canonical, r.m.confidence, r.m.alternates) if r.m else (None, None, None) for r in rows.collect()}
    assert found == {i: plain(t, vocabulary) for i, t in enumerate(asked)}
    assert any(f[2] for f in found.values()) and any(f[0] is None for f in found.values())


def test_relations_that_nothing_is_close_to_stay(spark):
    known = {"works for": "works_for", "employed by": "works_for", "part of": "part_of"}
    asked = ["Works-for", "employed_bye", "totally other thing", "  ", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, t string").select("i", fuzzy.match_relation(normalize_term(F.col("t")), known).alias("m"))
    found = {r.i: (r.m.canonical, r.m.confidence) if r.m else None for r in rows.collect()}
    assert found == {0: ("works_for", 1.0), 1: ("works_for", 0.96), 2: ("totally_other_thing", 0.30), 3: None, 4: None}


def test_attributes_are_those_of_the_type(spark):
    own, synonyms = {"person": ["job_title", "email"], "server": ["memory"]}, {"role": "job_title", "ram": "memory"}
    asked = [("person", "job title"), ("person", "role"), ("person", "ram"), ("person", "emails"), ("server", "ram"), ("other", "email"), (None, "email"), ("person", None), ("person", "")]
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(asked)], "i int, k string, t string").select("i", fuzzy.match_attribute(F.col("k"), F.col("t"), own, synonyms).alias("m"))
    found = {r.i: (r.m.canonical, r.m.confidence) if r.m and r.m.canonical else None for r in rows.collect()}
    assert found == {0: ("job_title", 1.0), 1: ("job_title", 1.0), 2: None, 3: ("email", 0.91), 4: ("memory", 1.0), 5: None, 6: None, 7: None, 8: None}


def test_vocabularies_have_a_bound(spark):
    terms = spark.createDataFrame([("Red  Hat",), ("red-hat",), ("Blue",), (None,)], "term string")
    assert fuzzy.vocabulary_of(terms, normalize_term(F.col("term"))) == {"blue": "Blue", "red hat": "Red  Hat"}
    with pytest.raises(ValueError, match="more than 1"):
        fuzzy.vocabulary_of(terms, normalize_term(F.col("term")), most=1)
