"""Sitemaps, discovery, golden passages, normalised values, embeddings: rules on rows made by hand, and plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.embedding import HashingEmbedder, embed
from marlstone.operators import crawl, golden, resolution

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("xml, expected", [
    (f'{HEAD}\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/</loc></url><url><loc>https://e.com/a</loc></url></urlset>', ["https://e.com/", "https://e.com/a"]),
    ('<urlset xmlns:image="i"><url><image:image><image:loc>x.png</image:loc></image:image><loc>p</loc></url></urlset>', ["p"]),
    ("<!-- hand made --><urlset><url><loc>p</loc></url></urlset>", ["p"]),
    (f'{HEAD}<?xml-stylesheet type="text/xsl" href="s.xsl"?><urlset><url><loc>p</loc></url></urlset>', ["p"]),
    ("<urlset><url><loc><![CDATA[https://e.com/?a=1&b=2]]></loc></url></urlset>", ["https://e.com/?a=1&b=2"]),
    ("<urlset><url><loc>\n  p&amp;q \u2003\n</loc><loc>second</loc></url><loc>outside</loc><other><loc>no</loc></other><url><loc> </loc></url></urlset>", ["p&q"]),
    ("<urlset></urlset>", []),
    ("<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>", None),
    ("<html><body>hi</body></html>", None),
    ("<urlset><url>", None),
    ("not xml at all", None),
    ("", None),
    (None, None),
])
def test_sitemaps(spark, xml, expected):
    assert one(spark, crawl.sitemap_locations(F.lit(xml).cast("string"))) == expected


@pytest.mark.parametrize("robots, expected", [
    ("User-agent: *\r\nSitemap: https://e.com/s.xml\r\n", "https://e.com/s.xml"),
    ("Sitemap:\nSITEMAP:   \n\t sitemap:https://e.com/b.xml\u00a0\nSitemap: c", "https://e.com/b.xml"),
    ("Disallow: /private/\n# Sitemap: no", None),
    ("", None),
    (None, None),
])
def test_robots(spark, robots, expected):
    assert one(spark, crawl.sitemap_urls(F.lit(robots).cast("string"))) == expected


def test_discovery_falls_through(spark):
    good, index = "<urlset><url><loc>https://a.com/1</loc></url></urlset>", "<sitemapindex/>"
    documents = [("https://a.com/robots.txt", 200, "Sitemap: https://a.com/s.xml"), ("https://a.com/s.xml", 200, good), ("https://b.com/robots.txt", 404, "Sitemap: https://a.com/s.xml"), ("https://c.com/robots.txt", 200, "Sitemap: https://c.com/s.xml"), ("https://c.com/s.xml", 200, index), ("https://d.com/robots.txt", 200, "Sitemap: https://d.com/none.xml"), ("https://e.com/robots.txt", 200, "Sitemap: https://e.com/s.xml"), ("https://e.com/s.xml", 200, "<urlset/>")]
    links = [("https://b.com/", "https://b.com/x"), ("https://b.com/x", "https://b.com/"), ("https://b.com/x", "https://b.com/gone"), ("https://c.com/", None)]
    found = crawl.discover(spark.createDataFrame([(f"https://{h}.com/",) for h in "abcde"] + [(None,)], "root string"), spark.createDataFrame(documents, "url string, status int, body string"), spark.createDataFrame(links, "url string, link string"), 10)
    assert sorted(map(tuple, found.collect())) == [("https://a.com/", "https://a.com/1", "SITEMAP"), ("https://b.com/", "https://b.com/", "BFS_FALLBACK"), ("https://b.com/", "https://b.com/x", "BFS_FALLBACK"), ("https://c.com/", "https://c.com/", "BFS_FALLBACK")]


def plain_crawl(roots, links, most):
    to, visited, step, frontier, out = {}, set(), 0, set(roots), []
    for a, b in links:
        to.setdefault(a, set()).add(b)
    while len(visited) < most and (batch := sorted(frontier - visited)[: most - len(visited)]):
        for u in batch:
            if u in to:
                out.append((u, step))
                frontier |= to[u]
            visited.add(u)
        step += 1
    return out


def test_crawls_of_many_roots(spark):
    r = random.Random(2)
    links = [(f"p{r.randint(0, 40)}", f"p{r.randint(0, 50)}") for _ in range(120)]
    rows = [("x", "p1"), ("x", "p2"), ("y", "p7"), ("z", "none")]
    for most in (1, 9, 1000):
        found = crawl.crawl_each(spark.createDataFrame(rows, "root string, url string"), spark.createDataFrame(links, "url string, link string"), most)
        expected = [(k, *x) for k in "xyz" for x in plain_crawl([u for q, u in rows if q == k], links, most)]
        assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_golden_passages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(golden, "AUTOMATON_CHARS", 8)
    r = random.Random(3)
    texts = ["a foo barrel", "x one two threes", "", None, "été foo", *("".join(r.choice("ab ") for _ in range(30)) for _ in range(40))]
    passages = ["foo bar", "one two three", "foo", "foo", None, "", "é f", *("".join(r.choice("ab ") for _ in range(r.randint(1, 4))) for _ in range(20))]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    expected = [(i, d) for i, p in enumerate(passages) for d, t in [*enumerate(texts), (0, texts[0])] if p is not None and t is not None and p in t]
    assert sorted(map(tuple, golden.containing(docs, items).collect())) == sorted(expected)
    assert golden.containing(docs, items.limit(0)).collect() == [] == golden.containing(docs.limit(0), items).collect()
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"positives": [{"question": "who?", "expected_sources": ["a", "b"]}, {"question": "x"}], "negatives": [{"question": "why?"}]}, indent=2))
    assert sorted(map(tuple, golden.golden_set(spark, str(path)).collect())) == [("who?", ["a", "b"], True), ("why?", [], False), ("x", [], True)]


def test_values_are_unique_by_their_normalised_text(spark):
    rows = [(1, "e", "a", "Phase – One"), (2, "e", "a", " phase - one "), (3, "e", "a", "PHASE -  ONE"), (4, "e", "b", "Phase – One"), (5, "f", "a", "ﬁne"), (6, "f", "a", "FINE"), (7, None, "a", "x"), (8, None, "a", "X"), (9, "g", "a", None)]
    told = [(1, 10), (2, 10), (2, 11), (3, 12), (5, 1), (6, 2), (8, 3), (99, 4)]
    kept, provenance = resolution.normalized_uniqueness(spark.createDataFrame(rows, "value_id long, entity_id string, attribute_id string, value string"), spark.createDataFrame(told, "value_id long, version_id long"))
    assert sorted((r.value_id, r.value_norm) for r in kept.collect()) == [(2, "phase - one"), (4, "phase - one"), (6, "fine"), (8, "x")]
    assert sorted(map(tuple, provenance.collect())) == [(2, 10), (2, 11), (2, 12), (6, 1), (6, 2), (8, 3)]


def test_merged_values_meet_by_their_normalised_text(spark):
    values = spark.createDataFrame([("s", "a", "Offers flexibility"), ("d1", "a", "offers  FLEXIBILITY"), ("d1", "a", "Other"), ("d2", "a", "other "), ("z", "a", "other")], "entity_id string, attribute string, value string")
    ids = spark.createDataFrame([("d1", "s"), ("d2", "s")], "old_id string, new_id string")
    assert sorted(map(tuple, resolution.repoint(values, ids).collect())) == [("s", "a", "Offers flexibility", "offers flexibility"), ("s", "a", "Other", "other"), ("z", "a", "other", "other")]


def test_embedding_by_a_plain_loop(spark):
    import hashlib

    texts = ["The cat the CAT sat", "été\t日本  x", "a " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def plain(text):
        v = np.zeros(16)
        for w in text.lower().split():
            d = hashlib.md5(w.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 16] += -1 if d[4] % 2 else 1
        return v / np.linalg.norm(v)

    bare = {r.id: r.embedding for r in embed(rows, HashingEmbedder(16), 16).collect()}
    asked = {r.id: r.embedding for r in embed(rows, HashingEmbedder(16), 16, instruction="find this: ").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(bare[i], plain(t)) and np.allclose(asked[i], plain("find this: " + t)) and abs(np.linalg.norm(bare[i]) - 1) < 1e-9
    assert embed(rows.limit(0), HashingEmbedder(16), 16).collect() == []
    for bad, function, message in (([(1, " \n")], HashingEmbedder(16), "empty text"), ([(1, None)], HashingEmbedder(16), "empty text"), ([(1, "a")], HashingEmbedder(8), "vectors of shape"), ([(1, "a")], lambda t: np.full((1, 16), np.nan), "not finite")):
        with pytest.raises(Exception, match=message):
            embed(spark.createDataFrame(bad, "id long, text string"), function, 16).collect()


def test_sections_by_markers(spark):
    from marlstone.operators.chunking import chunk_marked, marked_sections

    kind = "array<struct<position: int, level: int, heading_text: string>>"
    cases = [
        ("Intro. Body", [(7, 1, "B")], [(0, 7, None, None), (7, 11, "B", 1)]),
        ("Body", [(0, 2, "B")], [(0, 4, "B", 2)]),
        ("abcd", [(0, 1, "A"), (2, 2, "B"), (2, 3, "C"), (9, 1, "D")], [(0, 2, "A", 1), (2, 4, "C", 3)]),
        ("abcd", None, [(0, 4, None, None)]),
        ("abcd", [], [(0, 4, None, None)]),
        ("", [(0, 1, "A")], []),
        (None, [(0, 1, "A")], []),
    ]
    rows = spark.createDataFrame([(i, t, m, "PDF", "t") for i, (t, m, _) in enumerate(cases)], f"doc_id long, text string, structure {kind}, source_type string, title string")
    found = {r.doc_id: [tuple(s) for s in r.s or []] for r in rows.select("doc_id", marked_sections(F.col("text"), F.col("structure")).alias("s")).collect()}
    assert [found[i] for i in range(len(cases))] == [e for *_, e in cases]
    chunks = chunk_marked(rows).where("doc_id = 0").orderBy("chunk_index").collect()
    assert [(c.chunk, c.heading, c.heading_level, c.source_type, c.title) for c in chunks] == [("Intro. ", None, None, "PDF", "t"), ("Body", "B", 1, "PDF", "t")]


def test_window_rows_are_the_windows(spark):
    from marlstone.operators.chunking import ExtractionWindows, chunk_for_extraction

    docs = spark.createDataFrame([(1, "One. Two three. " * 400), (2, None), (3, ""), (4, "x" * 5_000)], "doc_id long, text string")
    lateral = docs.lateralJoin(ExtractionWindows(F.col("text").outer())).select("doc_id", "window_index", "n_chars", "window")
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, chunk_for_extraction(docs).collect()))


def test_vocabularies_of_any_size(spark):
    from marlstone.functions import fuzzy

    r = random.Random(8)
    words = sorted({"".join(r.choice("abcde") for _ in range(r.randint(2, 9))) for _ in range(400)})
    vocabulary = {w: w[:3].upper() for w in words}
    terms = [*words[:5], *("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(120)), "", "zzz", None]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    table = spark.createDataFrame(list(vocabulary.items()), "n string, canonical string")
    expected = {(t, *fuzzy._find(t, vocabulary)) for t in terms if t is not None}
    for block in (10_000, 37):
        assert set(map(tuple, fuzzy.match_table(rows, table, block).collect())) == expected


def test_strict_answers(spark):
    from marlstone.functions import answers

    def read(function, text):
        row = one(spark, function(F.lit(text).cast("string")))
        return tuple(row) if row else None

    rewrite = [('{"rewritten_text":" a ","resolved_references":["x"],"more":1}', ("a", ["x"])), ('```json\n{"rewritten_text":"a"}\n```', ("a", [])), ('{"rewritten_text":1}', None), ('{"rewritten_text":"a","resolved_references":["x",null]}', None), ('{"rewritten_text":"a","resolved_references":"x"}', None), ("[1]", None), ("{oops", None), (None, None)]
    assert [read(answers.parse_rewrite, t) for t, _ in rewrite] == [e for _, e in rewrite]
    answer = [('{"answer":"a","is_grounded":true,"citation_indices":[1,2]}', ("a", True, [1, 2])), ('{"answer":"a","is_grounded":false}', ("a", False, [])), ('{"answer":" ","is_grounded":true}', None), ('{"answer":"a","is_grounded":1}', None), ('{"answer":"a"}', None), ('{"answer":"a","is_grounded":true,"citation_indices":[1.5]}', None), ('{"answer":"a","is_grounded":true,"citation_indices":["1"]}', None)]
    assert [read(answers.parse_answer, t) for t, _ in answer] == [e for _, e in answer]
