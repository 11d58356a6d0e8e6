"""Operators of the engine on small tables, with the edge cases that matter."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.vectors import cosine
from marlstone.operators import chunking, crawl, eav, graph, jobs, resolution, retrieval
from marlstone.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vector(*v):
    return F.array(*map(F.lit, v)).cast("array<float>")


def test_cosine(spark):
    assert one(spark, cosine(vector(1, 0), vector(0, 0))) == 0.0
    assert one(spark, cosine(vector(1, 0), vector(3, 0))) == pytest.approx(1)


def test_margin_keeps_the_best_and_zero_disables(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.83, 0.80, 0.66, 0.55, 0.4))], "query_id int, chunk_id int, sim double")
    kept = lambda m: sorted(r.chunk_id for r in retrieval.top_hits(rows, margin=m).collect())
    assert kept(0.12) == [0, 1] and kept(0.0) == [0, 1, 2, 3] and kept(0.001) == [0]
    assert [r.chunk_id for r in retrieval.top_hits(rows, k=1).collect()] == [0]


def test_context_sentences(spark):
    rows = spark.createDataFrame([(1, "chunk", "a", 0.5), (1, "chunk", "b", 0.9), (2, "fact", "f", 1.0)], "query_id int, kind string, item string, score double")
    found = {r.query_id: (r.facts, r.chunks) for r in retrieval.context(rows).collect()}
    assert found == {1: ("No structured facts.", "1. b\n2. a"), 2: ("1. f", "No documentation.")}


def test_chunk_sizes(spark):
    rows = [(1, " ".join(["w"] * 500)), (2, " ".join(["w"] * 501)), (3, ""), (4, None), (5, "a\n b")]
    found = chunking.chunk_tokens(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    sizes = {i: [r.token_count for r in found if r.doc_id == i] for i in (1, 2, 3, 4, 5)}
    assert sizes == {1: [500], 2: [500, 76], 3: [], 4: [], 5: [2]} and [r.chunk for r in found if r.doc_id == 5] == ["a\n b"]


def test_extraction_windows_cover_the_text():
    text = " ".join(f"Sentence number {i} says a thing." for i in range(400))
    windows = chunking.extraction_windows(text)
    assert all(len(w) <= 1800 for w in windows) and text.startswith(windows[0]) and text.endswith(windows[-1])
    at = 0
    for w in windows:
        start = text.index(w, max(at - 1800, 0))
        assert start <= at
        at = start + len(w)
    assert at == len(text)


def test_sections(spark):
    found = chunking.sections(spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n")], "doc_id int, text string")).collect()
    assert [r.section for r in found] == ["intro\n", "# A\nx\n", "## B\ny\n"]


def test_text_functions(spark):
    value = lambda c, t: one(spark, c(F.lit(t)))
    assert value(X.slugify, "  My File (v2)!.PDF ") == "my-file-v2.pdf" and value(X.slugify, "///") == "file"
    assert [value(X.singular, t) for t in ("policies", "uses", "gas", "ties")] == ["policy", "use", "gas", "tie"]
    assert value(X.cooldown_seconds, "Please try again in 6m33.5s.") == 393.5 and value(X.cooldown_seconds, "wait 2m") == 120 and value(X.cooldown_seconds, "no") is None
    assert value(X.error_class, "429 json_validate_failed") == "deterministic" and value(X.error_class, "Rate limit") == "rate_limited"
    assert value(X.strip_code_fence, "```json\n{}\n```") == "{}" and value(X.value_type, "1e3") == "number" and value(X.value_type, "TRUE") == "boolean"
    assert value(X.normalize_url, "HTTP://Ex.COM/a/b/?q=1#f") == "http://ex.com/a/b?q=1" and value(X.normalize_url, "http://e.com") == "http://e.com/"
    rows = spark.createDataFrame([("Ｆull—width  “Straße”",)], "v string").select(X.normalize_value("v").alias("x"))
    assert rows.first().x == 'full-width "strasse"'


def test_lookup_falls_back(spark):
    entities = spark.createDataFrame([("e1", "person", "Ann"), ("e2", "firm", "Acme")], "entity_id string, entity_type string, name string")
    values = spark.createDataFrame([("e2", "price", "$5", True), ("e2", "price", "$8", False), ("e2", "role", "x", False)], "entity_id string, attribute string, value string, superseded boolean")
    relations = spark.createDataFrame([("e2", "e1", "employs")], "source_id string, target_id string, relation_type string")
    asked = spark.createDataFrame([(1, "company", "ACME", "price"), (2, "firm", "acme", "nothing"), (3, None, "ann", None)], "query_id int, q_type string, q_name string, q_attribute string")
    found = eav.lookup(eav.resolve(entities, asked), eav.facts(values, relations, entities)).collect()
    assert {(r.query_id, r.branch, r.value) for r in found} == {(1, 0, "$8"), (2, 0, "$8"), (2, 0, "x"), (2, 1, "Ann"), (3, 2, "Acme")}


def test_graph(spark):
    r = spark.createDataFrame([(a, b, "r") for a, b in ("ab", "bc", "cd", "de", "ax", "xd", "ff")], "source_id string, target_id string, relation_type string")
    nodes = spark.createDataFrame([(n,) for n in "abcdefxz"], "entity_id string")
    edges = graph.undirected(r)
    path = lambda s, e, n=4: [x.entity_id for x in graph.shortest_path(edges, s, e, n).orderBy("position").collect()]
    assert path("a", "d") == ["a", "x", "d"] and path("a", "e") == ["a", "x", "d", "e"] and path("a", "e", 3) == [] and path("a", "a") == ["a"] and path("a", "z") == []
    assert {x.node: x.depth for x in graph.reach(edges, nodes.where("entity_id = 'a'"), 2).collect()} == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 2}
    assert {x.entity_id: x.degree for x in graph.degrees(nodes, r).collect()}["f"] == 2


@pytest.mark.parametrize("most, keys", [(50_000, 2_000_000), (1, 2_000_000), (1, 1)])
def test_large_frontiers_write_no_edges(spark, monkeypatch, most, keys):
    """Levels by a plain loop, with frontiers that are broadcast, that go by keys, and beyond; only levels are written."""
    draw, tables = random.Random(5), []
    pairs = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(90)] * 2
    monkeypatch.setattr(graph, "MOST_BROADCAST", most)
    monkeypatch.setattr(graph, "MOST_KEYS", keys, raising=False)
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: tables.append(df) or f(df))
    r = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_id string, target_id string, relation_type string")
    found = graph.reach(graph.undirected(r, distinct=False), spark.createDataFrame([("n1",), ("n2",)], "entity_id string"), 3)
    depth = {(s, s): 0 for s in ("n1", "n2")}
    for hop in range(1, 4):
        for (s, n), d in list(depth.items()):
            if d == hop - 1:
                for a, b in [*pairs, *((b, a) for a, b in pairs)]:
                    if a == n:
                        depth.setdefault((s, b), hop)
    assert sorted(tuple(x) for x in found.collect()) == sorted((*k, d) for k, d in depth.items())
    assert len(tables) == 4


def test_folds_of_repeated_edges_hold_no_pairs(spark):
    """Nodes at their only neighbour, by plain loops; no partition is sorted and no set of pairs is kept."""
    draw = random.Random(7)
    pairs = [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(30)] + [(f"leaf{i}", f"n{i % 5}") for i in range(30)] + [("solo", "solo")]
    nodes = spark.createDataFrame([(n, n[0]) for n in sorted({x for p in pairs for x in p} | {"none", "zero"})], "entity_id string, entity_type string")
    r = spark.createDataFrame([(a, b, "r") for a, b in sorted(set(pairs))], "source_id string, target_id string, relation_type string")
    around = {}
    for a, b in set(pairs):
        around.setdefault(a, set()).add(b), around.setdefault(b, set()).add(a)
    folded = Counter((min(around.get(n.entity_id, {"isolated"})), n.entity_type) for n in nodes.collect() if len(around.get(n.entity_id, ())) < 2)
    found = graph.isolated_and_folded(nodes, graph.undirected(r.union(r).repartition(3), distinct=False))
    assert {(x["at"], x.entity_type): x.n for x in found.collect()} == folded
    plan = graph._ends(graph.undirected(r, distinct=False))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_leaves_count_once(spark):
    """Hubs of leaves by plain loops; a node that is listed twice is one leaf, a loop makes none."""
    pairs = [(f"leaf{i}", f"n{i % 3}") for i in range(11)] + [("n0", "n1"), ("n2", "leaf10"), *((f"solo{i}", f"solo{i}") for i in range(4))]
    r = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_id string, target_id string, relation_type string")
    nodes = spark.createDataFrame([(n,) for p in pairs for n in p], "entity_id string")
    touching = Counter(x for p in pairs for x in p)
    hubs = Counter(b for a, b in pairs if touching[a] == 1)
    assert {x.hub: x.leaves for x in graph.leaf_folds(nodes, r).collect()} == {h: n for h, n in hubs.items() if n >= 3}


def test_supersession_restores(spark):
    provenance = spark.createDataFrame([("old", 1), ("new", 2), ("both", 1), ("both", 2)], "value_id string, version_id int")
    marked = lambda v: {r.value_id: r.superseded for r in resolution.supersession(provenance, spark.createDataFrame([(v,)], "version_id int")).collect()}
    assert marked(2) == {"old": True, "new": False, "both": False} and marked(1) == {"old": False, "new": True, "both": False}


def test_near_duplicate_values(spark):
    rows = spark.createDataFrame([("g", v) for v in ("The smallest yet functional version", "the smallest yet functional version.", "$500", "$800", None)], "group string, value string")
    assert {r.value for r in resolution.collapse_near_duplicates(rows).collect()} == {"the smallest yet functional version.", "$500", "$800"}


def test_retry_decisions(spark):
    cases = [("rate_limited", 0, "QUEUED", 600), ("rate_limited", 2, "QUEUED", 2400), ("rate_limited", 3, "DEAD_LETTER", None), ("worker_abandoned", 0, "QUEUED", None), ("checksum", 0, "FAILED", None), (None, 0, "FAILED", None)]
    rows = spark.createDataFrame([(i, k, a) for i, (k, a, *_) in enumerate(cases)], "i int, k string, a int").select("i", jobs.decide(F.col("k"), F.col("a")).alias("d")).orderBy("i").collect()
    assert [(r.d.status, r.d.wait) for r in rows] == [(s, w) for *_, s, w in cases]


def test_rate_limit_counts_rejected_events(spark):
    rows = [(1, i, datetime(2024, 1, 1, 0, 0, i)) for i in range(4)] + [(1, 9, datetime(2024, 1, 1, 0, 1, 0))]
    found = jobs.rate_limited(spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp"), 60, 2).orderBy("event_id").collect()
    assert [r.rejected for r in found] == [False, False, True, True, False] and [r.retry_after for r in found] == [None, None, 58, 57, None]


def test_dialogue_steps():
    def run(*turns):
        at = ("reason", 0)
        for t in turns:
            at = sessions.step(*at, t)
        return at[0]

    assert run("broken", "me@x.org") == "ticket" and run("broken", "no", "no", "no") == "abandoned" and run("broken", "cancel it") == "cancelled"


def test_pages(spark):
    html = '<html><title> T </title><body><nav>skip</nav><h1>Team</h1><div class="member-name">Ann</div><div class="role">CEO</div><p>Hi <b>you</b></p><a href="mailto:x@y">m</a><a href="b/c#f">l</a><a href="http://o.org/">o</a></body></html>'
    pages = spark.createDataFrame([(1, "http://e.com/a/", html), (2, "http://e.com", None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in crawl.page_text(pages).collect()}
    assert found[1].markdown.split("\n")[:4] == ["# Team", "Ann", "CEO", "Hi you"] and found[1].team == ["Ann: CEO"] and found[2].markdown == ""
    assert {(r.link, r.internal) for r in crawl.links(pages).collect()} == {("http://e.com/a/b/c", True), ("http://o.org/", False)}
    assert one(spark, crawl.sitemap_urls(F.lit("User-agent: *\nSITEMAP: http://e.com/s.xml "))) == "http://e.com/s.xml"
    assert one(spark, crawl.sitemap_locations(F.lit("<?xml version='1.0'?><urlset><url><loc> a </loc></url></urlset>"))) == ["a"]
    assert one(spark, crawl.sitemap_locations(F.lit("<sitemapindex><loc>a</loc></sitemapindex>"))) is None


def test_page_texts_by_slices(spark):
    """Each page has its own text on both sides of a slice's border; a worker holds PAGES texts, not a batch of pages."""
    n = 2 * crawl.PAGES + 3
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.when(F.col("id") % 7 > 0, F.format_string("<p>page %d</p><li>x", "id")).alias("html")).coalesce(1)
    found = crawl.page_text(pages)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(i, f"page {i}\n- x" if i % 7 else "", []) for i in range(n)]


def test_address_classes_are_the_librarys(spark):
    import ipaddress

    from marlstone.functions.answers import unsafe_address

    draw = random.Random(3)
    four = [f"{draw.choice([0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 239, 240, 255])}.{draw.choice([0, 16, 18, 19, 31, 51, 64, 100, 127, 168, 254, 255])}.{draw.choice([0, 2, 100, 113, 255])}.{draw.choice([0, 1, 8, 170, 255])}" for _ in range(400)]
    six = ["::1", "::", "fe80::1", "ff02::1", "fc00::5", "fd12:3456::1", "2001:db8::1", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:4860:4860:0:0:0:0:8888"]
    bad = ["256.1.1.1", "1.2.3", "", "x", "1.2.3.4.5", ":::1", "1::2::3"]
    found = {r.a: r.u for r in spark.createDataFrame([(a,) for a in four + six + bad], "a string").select("a", unsafe_address(F.col("a")).alias("u")).distinct().collect()}
    for a in four + six:
        ip = ipaddress.ip_address(a)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        marks = {"loopback": ip.is_loopback, "link-local": ip.is_link_local, "unspecified": ip.is_unspecified, "multicast": ip.is_multicast, "reserved": ip.is_reserved, "private": ip.is_private}
        expected = next((k for k, v in marks.items() if v), None if ip.is_global else "not globally routable")
        assert found[a] == expected, (a, found[a], expected)
    assert {found[a] for a in bad} == {"not an address"}


def test_team_members_by_whole_classes():
    from marlstone.operators.crawl import _Page

    page = _Page()
    page.feed('<b class="hostname">srv1</b><i class="role">x</i><div class="wrap member-name">Ann <b>Bo</b></div><br><p class="member_title pb-3">CTO</p><p class="designation">none left</p><span class="team_member_name">Cy</span><span class="position">Dev</span>')
    page.close()
    assert page.team == [("Ann Bo", "CTO"), ("Cy", "Dev")]


def test_values_that_differ_in_dashes_are_one(spark):
    from marlstone.operators.resolution import collapse_near_duplicates

    rows = [("g", "Phase – one “final”"), ("g", "phase - one \"final\""), ("g", "Another thing altogether"), ("h", "phase - one")]
    found = collapse_near_duplicates(spark.createDataFrame(rows, "group string, value string")).collect()
    assert sorted(map(tuple, found)) == [("g", "Another thing altogether"), ("g", "Phase – one “final”"), ("h", "phase - one")]


def test_merge_plan_rules(spark):
    from marlstone.operators.resolution import merge_plan, merged_ids

    rows = [("1", "Methodology", "Agile"), ("2", "Process", "agile "), ("3", "Development Process", "AGILE"), ("4", "Process", "Other"), ("5", "Company", "eBay"), ("6", "company", "ebay"), ("7", "Technology", "PostgreSQL"), ("8", "Database", "postgresql")]
    facts = [("1", 39), ("2", 14), ("3", 2), ("5", 1), ("6", 1), ("7", 8), ("8", 1)]
    entities = spark.createDataFrame(rows, "entity_id string, entity_type string, name string")
    plan = merge_plan(entities, spark.createDataFrame(facts, "entity_id string, facts long"), {"company": "Company"}, {"postgresql": "Database"})
    found = {r.name_norm: (r.survivor, r.chosen_type, r.label) for r in plan.collect()}
    # the rarest type must carry a fifth of the facts; a reviewed type wins; the best-cased name is the label
    assert found == {"agile": ("1", "Methodology", "AGILE"), "ebay": ("5", "Company", "eBay"), "postgresql": ("7", "Database", "PostgreSQL")}
    assert sorted(map(tuple, merged_ids(entities, plan).collect())) == [("2", "1"), ("3", "1"), ("6", "5"), ("8", "7")]


def test_chunks_of_a_version_are_replaced_on_disk(spark, tmp_path):
    from marlstone.operators.extraction import write_chunks

    path = f"{tmp_path}/chunks"
    rows = lambda r: spark.createDataFrame(r, "version_id long, chunk_index int, checksum string")
    write_chunks(rows([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), path)
    write_chunks(rows([(1, 0, "z")]), path)
    assert sorted((r.version_id, r.chunk_index, r.checksum) for r in spark.read.parquet(path).collect()) == [(1, 0, "z"), (2, 0, "c")]


def test_source_types_in_no_category_fail(spark):
    from marlstone.operators.chunking import chunk_document

    docs = spark.createDataFrame([(1, "a b c", "PDF"), (2, "", "CSV"), (3, None, "??")], "doc_id long, text string, source_type string")
    assert [r.chunk for r in chunk_document(docs, ["PDF"], ["CSV"]).collect()] == ["a b c"]
    with pytest.raises(Exception, match="not exactly one category"):
        chunk_document(docs, ["PDF"], ["PDF"]).collect()


def test_scores_in_blocks(spark, monkeypatch):
    from marlstone.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_GROUP", 3)
    vectors = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(11)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0])]
    chunks = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    found = retrieval.score(chunks, chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("probe"))).collect()
    assert len(found) == 11 * 11 + 1
    for r in found:
        a, b = dict(vectors)[r.chunk_id], dict(vectors)[r.query_id]
        assert abs(r.sim - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5) < 1e-9
    best = retrieval.top_hits(retrieval.score(chunks, chunks.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("probe")), k=2), threshold=-1.0, k=2, margin=0)
    assert {(r.query_id, r.chunk_id) for r in best.where("query_id < 90").collect()} >= {(i, i) for i in range(5)}
