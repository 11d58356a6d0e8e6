"""Queries that must run over all of their rows and whole texts."""

import os
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.parquet as pq

from marlstone.operators import near_values, resolution
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def run(spark, name, sf_dir=SF):
    return registry.QUERIES[name](spark, sf_dir)


def folder(tmp_path, **tables):
    """The smallest tables, some of them replaced."""
    for file in os.listdir(SF):
        if file[:-8] not in tables and file.endswith(".parquet"):
            os.symlink(f"{SF}/{file}", tmp_path / file)
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_every_stated_probe_is_asked(spark):
    stated = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 20 == 0}
    assert len(stated) > 20
    assert {r.query_id for r in run(spark, "wn5_rank_of_first_expected").collect()} == stated
    assert run(spark, "ag15_ag16_recall_mrr").first().n == len(stated)
    assert {r.query_id for r in run(spark, "jn19_pf9_cosine_over_threshold").collect()} > {r for r in stated if r < 5}


def test_code_fences_of_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props")
    inside = {r.event_id: r.inside for r in run(spark, "sc19_code_fences").collect()}
    assert inside == {r.event_id: f"see ```{r.props}```" if r.event_id % 3 == 2 else r.props for r in events.collect()}


def test_provides_edges_of_every_line(spark, tmp_path):
    lines = [{"l_orderkey": 1, "l_partkey": p, "l_suppkey": s, "l_linenumber": n} for n, (p, s) in enumerate([(20, 1), (21, 1), (40, 2), (21, 1)], 1)]
    d = folder(tmp_path, lineitem=lines)
    found = {(r.source_type, r.target_type): r.n for r in run(spark, "ag24_gr12_relation_histogram", d).collect()}
    assert found["supplier", "part"] == 3
    assert {"part:20", "part:21", "part:40"} <= {r.entity_id for r in run(spark, "st1_st4_undirected_ends", d).collect()}
    assert {r.entity_id: r.degree for r in run(spark, "gr3_ag22_degrees", d).collect()}["supplier:1"] == 3
    exported = {r.source_id for r in run(spark, "src28_graph_export", d).collect()}
    assert {"supplier:1", "supplier:2"} <= exported and any(x.startswith("customer:") for x in exported)


def test_groups_of_any_size_are_collapsed(spark, monkeypatch):
    """Rounds of few values give what one pass over the group gives; copies of a value are no reason to stop."""
    drawn = random.Random(4)
    values = [" ".join(drawn.choice(["large", "small", "green", "steel", "brass"]) for _ in range(4)) + drawn.choice(["", ".", "!"]) for _ in range(300)]
    kept = []
    for v in sorted(set(values), key=lambda v: (-len(v), v)):
        if not any(SequenceMatcher(None, v.lower(), k.lower()).ratio() >= 0.92 for k in kept):
            kept.append(v)
    rows = spark.createDataFrame([("hot", v) for v in values] + [("cold", "a"), ("cold", None), (None, "b")] + [("same", "x")] * 2_001, "group string, value string")
    expected = sorted([("hot", v) for v in kept] + [("cold", "a"), ("", "b"), ("same", "x")])
    assert len(kept) > 40
    for wave in (40, 2_000):
        monkeypatch.setattr(near_values, "WAVE", wave)
        assert sorted((r.group or "", r.value) for r in resolution.collapse_near_duplicates(rows).collect()) == expected


def test_whole_texts_are_rendered_and_named(spark, tmp_path):
    long = "word " * 100
    d = folder(
        tmp_path,
        conversations=[{"conv_id": 1, "turn": t, "role": "user", "text": f"{long}{t}"} for t in (0, 1)],
        documents=[{"doc_id": 1, "text": long, "lang": "en", "source": "s", "n_chars": len(long)}],
    )
    assert [r.history for r in run(spark, "sc21_history_lines", d).collect()] == [f"1. {long}0\n2. {long}1"]
    assert [r.key for r in run(spark, "sc4_sc5_storage_keys", d).collect()] == ["uploads/s/1/" + ("word-" * 100)[:128]]
