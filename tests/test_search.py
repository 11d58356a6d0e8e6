"""Vector search and order statistics against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval
from marlstone.operators.statistics import nearest_ranks


def vectors(n, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.3 * r.normal(size=6)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # one vector many times
    return rows + [(n + 40, None), (n + 41, [0.0] * 6), (n + 42, [1.0, 2.0]), (n + 43, []), (n + 44, [float("nan")] * 6), (n + 45, [2.0, 4.0])]


def plain(chunks, queries, threshold, k):
    out = []
    for q, p in queries:
        found = []
        for c, v in chunks:
            if v and p and len(v) == len(p):
                size = np.linalg.norm(v) * np.linalg.norm(p)
                if size > 0 and (sim := round(float(np.dot(v, p) / size), 12)) >= (-9 if threshold is None else threshold):
                    found.append((-sim, c))
        out += [(q, c, -s) for s, c in sorted(found)[:k]]
    return sorted(out)


@pytest.mark.parametrize("threshold, k, group", [(None, 5, 1 << 16), (0.3, 8, 7), (0.8, None, 13), (0.5, 3, 40)])
def test_grid_search_by_plain_loops(spark, monkeypatch, threshold, k, group):
    monkeypatch.setattr(retrieval, "QUERY_GROUP", group)
    rows = vectors(300, 1)
    chunks = spark.createDataFrame([(c, f"t{c}", v) for c, v in rows], "chunk_id long, query string, embedding array<double>").repartition(5)
    asked = [(f"q{c}", v) for c, v in rows if c % 9 == 0 or c > 330]
    queries = spark.createDataFrame(asked, "query_id string, probe array<double>")
    found = retrieval.score(chunks, queries, threshold, k)
    assert found.columns == ["chunk_id", "query", "query_id", "sim"]
    if k:
        found = retrieval.top_hits(found, -2 if threshold is None else threshold, k, 0)
    got, expected = sorted((r.query_id, r.chunk_id, r.sim) for r in found.collect()), plain(rows, asked, threshold, k)
    assert [g[:2] for g in got] == [e[:2] for e in expected] and np.allclose([g[2] for g in got], [e[2] for e in expected], atol=1e-10)
    assert retrieval.score(chunks, queries.limit(0), threshold, k).collect() == [] == retrieval.score(chunks.limit(0), queries, threshold, k).collect()


def test_cells_hold_a_bounded_number(monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_PAIRS", 64)
    r = np.random.default_rng(2)
    asked, stored = r.normal(size=(9, 5)), np.repeat(r.normal(size=(50, 5)), 20, axis=0)
    cell, most = retrieval._Cell(pa.array(range(9)), asked, None, 4, "id"), 0
    for at in range(0, 1000, 100):
        assert not list(cell.meet(pa.StructArray.from_arrays([pa.array(range(at, at + 100))], ["id"]), stored[at : at + 100]))
        most = max(most, cell.n_held)
    (query, sim, items), = cell.best()
    sims = np.round((asked / np.linalg.norm(asked, axis=1)[:, None]) @ (stored / np.linalg.norm(stored, axis=1)[:, None]).T, 12)
    expected = [(q, i) for q in range(9) for i in np.lexsort((range(1000), -sims[q]))[:4].tolist()]
    assert list(zip(query.tolist(), items.field("id").to_pylist(), strict=True)) == expected
    assert most <= 2 * 9 * 4 + 64 + 9 * 64


def test_plan_does_not_grow_with_the_queries(spark):
    ids = spark.range(20_000)
    chunks = ids.limit(50).select(F.col("id").alias("chunk_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    plans = [retrieval.score(chunks, ids.where(f"id < {n}").select(F.col("id").alias("query_id"), F.array(F.col("id") + 2.0, F.lit(1.0)).alias("probe")), k=2)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (100, 20_000)]
    assert plans[0] == plans[1]


def test_nearest_ranks(spark):
    r = random.Random(1)
    rows = [(g, r.choice([0.5, r.random()])) for g in ("a", "b") for _ in range(501)] + [("a", None), ("c", 1.0), ("d", None)]
    fractions = {"least": 0.0, "p10": 0.1, "half": 0.5, "p99": 0.99, "most": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    expected = set()
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        expected |= {(g, n, v[round(f * (len(v) - 1))]) for n, f in fractions.items()}
    assert {tuple(x) for x in nearest_ranks(df, "v", fractions, ["g"]).collect()} == expected
    every = sorted(x for _, x in rows if x is not None)
    assert {tuple(x) for x in nearest_ranks(df, "v", fractions).collect()} == {(n, every[round(f * (len(every) - 1))]) for n, f in fractions.items()}
    assert nearest_ranks(df.limit(0), "v", fractions).collect() == []


def test_products_of_whole_numbers_are_the_plain_formulas(spark):
    """Equal directions tie, and sums whose thirteenth decimal is a five or next to it round as in SQL, in any block."""
    r = np.random.default_rng(11)
    stored, asked = r.integers(-9, 10, (700, 24)).astype(float), r.integers(-9, 10, (300, 24)).astype(float)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "chunk_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, probe array<double>")
    found = retrieval.score(chunks, queries).toPandas()
    size = np.sqrt((asked * asked).sum(axis=1))[:, None] * np.sqrt((stored * stored).sum(axis=1))
    exact = (asked @ stored.T) / size
    expected = np.copysign(np.floor(np.abs(exact) * 1e12 + 0.5), exact) / 1e12
    assert len(found) == expected.size and (found["sim"].to_numpy() == expected[found["query_id"], found["chunk_id"]]).all()
