"""Curve packing, the filter audit and collocations against libraries, plain loops and SQL."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marlstone.llm import audit, collocations, curve, queries

SF = "/root/testdata/sf0.01"
BYTES = "byte_bpe_50k.json"
ALPHABET = "ab ABÉé Σσς İıß.,!?;: \n\t\x0b\x1c\xa0'sStreLL<|endoftext|><s></s>0123日本\U0001F600\u0300▁=/*-_{}()\u3000\x85  \n\n"
LONG = " ".join(f"Word{i % 997}x{i}" for i in range(30_000))
AWKWARD = [None, "", " \n\t ", "one", "Same text here", "Same text here", LONG, "ab" * 40_000, "été \U0001f600 日本語 end #"]


def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, "k", 1.0, 1, 1) for i, t in enumerate(AWKWARD)]
    rows += [rows[4], (None, AWKWARD[4], "en", None, 1, "k", 1.0, 1, 1), (None, AWKWARD[4], "en", None, 1, "k", 1.0, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, p0 double, mask int, n long").repartition(3)


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.sql(sql)


def test_byte_ids_are_the_librarys():
    from tokenizers import Tokenizer

    r, path = random.Random(1), public_tokenizers.path(BYTES)
    noise = lambda n, size, letters: ["".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(n)]
    cases = ["", " ", "\n", "  a", "a  ", "a \n", "a<|endoftext|>b", "<|endoftext|>" * 3, *noise(3000, 80, ALPHABET), *noise(3000, 60, "ab 's1,\n\t é")]
    library, coder = Tokenizer.from_file(path), curve.ByteIds(path)
    expected = [library.encode(c, add_special_tokens=False).ids for c in cases] + [[]]
    assert [f.tolist() for f in coder.encode(pa.array([*cases, None]))] == expected
    coder.held = 1 << 40  # the cache is dropped after the next call
    assert [f.tolist() for _ in range(2) for f in coder.encode(pa.array(cases[::-1]))] == expected[-2::-1] * 2
    assert coder.encode(pa.array([], pa.string())) == [] and [f.tolist() for f in coder.encode(pa.array([None, ""]))] == [[], []]


def test_hilbert_keys_are_a_walk():
    for dims, bits in ((2, 5), (3, 4), (4, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve.hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).tolist() == [1] * (len(grid) - 1)


@pytest.mark.parametrize("batch, task", [(curve.BATCH_TOKENS, curve.TASK_TOKENS), (5_000, 100_000)])
def test_curve_packing_is_an_exact_round_trip(spark, monkeypatch, batch, task):
    from tokenizers import Tokenizer

    monkeypatch.setattr(curve, "BATCH_TOKENS", batch)
    monkeypatch.setattr(curve, "TASK_TOKENS", task)
    path = public_tokenizers.path(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = curve.pack_along_curve(docs, path, with_ids=True).toPandas()
    library, whole = Tokenizer.from_file(path), dict(list(found.groupby("doc_id")))
    texts = docs.select("doc_id", "text").collect()
    assert set(whole) == {r.doc_id for r in texts}
    for r in texts:
        g = whole[r.doc_id].sort_values("start")
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        assert np.concatenate(g["ids"].tolist()).tolist() == ids and set(g["doc_tokens"]) == {len(ids)}
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        assert g["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in g["ids"]]
    sizes = Counter()
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
        sizes[int(g["length"].sum())] += 1
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes) and sum(v for k, v in sizes.items() if k < 2048) <= 11 * (1 + sum(k * v for k, v in sizes.items()) // task)
    neighbours = found.sort_values(["curve", "doc_id"]).drop_duplicates("doc_id")["doc_id"].map(dict(docs.select("doc_id", "lang").collect()))
    assert (neighbours.to_numpy()[1:] == neighbours.to_numpy()[:-1]).mean() > 0.8  # by chance under a half


def test_curve_packing_of_awkward_rows(spark):
    docs, path = awkward(spark), public_tokenizers.path(BYTES)
    found = curve.pack_along_curve(docs, path).toPandas()
    tokens = found.groupby("doc_id", dropna=False)["length"].sum()
    assert tokens[0] == tokens[1] == 1 and tokens[4] == 2 * tokens[5] and tokens[np.nan] == 2 * tokens[5]
    assert set(found["doc_id"].dropna()) == set(range(len(AWKWARD)))
    assert found["sequence_id"].nunique() == len(found[found["offset"] == 0])
    assert curve.pack_along_curve(docs.limit(0), path).collect() == []


def plain_audit(docs, labels):
    """Every document through every order, one filter after the other."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = Counter()
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        part = s or ""
        for o in map("".join, permutations("ABCDE")):
            for k, c in enumerate(o):
                gone, fails = any(x in f for x in o[:k]), c in f
                for name, yes in (("kept", not gone and not fails), ("removed", fails and not gone), ("redundant", fails and gone), ("unique_fails", f == c), ("good_lost", fails and not gone and i in good), ("toxic_lost", fails and not gone and i in toxic)):
                    rows[part, o, k + 1, name] += yes
    shapley = Counter()
    for (part, o, k, name), n in list(rows.items()):
        if name == "removed":
            shapley[part, o[k - 1]] += n
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, k, *(rows[p, o, k, n] for n in names), shapley[p, o[k - 1]]) for p, o, k, _ in rows}


def test_audit_by_plain_loops(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in audit.audit(docs, labels).collect()]
    assert len(found) == len(set(found)) == 1200
    assert set(found) == plain_audit([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.collect()])
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert len(audit.audit(docs, labels.limit(0)).collect()) == 1200


@pytest.mark.parametrize("name", ["op11_collocations", "op13_filter_audit"])
def test_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    expected = sql_rows(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = lambda rs: sorted(map(tuple, rs), key=str)
    assert rows(found.select(columns).collect()) == rows(expected.select(*columns).fetchall())


def test_slots_are_a_minimal_perfect_hash():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 70, 30_000):
        keys = np.unique(r.integers(1, 1 << 63, (n, 3)).astype(np.uint64), axis=0)
        keys[: n // 2, 2] = 0
        keys[: n // 4, 1] = 0
        slots = collocations.Slots(keys)
        found = slots.find(*(np.ascontiguousarray(keys[:, i]) for i in range(3)))
        assert sorted(found.tolist()) == list(range(n)) and (slots.keys[found] == keys).all()
        other = r.integers(1, 1 << 63, 5_000).astype(np.uint64)
        assert (slots.find(other) == -1).all() and (slots.find(other, other) == -1).all()
        if n > 8:  # parts of other keys are no keys
            assert (slots.find(keys[n // 2 :, 0].copy(), keys[n // 2 :, 1].copy()) == -1).all()


def plain_collocations(rows, least, top, dominated=50):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            w = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= dominated * a for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, key_bits", [(collocations.BLOCK, 64), (40, 64), (collocations.BLOCK, 9)])
def test_collocations_by_plain_counts(spark, monkeypatch, block, key_bits):
    monkeypatch.setattr(collocations, "BLOCK", block)
    r, words = random.Random(5), "Red fox ran FAR into the old été Été 日本 x\u00a0y x\x1cy a the the".split(" ")
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \n ", "fr"), ("ab " * 5_000, "fr"), ("q" * 200_000, "fr"), *[rows[0]] * 3]
    docs = spark.createDataFrame([(t, lang, "k", 1) for t, lang in rows], "text string, lang string, w1 string, f int").repartition(5)
    found = sorted(tuple(x) for x in collocations.collocations(docs, least=3, top=30, key_bits=key_bits).collect())
    assert found == plain_collocations(rows, 3, 30)
    if key_bits < 64:
        assert collocations.frequent_words(docs, 3, key_bits)[1].seed > 0
    else:
        assert collocations.collocations(docs.limit(0)).collect() == []
