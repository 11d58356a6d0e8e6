"""Operators against brute force, libraries, SQL and held-out labels."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontamination, language, packing, quality, queries, simhash, substrings, tokens, toxicity

SF = "/root/testdata/sf0.01"
PIECE, WORD = "piece_bpe_32k.model", "word_bpe_49k.json"
ALPHABET = "ab ABÉé Σσς İıß.,!?;: \n\t\x0b\x1c\xa0'sStreLL<|endoftext|><s></s>0123日本\U0001F600̀▁=/*-_{}()"


def noise(n, size, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.sql(sql)


def test_random_quotes_by_sql(spark, tmp_path):
    r, words = random.Random(11), "red fox ran far into the Old dark wood and slept".split()
    rows = []
    for conv in range(60):
        said = []
        for turn in range(r.randint(1, 9)):
            lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 3))]
            for _ in range(r.choice([0, 0, 1, 2]) if said else 0):
                quoted = r.choice(said).split(chr(10))
                level = r.randint(1, 3)
                if r.random() < 0.5:  # wrapped anew
                    w = " ".join(quoted).split()
                    quoted = [" ".join(w[i : i + 4]) for i in range(0, len(w), 4)]
                at = r.randint(0, len(lines))
                lines[at:at] = [r.choice(["> ", ">", " >  "]) * level + q.replace(" ", r.choice([" ", "  "])).upper() for q in quoted]
            text = chr(10).join(lines)
            said.append(text)
            rows.append((conv, turn, "user", text))
    rows += [rows[3], (None, 1, "USER", "> x"), (1, None, "bot", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected, found = con.sql(queries.ORACLE_SQL["op5_chat_formatting"]), queries.QUERIES["op5_chat_formatting"](spark, str(tmp_path))
    columns = sorted(expected.columns)
    same = lambda rs: sorted(map(tuple, rs), key=str)
    got = same(found.select(columns).collect())
    assert got == same(expected.select(*columns).fetchall())
    assert sum(r[columns.index("reply_to")] is not None for r in got) > 60


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_chat_formatting", "op7_substring_dedup"])
def test_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    expected = sql_rows(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = lambda rs: sorted(map(tuple, rs), key=str)
    assert rows(found.select(columns).collect()) == rows(expected.select(*columns).fetchall())


def test_token_counts_are_the_librarys():
    import sentencepiece

    path = public_tokenizers.path(PIECE)
    cases = ["", " ", "   x", "a ", "a" * 1000, " " * 37, "==" * 100, "日本語" * 300, "\x00a\x00", *noise(1500, 150, 1), *noise(500, 200, 2, "a -=")]
    assert tokens.count_tokens(path, cases) == list(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode(cases, num_threads=1)))


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD)
    cases = ["", "It'S, THEY'LL.,!", "a.'s", "ΣΑΣ, x", "x<|endoftext|>Y", "<|ENDOFTEXT|>", "ab!'s cd'' e*'t", "abc\x1cd ab\x85c", "q" * 300, *noise(3000, 80, 3), *noise(3000, 60, 8, "ab '!*s")]
    words = packing.WordIds(path)
    found = words.encode(pa.array(cases))
    assert words.encode(pa.array([None, cases[1]])) == [b"", found[1]] and words.encode(pa.array([], pa.string())) == []
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(c, add_special_tokens=False).ids for c in cases]


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(WORD)
    found = packing.pack_documents(docs, path, with_ids=True).toPandas()
    library = Tokenizer.from_file(path)
    whole = {i: g.sort_values("piece") for i, g in found.groupby("doc_id")}
    assert set(whole) == set(texts)
    for i, g in whole.items():
        ids = library.encode(texts[i], add_special_tokens=False).ids + [0]
        assert np.concatenate(g["ids"].tolist()).tolist() == ids  # an exact round trip
        assert g["start"].tolist() == list(range(0, len(ids), 2048)) and g["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in g["ids"]]
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 2048
    assert found["sequence_id"].nunique() <= packing.lower_bound(found["length"].to_numpy(), 2048) + 1


def test_lower_bound_holds():
    draw = np.random.default_rng(0)
    for _ in range(200):
        lengths = draw.integers(1, 31, draw.integers(1, 12))
        bins, offsets, used = packing.best_fit(lengths, 30)
        assert packing.lower_bound(lengths, 30) <= used and all(lengths[bins == b].sum() <= 30 for b in range(used))
    assert packing.lower_bound(np.array([16] * 7), 30) == 7  # the sum alone would say 4


def test_substrings_by_brute_force(spark):
    r = random.Random(5)
    pool = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(10, 70))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            words += p[a : a + r.randint(1, 60)] + [f"w{r.randrange(50)}" for _ in range(r.randint(0, 3))]
        rows.append((i * 7 % 120, r.choice([" ", "\n", "  "]).join(words)))
    first, expected = {}, {}
    grams = lambda t: [tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)]
    for i, t in sorted(rows):
        for g in grams(t):
            first.setdefault(g, i)
    for i, t in rows:
        gone = {k + j for k, g in enumerate(grams(t)) if first[g] < i for j in range(13)}
        expected[i] = " ".join(w for k, w in enumerate(t.split()) if k not in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substrings.remove_duplicate_spans(docs).collect()
    assert {r.doc_id: r.text for r in found} == expected
    text = dict(rows)
    for r in substrings.duplicate_spans(docs).collect():  # each factor's words stand in its source
        assert r.source < r.doc_id and r.n_words >= 13
        assert text[r.doc_id].split()[r.start : r.start + r.n_words] == text[r.source].split()[r.source_start : r.source_start + r.n_words]
    kept = {r.doc_id: r.text for r in substrings.remove_duplicate_spans(docs, layout=True).collect()}
    assert {i: " ".join(t.split()) for i, t in kept.items()} == expected
    assert all(kept[i] == t for i, t in rows if len(expected[i].split()) == len(t.split()))


def test_windows_that_agree_in_one_hash_only_are_not_equal():
    head = np.zeros(3, substrings._HEAD)
    head["order"], head["size"] = [1, 2, 3], [3, 3, 2]
    key = np.array([5, 6, 7, 5, 6, 8, 6, 7], np.uint64)
    check = np.array([1, 1, 1, 1, 2, 1, 1, 1], np.uint32)  # the second document's window 6 is another one
    found = substrings._parse(head, (key, check))
    assert [(int(f["order"]), int(f["start"]), int(f["count"]), int(f["source"]), int(f["at"])) for f in found] == [(2, 0, 1, 1, 0), (3, 0, 2, 1, 1)]


def test_payloads_keep_their_numbers():
    draw = np.random.default_rng(5)
    for n in (0, 1, 7):
        head = np.empty(n, substrings._HEAD)
        head["order"], head["row"], head["first"], head["size"] = draw.integers(-(1 << 60), 1 << 60, n), draw.integers(0, 1 << 32, n), draw.integers(0, 1 << 32, n), draw.integers(1, 33, n)
        many = int(head["size"].astype(int).sum())
        keys, checks = draw.integers(0, 1 << 64, many, np.uint64), draw.integers(0, 1 << (8 * substrings.CHECK_BYTES), many).astype(np.uint32)
        back, (k, c) = substrings._unpack(substrings._pack(head, (keys, checks)))
        assert (back == head).all() and (k == keys).all() and (c == checks).all() and len(k) == many


def test_long_words_and_gaps_are_hashed_alike_in_pieces(monkeypatch):
    texts = [b"ab  cd " * 50 + b"x" * 300 + b" ab", None, b"", b" \n ", b"cd " * 100]
    whole = substrings._word_hashes(texts)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 17)
    assert all((a == b).all() for a, b in zip(whole, substrings._word_hashes(texts), strict=True)) and whole[1].tolist() == [102, 0, 0, 0, 100]


def test_simhash_by_brute_force(spark, docs, texts):
    from xxhash import xxh64_intdigest

    fps, class_of = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = t.encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(len(words) - 3, 1))] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and class_of[a] != class_of[b]:
                low, high = sorted((class_of[a], class_of[b]))
                class_of = {i: low if c == high else c for i, c in class_of.items()}
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component) for r in found} == {i: (fps[i], class_of[i]) for i in texts}


def test_hamming_links_of_dense_groups(spark):
    r = random.Random(6)
    centres = [r.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(r.choice([3, 200]))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps)).collect()

    def classes(pairs):
        at = {f: f for f in signed}
        for a, b in pairs:
            while at[a] != a:
                a = at[a]
            while at[b] != b:
                b = at[b]
            at[max(a, b)] = min(a, b)
        root = lambda f: f if at[f] == f else root(at[f])
        return {f: root(f) for f in signed}

    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4
    assert all(near(a, b) for a, b in links)
    assert classes(links) == classes((a, b) for i, a in enumerate(signed) for b in signed[:i] if near(a, b))


def test_components_with_hubs(spark, monkeypatch):
    from marlstone.llm import components

    monkeypatch.setattr(components, "LEAST_HUB", 5)
    r = random.Random(3)
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(i, 500 + i % 7) for i in range(200, 260)] + [(7, 7), (None, 3)]
    pairs += [(b, a) for a, b in pairs if r.random() < 0.3]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = {i: 0 for i in range(60)} | {100 + i: 100 for i in range(31)}
    for i in range(200, 260):
        expected[i] = expected[500 + i % 7] = min(k for k in range(200, 260) if k % 7 == i % 7)
    assert found == {k: c for k, c in expected.items() if k != c}


def test_equal_keys_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (2, "one two three four five six"), (None, "x")], "doc_id long, text string")
    found = [sorted(map(str, simhash.drop_near_duplicates(docs.repartition(n)).collect())) for n in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lang = queries.QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.95 * lang.count()
    good = queries.QUERIES["op8_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out")
    assert good.where("quality = predicted").count() >= 0.95 * good.count()
    toxic = queries.QUERIES["op10_toxicity"](spark, SF).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where("held_out")
    assert toxic.where("label = 0 AND toxic").count() <= 0.02 * toxic.count() and toxic.where("toxic = (label = 1)").count() >= 0.95 * toxic.count()


def test_contamination_by_plain_edit_distance(spark):
    r = random.Random(17)
    words = [f"{a}{b}" for a in "abcdefg" for b in "xyz"]
    items = [[r.choice(words) for _ in range(n)] for n in (5, 9, 15, 16, 22, 40, 40, 120)]
    index = decontamination.ItemIndex([(f"i{k}", w) for k, w in enumerate(items)])
    texts = []
    for k in range(240):
        ids = [r.choice(words) for _ in range(r.randint(0, 40))]
        w = list(r.choice(items))
        for _ in range(r.randint(0, int(0.25 * len(w)) + 1)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 and len(w) > 1 else [r.choice(words)]
        texts.append(" ".join(ids + w + [r.choice(words) for _ in range(r.randint(0, 40))]))

    def least(item, text):  # edit distance of an item to the nearest stretch of a text, by the plain table
        row = [0] * (len(text) + 1)
        for w in item:
            before, row = row, [row[0] + 1]
            for j, t in enumerate(text, 1):
                row.append(min(before[j - 1] + (w != t), before[j] + 1, row[-1] + 1))
        return min(row)

    expected = {(d, f"i{k}"): e for d, t in enumerate(texts) for k, item in enumerate(items) if (e := least(item, t.split())) <= int(0.2 * len(item))}
    bench = spark.createDataFrame([(f"i{k}", " ".join(w)) for k, w in enumerate(items)], "item_id string, text string")
    rows = decontamination.find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    found = {}
    for row in rows:
        found[row.doc_id, row.item_id] = min(row.edits, found.get((row.doc_id, row.item_id), 99))
    assert found.keys() <= expected.keys() and len(found) >= 0.99 * len(expected)
    assert sum(found[p] == expected[p] for p in found) >= 0.98 * len(found)
    # without an embedding that reaches the recall, every window around a run is checked
    exact = decontamination.ItemIndex([(f"i{k}", w) for k, w in enumerate(items)], recall=1.1)
    assert set(exact.repeats.values()) - {1} == {0}
    pairs = {(d, f"i{m[1]}") for d, t in enumerate(texts) for m in decontamination._matches(exact, [t.encode()])}
    assert pairs == expected.keys() and index.repeats.keys() == exact.repeats.keys()


def test_ftrl_by_a_dense_loop():
    draw = np.random.default_rng(2)
    rows = [(np.sort(draw.choice(40, 6, replace=False)), draw.random(6), int(draw.integers(3))) for _ in range(30)]
    weights, bias = language.fit_ftrl(rows, 3, epochs=2, seed=1)
    z, n, b, bn = np.zeros((40, 3)), np.zeros((40, 3)), np.zeros(3), np.zeros(3)

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= 0.02 else (np.sign(z[i, c]) * 0.02 - z[i, c]) / ((1 + np.sqrt(n[i, c])) / 0.5 + 0.01)

    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation(30):
            at, x, y = rows[k]
            w = np.array([[weight(i, c) for c in range(3)] for i in at])
            p = np.exp(x @ w + b)
            error = p / p.sum() - (np.arange(3) == y)
            for j, i in enumerate(at):
                for c in range(3):
                    g = x[j] * error[c]
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / 0.5 * w[j, c]
                    n[i, c] += g * g
            bn += error**2
            b -= 0.5 / (1 + np.sqrt(bn)) * error
    assert np.allclose(bias, b) and np.allclose(weights[:40], [[weight(i, c) for c in range(3)] for i in range(40)])


def test_long_texts_in_pieces(monkeypatch):
    raw = "Ein Satz, zwei  Sätze; 3 Wörter\n".encode() * 40
    whole = language.features(raw)
    monkeypatch.setattr(language, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, language.features(raw), strict=True))
    model = quality.AttentionModel()
    text = b" ".join(b"w%d" % (i % 77) for i in range(5000)) + b" end"
    expected = model.scores(*quality.encode_passages([text.decode()]))[0]
    monkeypatch.setattr(quality, "ENCODE_BYTES", 900)
    assert abs(model.score_in_pieces(text) - expected) < 1e-6 and len(list(quality._pieces(text))) > 5


def test_ordinal_gradients():
    draw = np.random.default_rng(4)
    row, column = np.repeat(np.arange(12), 3), draw.integers(0, 6, 36)
    y, weight = draw.integers(0, 4, 12), np.full(12, 1 / 12)
    x = np.r_[draw.normal(size=6), -0.5, 0.2, -0.3]
    loss, g = toxicity.ordinal_gradient(x, row, column, y, weight, 6)
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-6
        up, down = (toxicity.ordinal_gradient(x + s, row, column, y, weight, 6)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_graded_labels(spark):
    r = random.Random(12)
    vocabulary = [f"calm{i}" for i in range(200)]
    rows, grades = [], []
    for i in range(900):
        g = r.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join(r.choice(vocabulary) for _ in range(40)) + " rude" * (g >= 1) + " vile" * (g == 2)))
        grades.append((i, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(grades, "doc_id long, toxic int"), per_class=150, grades=3)
    found = {x.doc_id: x for x in toxicity.severity(docs, model).collect()}
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()
    assert np.mean([found[i].severity == g for i, g in grades]) > 0.97
    assert all(abs(found[i].expected_severity - g) < 0.7 for i, g in grades[:100])


CLASHES = ["n_words", "n_removed", "score", "predicted", "key", "kept", "row", "order", "factors", "c0", "fp", "of_key", "least_hash"]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """The same rows as without them, with nulls, repeated rows and empty texts; and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit(""))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3).cache()
    more = docs.withColumns({c: F.lit(None).cast("int") if i % 2 else F.lit(7) for i, c in enumerate(CLASHES)})
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, docs, SF), stage(spark, more, SF)
        same = lambda d: sorted(map(str, d.select(*plain.columns).drop("sequence_id", "offset").collect()))
        if name != "best_fit_packing":
            assert wide.columns == more.columns
        assert same(plain) == same(wide), name
        assert plain.count() > 50, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.limit(0), SF).collect() == [], name


def test_ordinal_regression_orders_grades():
    rows = [(np.array([0] * (g >= 1) + [1] * (g >= 2) + [2], int), g) for g in (0, 0, 0, 1, 1, 2, 2) for _ in range(20)]
    weights, thresholds = toxicity.fit_ordinal(rows, 3, 3)
    above = [1 / (1 + np.exp(-(weights[at].sum() - thresholds))) for at, _ in rows]
    assert (np.diff(thresholds) > 0).all() and all(round(a.sum()) == g for a, (_, g) in zip(above, rows, strict=True))


def test_attention_gradients():
    model, draw = quality.AttentionModel(), np.random.default_rng(1)
    x, sizes, y, w = draw.normal(size=(9, quality.WIDTH)), np.array([4, 1, 4]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    loss = lambda: -(w * np.where(y > 0, np.log(s := model.scores(x, sizes)), np.log(1 - s))).sum() / w.sum()
    for name, g in model._gradients(x, sizes, y, w).items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        model.p[name][at] += 1e-5


def test_contamination(spark):
    r = random.Random(7)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    words = [w for t in bench["text"] for w in t.split()]
    clean = [" ".join(r.sample(words, 150)) for _ in range(40)]
    rows, planted = [(i, t) for i, t in enumerate(clean)], set()
    for k, (item, text) in enumerate(bench.itertuples(index=False)):
        w = decontamination.words_of(text.encode())
        for _ in range(int(0.2 * len(w))):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 and len(w) > 1 else [f"zz{r.randrange(99)}"]
        rows.append((1000 + k, f"{r.choice(clean)} {' '.join(w)} {r.choice(clean)}"))
        planted.add((1000 + k, item))
    found = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs & planted) >= 0.95 * len(planted) and all(d >= 1000 for d, _ in pairs)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {(r[0], r[1]) for r in docs.join(spark.createDataFrame(bench).withColumnRenamed("text", "t"), F.expr("contains(text, t)")).select("doc_id", "item_id").collect()}
    assert whole <= {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, spark.createDataFrame(bench)).collect()}


def test_pipeline_stages(spark):
    """Each stage on its own input, against brute force where the stage is exact."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        before, after = docs.toPandas().set_index("doc_id"), out.toPandas()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and set(after["doc_id"]) <= set(before.index)
        same = before["text"].loc[after["doc_id"]].to_numpy() == after["text"].to_numpy() if "text" in after else None
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
            assert same.all() and set(labels.index[labels == 1]) <= set(after["doc_id"]) and len(set(labels.index[labels == 0]) & set(after["doc_id"])) <= 2
        elif name == "simhash_near_dedup":
            found = simhash.near_duplicates(docs).toPandas()
            assert same.all() and sorted(after["doc_id"]) == sorted(found["component"].unique())
        elif name == "substring_dedup":
            grams = lambda t: {tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)}
            seen = set()
            for i in before.sort_index().index:
                fresh = seen.isdisjoint(grams(before["text"][i]))
                row = after[after["doc_id"] == i]
                assert not fresh or (len(row) == 1 and row["text"].iloc[0] == before["text"][i])
                assert fresh or len(row) == 0 or len(row["text"].iloc[0].split()) < len(before["text"][i].split())
                seen |= grams(before["text"][i])
        elif name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]
            holds = before["text"].map(lambda t: any(b in t for b in bench))
            assert same.all() and set(before.index[~holds]) == set(after["doc_id"])
        else:
            assert set(after["doc_id"]) == set(before.index)
        docs = out


def test_covered_words():
    factor = np.zeros(1, substrings._FACTOR)
    factor["start"], factor["count"] = 2, 1
    assert substrings._covered(20, factor.tobytes(), 13).tolist() == [2 <= i < 15 for i in range(20)]
