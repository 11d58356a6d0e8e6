"""Language, quality and toxicity scores of short texts, features and all, by slow loops over single characters and words."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlstone.llm import language, quality, toxicity

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


@pytest.fixture(scope="module")
def texts():
    r = random.Random(12)
    words = "the cat Sat und Straße été niño 日本 x1 a-b café, stupid! | <b> 10.5 ## end. ÀÉ".split()
    made = [" ".join(r.choice(words) + r.choice(["", "", "\n", "  "]) for _ in range(r.randint(0, 130))) for _ in range(90)]
    return [None, "", " \n", "...", "123", "q", *made, made[3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def plain_grams(text):
    """Feature to 1 + log(count)."""
    folded = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    if not folded.strip():
        return {}
    spread = lambda h: (((h ^ (h >> 16)) * 0x27D4EB2F) & M32) >> (32 - language.FEATURE_BITS)
    one = [((ord(c) + 1) * 0x9E3779B1) & M32 for c in folded]
    two = [(((a ^ (a >> 15)) * 0x85EBCA77) + b) & M32 for a, b in zip(one, one[1:])]
    three = [(((a ^ (a >> 13)) * 0xC2B2AE3D) + c) & M32 for a, c in zip(two, one[2:])]
    return {f: 1 + math.log(n) for f, n in Counter(map(spread, one + two + three)).items()}


def test_language(spark, docs, texts):
    model = language.train(docs)
    labelled = [t for i, t in enumerate(texts) if i % 3 < 2 and t is not None]
    seen = Counter(f for t in labelled for f in plain_grams(t))
    idf = lambda f: math.log((1 + len(labelled)) / (1 + seen[f])) + 1
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert model.languages == ["de", "en"]
    for i, t in enumerate(texts):
        grams = plain_grams(t)
        if not grams:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        x = {f: tf * idf(f) for f, tf in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(v / norm * float(model.weights[f, k]) for f, v in x.items()) + float(model.bias[k])) / model.temperature for k in range(2)]
        p = [math.exp(z - max(logits)) for z in logits]
        best = max(range(2), key=lambda k: p[k])
        assert found[i].lang_pred == model.languages[best] and abs(found[i].score - p[best] / sum(p)) < 1e-5


def plain_passages(text):
    """Vectors of a text's passages."""
    kinds = quality._classes()
    cls = lambda c: int(kinds[ord(c)])
    spread = lambda h, n: (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & M64) >> 40) % n
    text = (text or "") + "\n"
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    out = []
    for at in range(0, max(len(words), 1), quality.PASSAGE):
        own, c, v = words[at : at + quality.PASSAGE], quality.CLASSES, np.zeros(quality.WIDTH)
        if own:
            n, n_chars = len(own), sum(b - a for a, b in own)
            hashes = []
            for a, b in own:
                h = 0
                for k, i in enumerate(range(a, b)):
                    h += (ord(text[i]) + 1) * pow(0x9E3779B97F4A7C15, (k & 63) + 1, 1 << 64)
                    v[cls(text[i]) * c + cls(text[i + 1])] += 1 / n_chars
                    if i + 1 < b:
                        three = ((ord(text[i]) * 0x9E3779B97F4A7C15 + ord(text[i + 1])) * 0x94D049BB133111EB + ord(text[i + 2])) & M64
                        v[10 * c + quality.WORDS + spread(three, quality.TRIPLES)] += 1 / n_chars
                v[c * c + cls(text[a])] += 1 / n
                v[c * c + c + cls(text[b - 1])] += 1 / n
                hashes.append(h & M64)
                v[10 * c + spread(h & M64, quality.WORDS)] += 1 / n
            sizes = [b - a for a, b in own]
            again = [sum(x == y for x, y in zip(hashes, hashes[k:])) / n for k in (1, 2)]
            v[-8:] = [len(set(hashes)) / n, max(Counter(hashes).values()) / n, *again, np.mean(sizes) / 10, np.std(sizes) / 10, n / quality.PASSAGE, math.log1p(len(words)) / 10]
        out.append(v)
    return out


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(6, 90)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    p, sigmoid = model.p, lambda z: 1 / (1 + math.exp(-z))
    for i, t in enumerate(texts):
        hidden, gates = [], []
        for v in plain_passages(t):
            x = np.clip((v - model.mean) / model.scale, -8, 8)
            h = [math.tanh(sum(x[j] * p["W"][j, k] for j in range(len(x))) + p["b"][k]) for k in range(len(p["b"]))]
            gates.append(sum(p["w"][g] * math.tanh(sum(a * p["V"][k, g] for k, a in enumerate(h))) * sigmoid(sum(a * p["U"][k, g] for k, a in enumerate(h))) for g in range(len(p["w"]))))
            hidden.append(h)
        weights = [math.exp(g) for g in gates]
        z = [sum(w * h[k] for w, h in zip(weights, hidden)) / sum(weights) for k in range(len(p["b"]))]
        score = sigmoid(sum(a * b for a, b in zip(z, p["c"])) + float(p["d"][0]))
        assert abs(found[i].score - score) < 1e-4 and found[i].predicted == int(found[i].score >= 0.3)


def test_toxicity(spark, docs, texts):
    def features(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return {xxhash.xxh64_intdigest(f.encode()) for w in words for f in [w] + [f"{w[:n]}*" for n in toxicity.STEMS if len(w) >= n]}

    marked = {i: int("stupid" in (t or "")) for i, t in enumerate(texts)}
    model = toxicity.train(docs, spark.createDataFrame(list(marked.items()), "doc_id long, toxic int"))
    coded, y = [features(t) for t in texts], list(marked.values())
    n1, n0, kept = sum(y), len(y) - sum(y), set()
    for f in set().union(*coded):
        in1, in0 = (sum(f in c for c, g in zip(coded, y) if g == k) for k in (1, 0))
        both = (in1 + in0) / len(y)
        if in1 + in0 >= 3 and (in1 / n1 - in0 / n0) / math.sqrt(max(both * (1 - both) * (1 / n1 + 1 / n0), 1e-12)) >= 4.0:
            kept.add(f)
    assert set(model.weights) <= kept and len(model.weights) > 0
    for r in toxicity.severity(docs, model).collect():
        expected = 1 / (1 + math.exp(-(sum(model.weights.get(f, 0.0) for f in coded[r.doc_id]) - float(model.thresholds[0]))))
        assert abs(r.expected_severity - expected) < 1e-9 and r.toxic == (expected >= 0.5) and r.severity == int(expected > 0.5)
