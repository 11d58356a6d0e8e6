"""Near-duplicate values against the plain loop."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from marlstone.functions.text import fold_value
from marlstone.operators import near_values
from marlstone.operators.near_values import collapse_near_duplicates


def plain(rows, ratio=0.92):
    out = set()
    for g in {g for g, v in rows}:
        kept = []
        for v in sorted({v for k, v in rows if k == g and v is not None}, key=lambda v: (-len(v), v)):
            if not any(SequenceMatcher(None, fold_value(v), fold_value(k)).ratio() >= ratio for k in kept):
                kept.append(v)
        out |= {(g, v) for v in kept}
    return out


def edited(r, text, most):
    text = list(text)
    for _ in range(r.randint(0, most)):
        at = r.randint(0, len(text))
        text[at:at] = [r.choice("abc é")] if r.random() < 0.5 else []
        if text and r.random() < 0.5:
            del text[r.randrange(len(text))]
    return "".join(text)


def random_rows(seed, groups=6, each=60):
    r, rows = random.Random(seed), []
    words = "the smallest yet functional version of a product İstanbul straße 10,000 – “final” x".split()
    for g in [None, *map(str, range(groups))]:
        seeds = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(each // 6)] + ["a" * n for n in range(0, 40, 3)] + ["ab" * 20]
        rows += [(g, edited(r, r.choice(seeds), 5)) for _ in range(each)] + [(g, None), (g, ""), (g, "A")]
        rows += [(g, "".join(r.choice("ab ") for _ in range(r.randint(100, 260)))) for _ in range(2)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed, ratio", [(1, 0.92), (3, 0.8)])
def test_random_groups_by_the_plain_loop(spark, seed, ratio):
    rows = random_rows(seed)
    found = collapse_near_duplicates(spark.createDataFrame(rows, "group string, value string").repartition(4), ratio)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows, ratio), key=str)


def test_crowded_keys_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_values, "CELL", 7)
    monkeypatch.setattr(near_values, "LOCAL_LINKS", 3)
    monkeypatch.setattr(near_values, "WAVE", 60)
    rows = random_rows(9, groups=1, each=80)
    found = collapse_near_duplicates(spark.createDataFrame(rows, "group string, value string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(rows), key=str)
    assert collapse_near_duplicates(spark.createDataFrame(rows[:0], "group string, value string")).collect() == []


def test_index_keeps_every_near_pair():
    r = random.Random(5)
    for ratio in (0.8, 0.92):
        values = sorted({fold_value(v) for _, v in random_rows(6, 0, 150) if v})
        owner, run = near_values.index_keys(values, ratio, np.array([r.randint(0, 9) for _ in range(near_values.BUCKETS)]))
        keys = [set() for _ in values]
        for o, k in zip(owner.tolist(), run.tolist(), strict=True):
            keys[o].add(k)
        near = [(i, j) for i in range(len(values)) for j in range(len(values)) if i != j and SequenceMatcher(None, values[i], values[j]).ratio() >= ratio]
        assert len(near) > 50 and all(keys[i] & keys[j] for i, j in near)
