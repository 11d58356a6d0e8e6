"""Texts of megabytes without white space: linear time, bounded memory, the same results."""

import random
import resource
import time

import public_tokenizers
import pytest

from marlstone.llm import quality, tokens

LONG = {
    "no gap": "aZ9é#日".encode() * 600_000,
    "a blob at the end": b"w1 x2 " * 20_000 + b"q7-" * 700_000,
    "a blob inside": b"some words here " * 50_000 + b"X" * 1_500_000 + b"\t tail more " * 3_000,
    "gaps": b" \n" * 1_200_000,
    "gaps first": b"  " * 1_200_000 + b"a b c",
    "whole passages": b"word " * 48 * 9_000,
}


@pytest.mark.parametrize("name", LONG)
def test_quality_of_long_texts(name):
    raw, model = LONG[name], quality.AttentionModel()
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    found = model.score_in_pieces(raw)
    assert time.process_time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert b"".join(quality._pieces(raw)) == raw
    assert abs(found - model.scores(*quality.encode_passages([raw.decode()]))[0]) < 1e-6


def test_long_passages_are_encoded_alike(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(quality, "ENCODE_BYTES", 7)
    for _ in range(150):
        raw = "".join(r.choice("ab cA9#é日\n\t,") for _ in range(r.randint(0, 60))).encode()
        x, sizes = quality.encode_passages([raw.decode()])
        if len(sizes) == 1 and sizes[0] == 1:
            assert abs(quality.encode_long_passage(raw, len(raw.split())) - x[0]).max() < 1e-5, raw


def test_quality_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "x" * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    of = lambda found: {round(x.score, 9) for x in quality.score(docs, found).collect()}
    assert of(quality.train(docs, labels)) == {round(3 / 5, 9)}
    assert of(quality.train(docs, labels.limit(0))) == {0.5}


def test_tokens_of_long_strings():
    import sentencepiece

    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(1)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    cases = ["".join(r.choice(a) for _ in range(r.randint(200, 2_000))) for a in ("ab", "aeinst", "defaultcurn", "=-_*", "éèaê日", "x") for _ in range(40)]
    cases += [w * 3_000 for w in ("default", "current", "日本語", "=-")]
    assert tokens.count_tokens(path, cases) == list(map(len, library.encode(cases, num_threads=1)))
    for word in ("default", "current"):
        text, began = word * (1_000_000 // len(word)), time.process_time()
        found = tokens.count_tokens(path, [text])
        assert time.process_time() - began < 5 and found == [len(library.encode(text))]
