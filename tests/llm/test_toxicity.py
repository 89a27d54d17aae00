"""Held-out accuracy, the noisy-or, and the place of offending sentences."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from pagelens.llm.toxicity import features, fit, keep_clean, report, score, sentences


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [a + b for a in ("ba", "ko", "mi", "tu", "re", "so") for b in ("n", "lo", "rik", "sta")]
    docs, labels = [], []
    for i in range(900):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 8))]
        bad = i % 5 == 0
        if bad:
            parts[rng.randrange(len(parts))] += rng.choice([" you idiot", " Grobling", " groblest"])
        docs.append((i, ". ".join(parts), "x", 0.5))
        labels.append((i, 1, int(bad)))
    docs += [(2000, None, "x", 0.1), (2001, "", "x", 0.1), (None, "idiot", "x", 0.1), (5, docs[5][1], "x", 0.5)]
    labels += [(2000, 1, None), (None, 1, 1), (5, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), docs)


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = report(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.95
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert next(r for r in got if r.doc_id == 2000).predicted == 0
    for r in got:  # the offending sentence is the one with the word
        if r.doc_id is not None and r.doc_id < 900 and r.predicted and r.doc_id % 5 == 0:
            text = rows[r.doc_id][1]
            start, end = map(int, r.offending.split(",")[0].split(":"))
            assert "idiot" in text[start:end] or "grob" in text[start:end].lower()
            assert "." not in text[start:end]


def test_clean_documents_stay(corpus):
    docs, labels, rows = corpus
    left = keep_clean(docs, labels)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sum(i is not None and i < 900 and i % 5 != 0 for i in ids) >= 0.99 * 720
    assert sum(i is not None and i < 900 and i % 5 == 0 and i != 5 for i in ids) < 12
    assert keep_clean(docs.limit(0), labels).count() == 0


def test_noisy_or(spark):
    weights, bias = {"bad": 3.0, "word*": 2.0, "good": -1.0}, -2.0
    docs = spark.createDataFrame([(1, "bad words. good"), (2, None), (3, "  . ")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in score(docs, (weights, bias)).collect()}

    def p(x):
        return 1 / (1 + math.exp(-x))

    assert got[1].score == pytest.approx(1 - (1 - p(3.0)) * (1 - p(-3.0)))
    assert got[2].score == got[3].score == pytest.approx(p(-2.0))
    assert [(s.start, s.end) for s in got[1].offending] == [(0, 9)]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b. c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert report(docs, labels).first().predicted == 0


def test_sentences_keep_positions():
    for text in ("Aİ b. C!d\ne", "", "…x?", "ab"):
        assert len("\n".join(sentences(text))) == len(text)
    assert features(["toxically", "abc"]) == {"toxically", "abc", "toxi*", "toxic*", "toxica*"}
    none = np.empty(0, np.int64)
    assert fit(none, none, none, none, []) == ({}, pytest.approx(np.log(-np.log1p(-1e-3)), abs=1e-2))
