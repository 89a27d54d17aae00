"""Many questions over all records: blocks of questions meet slices of records."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import CORPUS, QUESTIONS, brute, found, make

from pagelens.operators import search
from pagelens.operators.cells import Cells
from pagelens.operators.embedding import hashed_words
from pagelens.operators.grid import search_grid, shape, without_surplus_copies
from pagelens.operators.topk import NearestSoFar


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("copies", [0.0, 0.4])
def test_grid_is_exact(spark, monkeypatch, metric, copies):
    monkeypatch.setattr(search, "MANY_QUESTIONS", 10)
    corpus, questions = make(spark, copies=copies)
    df = spark.createDataFrame([*corpus, ("pdf_text", "none", None), ("pdf_text", "nan", [float("nan")] * 6)], CORPUS).repartition(3)
    asked = spark.createDataFrame([*questions, (900, None), (901, [float("inf")] * 6)], QUESTIONS)
    called = []
    monkeypatch.setattr(search, "search_grid", lambda *a: called.append(1) or search_grid(*a))
    assert found(search.nearest(df, asked, 5, metric)) == brute(corpus, questions, 5, metric) and called
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "LEFT_OUT", 1.1)  # no cells are taken to leave enough out
    assert found(search.nearest(df, asked, 5, metric)) == brute(corpus, questions, 5, metric) and len(called) == 2


def test_few_hits_leave_a_task(spark):
    """A question gives k hits for each collection and slice, not for each piece of the records."""
    corpus, questions = make(spark, n=600, questions=200)
    df, asked = spark.createDataFrame(corpus, CORPUS).repartition(20), spark.createDataFrame(questions, QUESTIONS)
    _, slices = shape(200, 600, 4, 6, spark.sparkContext.defaultParallelism)
    assert search_grid(df, asked, 4, "l2sq", 6).count() <= 200 * 3 * 4 * slices


@pytest.mark.parametrize("n", [1, 10_000, 100_000, 1_000_000, 30_000_000])
def test_blocks_are_bounded_and_hits_do_not_grow(n):
    blocks, slices = shape(n, n, 4, 64, 12)
    assert n / blocks * 8 * 64 <= 32 << 20 and slices <= 4
    assert shape(n, 10 * n, 4, 64, 12)[1] <= 48


def test_clustered_records_keep_their_cells(spark):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(20, 8)) * 10
    corpus = [("pdf_text", f"id{i:04d}", v.tolist()) for i, v in enumerate(np.concatenate([a + rng.normal(size=(60, 8)) * 0.1 for a in at]))]
    asked = spark.createDataFrame([(i, (at[i] + 0.1).tolist()) for i in range(20)], "qid bigint, qvec array<double>")
    cells = Cells.build(spark.createDataFrame(corpus, "collection string, id string, embedding array<double>"), "l2sq", 8, 60)
    assert cells.left_out(asked, 4) > 0.5
    loose, questions = make(spark)
    cells = Cells.build(spark.createDataFrame(loose, CORPUS), "l2sq", 6, 7)
    assert cells.left_out(spark.createDataFrame(questions, QUESTIONS), 4) < 0.5


def test_copies_are_thinned_before_they_are_sent(spark):
    rows = [("pdf_text", f"ID{i:04d}", [1.0, 0.0]) for i in range(500)] + [("pdf_text", None, [1.0, 0.0]), ("pdf_images", "x", [1.0, 0.0])]
    kept = without_surplus_copies(spark.createDataFrame(rows, CORPUS).repartition(4), 3)
    assert sorted(r.id for r in kept.collect()) == ["ID0000", "ID0001", "ID0002", "x"]


def test_the_embedder_runs_once_for_each_text(spark, monkeypatch):
    """However the search reads its records, their vectors are made once."""
    monkeypatch.setattr(search, "MANY_QUESTIONS", 10)
    corpus, questions = make(spark, n=90)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<float>", useArrow=False)
    def embed(v):
        made.add(1)
        return v

    df = spark.createDataFrame(corpus, CORPUS).select("collection", "id", embed.asNondeterministic()("embedding").alias("embedding"))
    assert found(search.nearest(df, spark.createDataFrame(questions, QUESTIONS))) == brute(corpus, questions, 4, "l2sq")
    assert made.value == 90


def test_hashed_words_equal_the_plain_count(spark):
    import hashlib

    texts = ["a b a", "", None, "  ", "Ünï a\tB\nb", "w " * 500, "\x0bq q"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", hashed_words()("t").alias("v")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        counts = np.zeros(64)
        for w in re.findall(r"[^ \t\r\n]+", (text or "").lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64] += 1
        length = np.sqrt((counts * counts).sum())
        assert row.v == (counts / length if length else counts).astype("float32").tolist()


def test_an_unusable_question_leaves_the_others_their_bound():
    """One vector without a distance must not keep its whole tile without a bound."""
    rng = np.random.default_rng(1)
    asked, records = rng.normal(size=(20, 6)), rng.normal(size=(4000, 6))
    asked[3] = np.nan
    best = NearestSoFar(asked, 4, "l2sq")
    best.add(np.arange(4000), records)
    assert np.isfinite(best.limit).all() and sorted(set(best.row)) == [i for i in range(20) if i != 3]
