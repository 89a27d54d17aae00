"""Search against brute force, on every path."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators.cells import Cells, StoredCells
from pagelens.operators.search import merge_collections, nearest, nearest_stored, retrieve, with_records

CORPUS = "collection string, id string, embedding array<float>"
QUESTIONS = "qid bigint, qvec array<float>"
PATHS = {"scan": {}, "cells": {"broadcast_bytes": 0, "pivots": 7, "group_bytes": 8 * 6 * 20}}


def make(spark, n=300, questions=40, dims=6, seed=0, copies=0.0):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)).astype("float32")
    vectors[rng.random(n) < copies] = vectors[0]
    rows = [(["pdf_text", "pdf_tables", "pdf_images"][i % 3], f"id{i:04d}", vectors[i].tolist()) for i in range(n)]
    asked = rng.normal(size=(questions, dims)).astype("float32")
    asked[0] = vectors[0]
    return rows, [(i, v.tolist()) for i, v in enumerate(asked)]


def score(metric, a, b):
    a, b = np.asarray(a, dtype="float64"), np.asarray(b, dtype="float64")
    if metric == "l2sq":
        return float(((a - b) ** 2).sum())
    if metric == "cosine":
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    return 1.0 - float((a * b).sum())


def brute(corpus, questions, k, metric):
    out = {}
    for qid, q in questions:
        for c in {r[0] for r in corpus}:
            ranked = sorted((round(score(metric, q, v), 9), i) for col, i, v in corpus if col == c)[:k]
            out.update({(qid, c, at + 1): hit for at, hit in enumerate(ranked)})
    return out


def found(hits):
    return {(r.qid, r.collection, r["rank"]): (round(r.score, 9), r.id) for r in hits.collect()}


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("copies", [0.0, 0.4])
def test_exact(spark, metric, path, copies):
    corpus, questions = make(spark, copies=copies)
    got = nearest(spark.createDataFrame(corpus, CORPUS).repartition(3), spark.createDataFrame(questions, QUESTIONS), 5, metric, **PATHS[path])
    assert found(got) == brute(corpus, questions, 5, metric)


@pytest.mark.parametrize("path", PATHS)
def test_copies_everywhere_are_settled_by_id(spark, path):
    corpus = [("pdf_text", f"id{i:04d}", [1.0, 0.0]) for i in range(500)]
    got = nearest(spark.createDataFrame(corpus, CORPUS).repartition(4), spark.createDataFrame([(1, [0.0, 0.0])], QUESTIONS), 3, **PATHS[path])
    assert [r.id for r in got.orderBy("rank").collect()] == ["id0000", "id0001", "id0002"]


@pytest.mark.parametrize("path", PATHS)
def test_unusable_vectors(spark, path):
    corpus = [("pdf_text", "a", [1.0, 0.0]), ("pdf_text", "b", None), ("pdf_text", "c", [float("nan"), 0.0])]
    questions = [(1, [1.0, 0.0]), (2, None)]
    got = nearest(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS), 3, **PATHS[path])
    assert [(r.qid, r.id) for r in got.collect()] == [(1, "a")]


def test_other_dimension_is_an_error(spark):
    corpus = spark.createDataFrame([("pdf_text", "a", [1.0, 0.0, 3.0])], CORPUS)
    with pytest.raises(Exception, match="2 elements"):
        nearest(corpus, spark.createDataFrame([(1, [1.0, 0.0])], QUESTIONS)).collect()


def test_no_questions_or_no_corpus(spark):
    corpus, questions = make(spark, n=9, questions=2)
    none = spark.createDataFrame([], QUESTIONS)
    assert retrieve(spark.createDataFrame(corpus, CORPUS), none).count() == 0
    for path in PATHS.values():
        assert nearest(spark.createDataFrame([], CORPUS), spark.createDataFrame(questions, QUESTIONS), **path).count() == 0


def test_merge_equals_global_order(spark):
    corpus, questions = make(spark)
    hits = retrieve(spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS), k_each=len(corpus), top_n=7)
    for qid, q in questions:
        want = sorted(round(score("l2sq", q, v), 9) for _, _, v in corpus)[:7]
        got = [round(r.score, 9) for r in hits.where(F.col("qid") == qid).orderBy("pos").collect()]
        if qid < 5:
            assert got == want


def test_merge_ties_keep_collection_order(spark):
    hits = spark.createDataFrame(
        [(1, "pdf_images", "i", 0.5, 1), (1, "pdf_text", "t", 0.5, 1), (1, "other", "o", 0.5, 1), (1, "pdf_tables", "b", 0.4, 1)],
        "qid int, collection string, id string, score double, rank int")
    assert [r.id for r in merge_collections(hits, 4).orderBy("pos").collect()] == ["b", "t", "i", "o"]


def test_default_k_and_collections(spark):
    corpus, questions = make(spark)
    df, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS)
    assert nearest(df, asked, 0).count() == nearest(df, asked, None).count() == 40 * 3 * 4
    only = retrieve(df, asked, collections=("pdf_tables",))
    assert {r.collection for r in only.select("collection").distinct().collect()} == {"pdf_tables"}


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_recall_is_kept(spark, metric):
    """Probes found on a sample hold the asked share of all neighbours, without visiting every cell."""
    corpus, questions = make(spark, n=3000, questions=400)
    df, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS)
    exact = {(q, c, i) for (q, c, _), (_, i) in found(nearest(df, asked, metric=metric)).items()}
    near = {(q, c, i) for (q, c, _), (_, i) in found(nearest(df, asked, metric=metric, recall=0.95, pivots=32)).items()}
    assert len(exact & near) / len(exact) >= 0.9
    cells = Cells.build(df, metric, 6, 32)
    assert 1 <= cells.probes_for(asked, 4, 0.95) < 32
    assert cells.probes_for(asked, 4, 0.5) <= cells.probes_for(asked, 4, 0.95) <= cells.probes_for(asked, 4, 1.0)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    """The registered approximate search against brute force on the shared tables, with its registered parameters."""
    from pagelens.catalog import roles

    folder = f"/root/testdata/{sf}"
    near = {(r.qid, r.collection, r.id) for r in roles_hits(spark, folder).collect()}
    records = roles.records(spark, folder).select("collection", "id", "embedding").toPandas()
    asked = roles.vector_questions(spark, folder).toPandas()
    q = np.array(asked["qvec"].tolist(), dtype="float64")
    true = set()
    for collection, held in records.groupby("collection"):
        v = np.array(held["embedding"].tolist(), dtype="float64")
        scores = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T
        first = np.argsort(scores, axis=1, kind="stable")[:, :4]
        true |= {(qid, collection, held["id"].iloc[i]) for qid, row in zip(asked["qid"], first, strict=True) for i in row}
    assert len(near & true) / len(true) >= 0.9


def roles_hits(spark, folder):
    from pagelens.catalog.retrieval import probed_hits

    return probed_hits(spark, folder)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_few_cells_are_visited(spark, metric):
    """Clustered records: the triangle inequality leaves most cells out, for inner products as well."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(20, 8)) * 10
    vectors = np.concatenate([a + rng.normal(size=(60, 8)) * 0.1 for a in at])
    corpus = [("pdf_text", f"id{i:04d}", v.tolist()) for i, v in enumerate(vectors)]
    questions = [(i, (at[i] + rng.normal(size=8) * 0.1).tolist()) for i in range(20)]
    df = spark.createDataFrame(corpus, "collection string, id string, embedding array<double>")
    asked = spark.createDataFrame(questions, "qid bigint, qvec array<double>")
    cells = Cells.build(df, metric, 8, 60)
    visits = cells.visits(asked, 5).count()
    assert visits < 0.5 * len(questions) * len(cells.stats)
    assert found(nearest(df, asked, 5, metric, broadcast_bytes=0, pivots=60)) == brute(corpus, questions, 5, metric)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_stored_cells(spark, tmp_path, metric, plan_of):
    corpus, questions = make(spark, n=600, copies=0.2)
    longest = max(range(600), key=lambda i: np.linalg.norm(corpus[i][2]))
    corpus[0], corpus[longest] = (corpus[0][0], corpus[0][1], corpus[longest][2]), (corpus[longest][0], corpus[longest][1], corpus[0][2])
    df = spark.createDataFrame(corpus, CORPUS).where("embedding is not null")
    asked = spark.createDataFrame(questions, QUESTIONS)
    stored = StoredCells(spark, str(tmp_path / "cells"))
    stored.create(spark.createDataFrame(corpus[:400], CORPUS), metric, pivots=12, batch="a")
    stored.append(spark.createDataFrame(corpus[400:], CORPUS), "b")
    stored.append(spark.createDataFrame(corpus[400:], CORPUS), "b")  # a repeated batch replaces itself
    stored.append(spark.createDataFrame([], CORPUS), "c")
    hits = nearest_stored(stored.load(), asked, 5)
    assert found(hits) == brute(corpus, questions, 5, metric) == found(nearest(df, asked, 5, metric))
    assert "dynamicpruning" in plan_of(hits)
    # Records of a batch whose counts were never written are not seen.
    import shutil

    shutil.rmtree(tmp_path / "cells" / "counts" / "batch=b")
    assert found(nearest_stored(stored.load(), asked, 5)) == brute(corpus[:400], questions, 5, metric)
    if metric == "ip":
        with pytest.raises(Exception, match="longer than the longest"):
            stored.append(spark.createDataFrame([("pdf_text", "x", [100.0] * 6)], CORPUS), "d")


def test_plan(spark, plan_of):
    corpus, questions = make(spark)
    df, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS)
    hits = retrieve(df, asked)
    plan = plan_of(hits)
    assert plan.count("WindowGroupLimit") >= 2 and "NestedLoop" not in plan and "Cartesian" not in plan
    texts = df.withColumn("text", F.col("id"))
    assert "BroadcastHashJoin" in plan_of(with_records(hits, texts, "text"))
    by_cells = plan_of(retrieve(df, asked, broadcast_bytes=0, pivots=4))
    assert "NestedLoop" not in by_cells and "Cartesian" not in by_cells


def test_blocks_are_dealt_per_cell(spark):
    """Slices and blocks are dealt per cell: the plan joins both sides with the counted visits of their cell."""
    rng = np.random.default_rng(8)
    rows = [("pdf_text", f"{name}{i}", (rng.normal(size=6) * 0.01 + at).tolist()) for name, at in (("far", 50), ("near", 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "collection string, id string, embedding array<double>")
    asked = spark.createDataFrame([(i, (rng.normal(size=6) * 0.01).tolist()) for i in range(200)], "qid bigint, qvec array<double>")
    hits = nearest(df, asked, broadcast_bytes=0, pivots=8, group_bytes=8 * 6 * 50)
    assert all(r.id.startswith("near") for r in hits.collect())
    grouped = hits._jdf.queryExecution().analyzed().toString()
    assert "blocks" in grouped and "Join Inner" in grouped


def test_a_question_is_sent_once_for_each_slice(spark, plan_of):
    """However many cells a question visits, what is sent does not hold it once for each of them."""
    corpus, questions = make(spark, n=900, questions=600)
    df, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(questions, QUESTIONS)
    cells = Cells.build(df, "l2sq", 6, 64)
    blocks, slice_rows = cells._grid(600, 4)
    dealt = asked.withColumn("block", F.pmod("qid", F.lit(blocks)).cast("int"))
    visits = cells._block_visits(dealt, 4, None)
    assert visits.count() <= blocks * len(cells.stats) < cells.visits(asked, 4).count() / 4
    assert blocks * -(-900 // slice_rows) <= 4 * 8 * 4
    assert found(cells_hits(cells, asked)) == brute(corpus, questions, 4, "l2sq")


def cells_hits(cells, asked):
    return nearest_stored(cells, asked, group_bytes=1)


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-3, 50.0), (1e18, 0.0), (1e-20, 0.0)])
def test_running_hits_on_any_scale(metric, scale, shift):
    """Screening in single precision loses nothing, whatever the lengths, and only reached questions change."""
    from pagelens.operators.topk import NearestSoFar

    rng = np.random.default_rng(5)
    records, asked = (rng.normal(size=(n, 6)) * scale + shift for n in (3000, 50))
    ids = np.array([f"i{i}" for i in rng.permutation(3000)])
    best = NearestSoFar(asked, 4, metric, 128)
    for a in range(0, 3000, 700):
        best.add(ids[a:a + 700], records[a:a + 700])
    assert np.array_equal(best.row, np.repeat(np.arange(50), 4))
    from pagelens.operators.topk import _pair_scores, unit

    q, v = (unit(asked), unit(records)) if metric == "cosine" else (asked, records)
    for i in range(50):
        scores = _pair_scores(np.repeat(q[i:i + 1], 3000, axis=0), v, metric)
        first = np.lexsort((ids, scores))[:4]
        assert best.id[best.row == i].tolist() == ids[first].tolist()
        assert np.array_equal(best.score[best.row == i], scores[first])


def test_probed_rows_are_hits(spark):
    """The registered approximate search gives its hits, not a summary of them."""
    from pagelens.catalog import QUERIES

    rows = QUERIES["knn_probed"](spark, "/root/testdata/sf0.01").collect()
    asked = {r.qid for r in rows}
    assert len(rows) == 4 * 3 * len(asked) and sum(r.true_rank is not None for r in rows) >= 0.9 * len(rows)
    assert all(r.recall_ok and not r.n_wrong_score for r in rows)
