"""Exact top-k against brute force, ties, repeated rows and odd vectors included."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelens.llm import exact_topk
from pagelens.llm.exact_topk import approximation, bounds, integer_vectors, read_order, report, top_k
from pagelens.llm.oracles import TOPK_SQL
from pagelens.session import materialize


def brute(rows, ask, k):
    """Every row is a candidate and, if asked for, a query of its own."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, asked) in enumerate(whole):
        if q in ask:
            scores = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(asked))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 520)]  # a hot vector: only ids decide
    rows += [(600, None), (700, [1.0, None] + [0.0] * 6), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (None, rows[0][1]), (1000, [0.5] * 3)]
    rows += [rows[1]] * 2 + [rows[100]] + [(200, rows[5][1])]  # a repeated candidate, a repeated query, one id with two vectors
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    got = sorted(tuple(r) for r in report(docs).collect())
    assert got == brute(rows, range(0, 1100, 100), 10)
    # The query's SQL says the same of repeated rows; it knows one dimension only.
    embeddings = pd.DataFrame([r for r in rows if r[0] is None or r[0] < 1000], columns=["vec_id", "embedding"])
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [
        (None if pd.isna(i) else int(i), v) for i, v in embeddings.itertuples(index=False)])
    assert sorted(con.execute(TOPK_SQL).fetchall()) == [r for r in got if r[0] < 1000]


def test_blocks_and_few(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert sorted(tuple(r) for r in top_k(v, "id % 10 = 0", 5).collect()) == brute(rows, range(0, 90, 10), 5)
    few = v.where("id < 3")
    assert sorted(tuple(r) for r in top_k(few, "true", 5).collect()) == brute(rows[:3], range(3), 5)
    assert top_k(v.limit(0), "true").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    exact = rng.integers(-10 ** 6, 10 ** 6, (500, 12))
    low, width = exact.min(axis=0).astype(float), np.full(12, 9000.0)
    codes = (exact - low) // width
    lower, upper = bounds(codes, low, width, exact[:40].astype(float))
    scores = exact[:40] @ exact.T
    assert (lower <= scores).all() and (scores <= upper).all()


def test_reads_few_exact_vectors(spark):
    """Of 4,000 vectors the bounds leave few to be read, though the blocks do not see each other."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 16)))]
    v = integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).withColumn("row", F.monotonically_increasing_id())
    file, grid = approximation(v)
    file = materialize(file, "file")
    order = read_order(file, materialize(file.where("id % 400 = 0"), "asked"), grid, 10)
    counts = {r["query"]: r["count"] for r in order.groupBy("query").count().collect()}
    assert len(counts) == 10 and max(counts.values()) < 400


@pytest.mark.parametrize("value", [1e30, 2.0 ** 40])
def test_beyond_a_long(spark, value):
    """A component, or a score, that no long holds is an error, not a wrapped number."""
    docs = spark.createDataFrame([(0, [value, 1.0]), (1, [value, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        report(docs).collect()
