"""Whitening against numpy's eigenvectors and exact whole numbers."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from pagelens.llm import whitening
from pagelens.llm.whitening import one_sided_jacobi, pivoted_cholesky, principal, report

SCHEMA = "vec_id bigint, embedding array<float>, n int, size int, component int"


def exact(rows):
    """Whole-number vectors and their covariance by definition, in fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    means = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    centred = [[r[i] - means[i] for i in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    return x, means, v


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 12)) * np.logspace(0, -5, 12)
    v = a.T @ a / 40
    order, low = pivoted_cholesky(v)
    assert np.allclose(np.triu(low, 1).astype(float), 0) and np.allclose((low @ low.T).astype(float), v[np.ix_(order, order)], rtol=1e-12)
    pivots = np.diagonal(low)
    assert (pivots[:-1] >= pivots[1:]).all()
    turned = one_sided_jacobi(low)
    gram = (turned.T @ turned).astype(float)
    assert np.abs(gram - np.diag(np.diagonal(gram))).max() < 1e-15 * gram.max()
    vectors, values = principal(v, 12)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-14 * values[0]


def test_rank():
    a = np.array([[1.0, 2, 3], [2, 4, 6], [3, 6, 9]])
    vectors, values = principal(a)
    assert vectors.shape == (3, 1) and values == pytest.approx([14.0])
    assert principal(np.zeros((3, 3)))[0].shape == (3, 0)


def test_matches_definition(spark):
    rng = random.Random(7)
    rows = [[rng.gauss(0, 1) * (i + 1) for i in range(6)] for _ in range(300)]
    rows += [rows[0]] * 150  # a third are copies
    other = [[rng.gauss(5, 1), rng.gauss(0, 1)] for _ in range(20)]
    extra = [None, [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("inf")] + [0.0] * 5, []]
    ids = [None, *range(1, 450)]
    table = spark.createDataFrame(
        [(i, r, 1, 2, 3) for i, r in zip(ids, rows, strict=True)] + [(1000 + i, r, 1, 2, 3) for i, r in enumerate(other)]
        + [(2000 + i, r, 1, 2, 3) for i, r in enumerate(extra)], SCHEMA).repartition(5)
    got = defaultdict(dict)
    for r in report(table).collect():
        got[r.vec_id][r.component] = r
        assert 0 <= r.identity_error < 1e-9
    assert set(got) == {*ids, *range(1000, 1020)}
    for group, keys in ((rows, ids), (other, range(1000, 1020))):
        x, means, v = exact(group)
        n, values = len(group), np.linalg.eigvalsh(v)[::-1]
        signs = None
        _, vectors = np.linalg.eigh(v)
        vectors = vectors[:, ::-1]
        for key, row in zip(keys, x, strict=True):
            mine = got[key]
            assert sorted(mine) == list(range(1, len(values) + 1))
            assert {r.n for r in mine.values()} == {n}
            assert {r.deviation for r in mine.values()} == {int(sum((n * (a - m)) ** 2 for a, m in zip(row, means, strict=True)))}
            want = np.array([float(a - m) for a, m in zip(row, means, strict=True)]) @ vectors / np.sqrt(values)
            have = np.array([mine[k].whitened for k in sorted(mine)])
            signs = np.sign(want * have) if signs is None else signs  # one sign for all rows
            assert np.allclose(have, want * signs, atol=1e-9)
            assert np.allclose([mine[k].explained for k in sorted(mine)], values / np.trace(v), rtol=1e-10)


def test_nothing_to_whiten(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, 1, 1)], SCHEMA)
    assert report(one).count() == 0 and report(one.unionAll(one)).count() == 0
    assert report(one.limit(0)).count() == 0
    assert report(one).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Sums beyond a long stay exact; a deviation that no long holds is an error, as is an entry."""
    wide = spark.createDataFrame([(i, [float(2 ** 40 * i), float(i % 3)], 1, 1, 1) for i in range(4)], SCHEMA)
    models = whitening.fit(wide)
    x, means, v = exact([r.embedding for r in wide.collect()])
    assert np.allclose(models[2].values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
    with pytest.raises(Exception, match="beyond a long"):
        report(wide).collect()
    with pytest.raises(Exception, match="beyond a long"):
        report(spark.createDataFrame([(1, [1e30], 1, 1, 1), (2, [0.0], 1, 1, 1)], SCHEMA)).collect()
