"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelens.llm import simhash
from pagelens.llm.components import components
from pagelens.llm.simhash import fingerprint, links, near_duplicates, one_of_each, report


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


TEXTS = [None, "", " \n\t", "One", "one two THREE four", "a b c d e", "Ä ä É x y z\x0bq\x0c\x1c w\x85v", "the same line " * 50, "w" * 10_000]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_fingerprint(i):
    assert fingerprint(TEXTS[i]) == plain(TEXTS[i])


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three four")).alias("h")).first()
    assert row.h % 2 ** 64 == plain("one two three four")


def groups(fps, limit=4):
    fps = np.array(fps, np.uint64)
    name = list(range(len(fps)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= limit) + i + 1:
            a, b = root(i), root(int(j))
            name[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("zeros,cell", [(1, 2048), (2, 2048), (2, 40), (3, 5)])
def test_links_connect_like_brute_force(spark, monkeypatch, zeros, cell):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    rng = random.Random(zeros)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in list(fps)[:20]:
        for _ in range(rng.randint(1, 40)):
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    points = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    edges = links(points, zeros=zeros).collect()
    number = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    assert all(bin(fps[number[a]] ^ fps[number[b]]).count("1") <= 4 for a, b in edges)
    want = groups(fps)
    name = list(range(len(fps)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in edges:
        x, y = root(number[a]), root(number[b])
        name[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == want


def test_a_dense_group_gives_few_edges(spark):
    dense = spark.createDataFrame([(int(sum(1 << b for b in (i, j))),) for i in range(60) for j in range(i)], "fp bigint")
    n = dense.count()
    pairs = sum(1 for x in dense.collect() for y in dense.collect() if bin(x.fp ^ y.fp).count('1') <= 4) // 2
    assert links(dense).count() < pairs / 4


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(200, 201), (201, 202), (300, 300)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(40)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_report_and_one_of_each(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(300)) for _ in range(5)]
    texts = base + [base[0], base[0] + " tail", base[1].upper(), None, "", " "]
    rows = [(10 + i, t, "f") for i, t in enumerate(texts)] + [(None, base[2], "g"), (10, base[0], "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    fps = [plain(t) for _, t, _ in rows]
    name = groups(fps)
    ids = [[r[0] for r, n in zip(rows, name) if n == g and r[0] is not None] for g in name]
    want = sorted((r[0] or -1, f"{f:016x}", min(i)) for r, f, i in zip(rows, fps, ids))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in report(docs).collect()) == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(i) for i in ids})
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_repeated_id_with_other_text_stays(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "one two three four five six"), (None, "x y z"), (None, "x y z")], "doc_id bigint, text string")
    assert one_of_each(docs).count() == 3


def test_embedding_is_a_lower_bound():
    """Differing bits of two points are the Manhattan distance of their segments' popcounts, never more than the Hamming distance."""
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 2 ** 64, 400, np.uint64)
    fps[200:] = fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64))
    counts = np.stack([np.bitwise_count((fps >> np.uint64(s)) & np.uint64(3)) for s in range(0, 64, 2)], axis=1).astype(int)
    points = simhash.embedded(fps)
    a, b = np.triu_indices(400, 1)
    manhattan = np.abs(counts[a] - counts[b]).sum(axis=1)
    hamming = np.bitwise_count(fps[a] ^ fps[b])
    assert (np.bitwise_count(points[a] ^ points[b]) == manhattan).all() and (manhattan <= hamming).all()
    assert (simhash._near(points, fps, a, b, 4) == (hamming <= 4)).all()
    # The bound leaves few pairs to the exact test.
    assert (manhattan <= 4).sum() < 0.01 * len(a)
