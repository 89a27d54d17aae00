"""Repeated lines against a plain count, the runs against plain sets."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF

from pagelens.llm.line_runs import LineRuns, line_keys, report, without_repeated_lines

STRIP = re.compile(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z")


def key_of(line):
    key = STRIP.sub("", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def brute(rows, least=5, points=40):
    holders = defaultdict(list)
    for row, (_, text) in enumerate(rows):
        for key in {key_of(x) for x in (text or "").split("\n")}:
            if len(key) >= points:
                holders[key].append(row)

    def order(i):
        return (i is not None, i or 0)

    top = {k: max((rows[r][0] for r in rs), key=order) for k, rs in holders.items() if len(rs) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in top or top[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    long = [f"Line number {i} " + "of the corpus, é " * (2 + i % 2) for i in range(30)]
    hot = "This line is found in a third of all documents, always."
    rows = []
    for i in rng.sample(range(-20, 3 * n), n):
        lines = [rng.choice(long) for _ in range(rng.randint(0, 3))] + ["short"] * rng.randint(0, 2)
        lines += [hot] if rng.random() < .33 else []
        lines += [f"only here {i} " * 8] * rng.randint(0, 2)
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\x0b\r", x + "\xa0", x + "\x1c"]) for x in lines]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(None, hot), (None, hot + "\n"), (7_000, None), (7_001, ""), (7_002, "\n\n")]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1])]  # repeated rows, and one id with two texts
    rows += [(8_000, "\n".join(f"{i} " * 30 for i in range(20_000)) + "\n" + hot)]
    return rows


def digests(rows):
    return sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, n, d, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_definition(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 3, 4, "h") for r in rows], "doc_id bigint, text string, n_dropped int, h1 int, mark string").repartition(3)
    got = report(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = brute(rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == digests(want)
    assert sum(d for _, _, d, _ in want) > 100
    clean = without_repeated_lines(docs)
    assert clean.columns == ["doc_id", "text", "h1", "mark", "n_lines", "n_dropped"]
    texts = [None if r[1] is None else w[3] for r, w in zip(rows, want, strict=True)]
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in clean.collect()) == Counter(
        (w[0], t, w[2]) for w, t in zip(want, texts, strict=True))


def test_few(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert report(empty).count() == 0 and without_repeated_lines(empty).count() == 0
    line = "x" * 40
    for n in (4, 5):
        rows = [(None, line)] * n
        assert sorted(repr(tuple(r)) for r in report(spark.createDataFrame(rows, empty.schema)).collect()) == digests(brute(rows))
    four = [(i, "é" * 39 + "\n" + line[:-1]) for i in range(9)]  # one code point short
    assert {r.n_dropped for r in report(spark.createDataFrame(four, empty.schema)).collect()} == {0}


def test_runs(spark, plan_of):
    """Batches in any order: the runs know what a plain count knows, stay few, and are not shuffled when a batch meets them."""
    rng = random.Random(5)
    runs = LineRuns(spark, least=3, buckets=4)
    seen = defaultdict(list)
    ids = rng.sample(range(900), 900)
    for b in range(7):
        rows = [(i, f"a line of the corpus that is long enough {min(int(rng.expovariate(.2)), 40)}") for i in ids[b * 100:b * 100 + 100]]
        for i, line in rows:
            seen[line].append(i)
        keys = line_keys(spark.createDataFrame(rows, "doc_id bigint, text string"))
        runs.add(keys)
        assert [name is not None for name in runs.levels] == [c == "1" for c in reversed(f"{b + 1:b}")]
    again = runs.fresh(keys.where("doc_id < 0"))
    plan = plan_of(again)
    assert plan.count("SortMergeJoin") == 3 and plan.count("LeftAnti") == 3
    assert plan.count("Exchange") == 1  # that of the batch itself
    assert sorted(r.top for r in runs.frequent().collect()) == sorted(max(v) for v in seen.values() if len(v) >= 3)
    assert len(runs.runs()) == 1
    assert "Exchange" not in plan_of(runs.frequent())
    runs.close()


def test_settled_keys_are_not_added(spark):
    runs = LineRuns(spark, least=2, buckets=2)
    table = "doc_id bigint, h1 bigint, h2 bigint"
    first = spark.createDataFrame([(9, i, 0) for i in range(3000)] + [(8, i, 0) for i in range(3000)], table)
    runs.add(first)
    lower = spark.createDataFrame([(d, i, 0) for d in (5, 6) for i in range(3000)] + [(10, 5, 0), (4, 9999, 0)], table)
    assert sorted((r.h1, r.top) for r in runs.fresh(lower).collect()) == [(5, 10), (9999, 4)]
    runs.close()


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in report(docs).collect()) == digests(brute(rows))
