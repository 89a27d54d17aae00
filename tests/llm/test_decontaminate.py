"""Spaced seeds against an exhaustive comparison of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pagelens.llm import decontaminate
from pagelens.llm.decontaminate import SeedTable, clean, overlaps, required, seed_masks, words_of


def brute(doc, item, window=13, least=1):
    d, b = words_of(doc), words_of(item)
    long = min(window, len(b)) if len(b) >= least else 0
    hit = set()
    for i in range(len(d) - long + 1 if long else 0):
        for j in range(len(b) - long + 1):
            if sum(d[i + p] == b[j + p] for p in range(long)) >= required(long):
                hit.add((i, j, long))
    return hit


def text(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def vary(rng, passage, share):
    return " ".join(f"z{rng.randrange(99)}" if rng.random() < share else w for w in passage.split())


@pytest.mark.parametrize("window", range(1, 14))
def test_no_window_is_missed(window):
    masks = seed_masks(window)
    allowed = window - required(window)
    rng = random.Random(window)
    for _ in range(300):
        wrong = set(rng.sample(range(window), allowed))
        assert any(not wrong & set(m) for m in masks)


def test_windows_match_brute_force():
    rng = random.Random(2)
    items = [text(rng, n, 12) for n in (15, 30, 13, 5, 1, 0)]
    docs = [text(rng, 60, 12) + " " + vary(rng, items[k % 4], 0.15) + " " + text(rng, 40, 12) for k in range(12)]
    table = SeedTable([words_of(i) for i in items])
    lists = [[table.number.get(w, 0) for w in words_of(d)] for d in docs]
    ends = np.cumsum([len(x) for x in lists])
    starts = ends - [len(x) for x in lists]
    a, b, long = table.windows(np.array(sum(lists, [])), starts, ends)
    first = [int(np.flatnonzero(table.item == k)[0]) if words_of(t) else 0 for k, t in enumerate(items)]
    got = {(int(np.searchsorted(ends, x, "right")), int(table.item[y]), int(x - starts[np.searchsorted(ends, x, "right")]), int(y - first[table.item[y]]), int(n)) for x, y, n in zip(a, b, long)}
    want = {(d, k, i, j, n) for d, t in enumerate(docs) for k, item in enumerate(items) for i, j, n in brute(t, item)}
    assert got == want and want


@pytest.fixture
def tables(spark):
    rng = random.Random(7)
    items = [(i, text(rng, 30 + i, 5000)) for i in range(6)] + [(7, None), (8, ""), (9, "short item here"), (10, "too short"), (None, text(rng, 20, 5000))]
    rows = []
    for i in range(60):
        body = text(rng, rng.randint(0, 300), 5000)
        if i % 5 == 0:
            body += ". " + vary(rng, items[i % 6][1], 0.08).upper() + ", " + text(rng, 20, 5000)
        rows.append((i, body, i % 6 if i % 5 == 0 else None, 1))
    rows += [(100, None, None, 1), (101, "", None, 1), (None, items[1][1], 1, 1), (0, rows[0][1], 0, 1), (102, "a short item here", 9, 1), (103, "too short", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, planted int, item_id int")
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), rows, items


def test_overlaps_and_clean(tables):
    docs, bench, rows, items = tables
    want = sorted(((r[0] if r[0] is not None else -1), i if i is not None else -1) for r in rows for i, t in items if t and r[1] and brute(r[1], t, least=3))
    got = sorted({(r.doc_id if r.doc_id is not None else -1, r.item_id if r.item_id is not None else -1) for r in overlaps(docs, bench).collect()})
    assert got == sorted(set(want))
    assert {(r[0] or -1 if r[0] != 0 else 0, r[2]) for r in rows if r[2] is not None} <= set(got)
    left = clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in rows if r[2] is None)
    assert clean(docs, bench.limit(0)).count() == len(rows) and overlaps(docs.limit(0), bench).count() == 0


def test_more_passes_give_the_same(tables, monkeypatch):
    docs, bench, _, _ = tables
    one = sorted(map(str, overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 60)
    assert sorted(map(str, overlaps(docs, bench).collect())) == one


def test_runs_where_the_package_is_not_installed(tmp_path):
    """Workers that cannot import the package: another working folder, no PYTHONPATH, the package loaded by path."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
    import os, sys
    sys.path.insert(0, {root!r})
    from pagelens.session import build_session
    from pagelens.llm.decontaminate import overlaps
    sys.path.remove({root!r})
    os.environ.pop("PYTHONPATH", None)
    spark = build_session("far", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"}})
    passage = " ".join(f"word{{i}}" for i in range(20))
    docs = spark.createDataFrame([(1, "x y " + passage), (2, "nothing")], "doc_id bigint, text string")
    found = overlaps(docs, spark.createDataFrame([(5, passage)], "item_id bigint, text string")).collect()
    print([tuple(r) for r in found])
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(1, 5, 2, 22, 20)]" in done.stdout, done.stderr[-2000:]
