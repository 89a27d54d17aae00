"""The trie of prefixes against one built by definition."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF

from pagelens.llm import prefix_trie
from pagelens.llm.prefix_trie import RangeMinimum, common_prefixes, report

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, mark, (role, text)))
    convs = {c: [t[-1] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}
    members, ending = defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ending[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(repr((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ending[p]))).encode()).hexdigest())) for p, m in members.items())


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(repr(tuple(r)) for r in df.collect())


def made(seed, n, alphabet, longest, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        kind = rng.random()
        if kind < .35:  # a third are copies of one conversation
            turns = [("user", "hello"), ("assistant", "héllo")] * 3
        elif deep and kind < .4:
            turns = [("user", f"d{i}") for i in range(deep - rng.randint(0, 3))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(alphabet)) for _ in range(rng.randint(1, longest))]
        rows += [(c, None if rng.random() < .05 else i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block,parts", [(65_536, 1), (65_536, 7), (1, 3), (5, 2)])
def test_matches_definition(spark, monkeypatch, block, parts):
    rows = made(block + parts, 160, ["a", "b", "", None, "ä"], 12, deep=60)
    rows += [(None, 0, "user", "x"), rows[3], rows[3], (10_000, None, None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, key string")
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(block, 2048)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(report(table)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_few(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert report(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(0, 0, "user", "a")], [(3, 0, None, None)], [(1, 0, "u", "a"), (2, 0, "u", "a")], [(4, None, "u", "x" * 200_000)]):
        assert rows_of(report(spark.createDataFrame(rows, schema))) == brute(rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(report(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_range_minimum():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 5, n)
        table = RangeMinimum(values)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        i, j = map(np.array, zip(*pairs, strict=True))
        assert table.between(i, j).tolist() == [values[a:b].min() for a, b in pairs]
        for least in range(6):
            for row in range(n):
                right = row + 1
                while right < n and values[right] >= least:
                    right += 1
                left = row
                while left >= 0 and values[left] >= least:
                    left -= 1
                one, bound = np.array([row]), np.array([least])
                assert table.right(one, bound)[0] == right
                assert table.left(one, bound)[0] == left


def test_common_prefixes():
    paths = [[], [], [1], [1, 2, 3], [1, 2, 3], [1, 2, 4, 5], [2]]
    turns = np.array([[x, x] for p in paths for x in p], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    assert common_prefixes(turns, starts).tolist() == [-1, 0, 0, 1, 3, 2, 0]
