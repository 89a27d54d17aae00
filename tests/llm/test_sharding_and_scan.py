"""Sharding laws and the separator scan's exact round trip."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import token_scan
from pagelens.llm.sharding import communication_matrix, report, shard
from pagelens.llm.token_scan import document_lengths, read_files, token_counts


def test_matrix_is_exact_and_uniform():
    m = communication_matrix([100, 0, 57, 1], 7, 5)
    assert m.sum(axis=1).tolist() == [100, 0, 57, 1] and set(m.sum(axis=0)) == {22, 23}
    # Over many draws a cell has the hypergeometric mean and variance.
    cells = np.array([communication_matrix([30, 70], 4, seed)[0, 0] for seed in range(3000)])
    assert abs(cells.mean() - 7.5) < 0.15
    assert abs(cells.var() - 30 * 0.25 * 0.75 * 70 / 99) < 0.4


def test_report(spark, monkeypatch):
    monkeypatch.setattr("pagelens.llm.sharding.PART_ROWS", 64)
    texts = [None, "", "é😀"] + ["same"] * 400 + [f"t{i}" for i in range(630)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "n", None), (5, "same", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(3)
    got = report(docs).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size()
    assert set(sizes.index) == set(range(40)) and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in got.dropna(subset="doc_id").itertuples():
        data = (texts[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert (got.law == "rows").all() and got.grown_shard.isna().all()
    # Neighbours of the input are spread.
    assert got[got.doc_id.between(3, 402)].groupby("shard").size().between(1, 30).all()
    assert report(docs.limit(0)).count() == 0
    few = report(docs.where("doc_id < 7")).toPandas()
    assert few.slot.tolist() == [0] * len(few)


def test_shard_keeps_columns(spark):
    rows = spark.range(100).selectExpr("id", "id as _n", "struct(id) as payload")
    got = shard(rows, 7, 3)
    assert got.columns == ["id", "_n", "payload", "shard", "slot"]
    assert sorted(r.id for r in got.collect()) == list(range(100))


END = 9


def brute(ids):
    out, n = [], 0
    for x in ids:
        if x == END:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_scan_matches_plain_count(spark, monkeypatch, stretch):
    monkeypatch.setattr(token_scan, "STRETCH_BLOCKS", stretch)
    rng = random.Random(stretch)
    streams = {s: [END if rng.random() < p else 1 for _ in range(n)] for s, (n, p) in enumerate(
        [(500, 0.05), (500, 0.5), (300, 0.0), (0, 0.5), (64, 1.0), (1, 1.0), (1, 0.0), (997, 0.003)])}
    streams[20] = [1] * 100 + [END]
    streams[21] = [END] + [1] * 100
    blocks = []
    for s, ids in streams.items():
        size = rng.choice([1, 7, 32])
        for k in range(0, len(ids), size):
            blocks.append((s, k // size, bytearray(np.array(ids[k:k + size], "<u2").tobytes()), "x"))
    rng.shuffle(blocks)
    got = document_lengths(spark.createDataFrame(blocks, "stream int, block bigint, tokens binary, nth string"), END).collect()
    want = sorted((s, i, n, e) for s, ids in streams.items() for i, (n, e) in enumerate(brute(ids)))
    assert sorted(map(tuple, got)) == want


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for k in range(3):
        ids = np.where(rng.random(5000) < 0.01, END, 4).astype("<u4")
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        want[k] = brute(ids.tolist())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = document_lengths(read_files(spark, str(tmp_path), 4 * 77, "<u4"), END, "<u4").collect()
    for k, docs in want.items():
        mine = sorted((r.nth, r.n_tokens, r.ended) for r in got if r.stream.endswith(f"/{k}.bin"))
        assert mine == [(i, n, e) for i, (n, e) in enumerate(docs)]
    assert len(got) == sum(map(len, want.values()))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_scan, "BLOCK_TOKENS", 50)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    texts = [None, "", "a b", "long words here " * 300, "<|endoftext|> é", "a b"]
    rows = [(i, x, 1) for i, x in enumerate(texts)] + [(None, "a b c", 1), (2, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens int").repartition(2)
    got = token_counts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b c" if r.doc_id is None else texts[r.doc_id]
        assert r.n_tokens == len(t.encode(text or "", add_special_tokens=False).ids)
    assert token_counts(docs.limit(0)).count() == 0


def test_one_file_in_many_ranges(spark, tmp_path):
    """A file cut into ranges of any length, over many tasks, gives what a plain count gives."""
    rng = np.random.default_rng(12)
    ids = rng.integers(0, 300, 30_000).astype("<u2")
    ids[rng.random(30_000) < 0.01] = 65_535
    ids[5000:9000] = 7  # a document over many ranges
    (tmp_path / "with space").mkdir()
    (tmp_path / "with space" / "flat.bin").write_bytes(ids.tobytes())
    ends = np.flatnonzero(ids == 65_535)
    want = np.diff(np.concatenate([[-1], ends])).astype(int) - 1
    for size in (2, 50, 1 << 10, 1 << 20):
        if size == 2:  # one id a block, on the head of the file
            (tmp_path / "head").mkdir()
            (tmp_path / "head" / "flat.bin").write_bytes(ids[:400].tobytes())
        folder = tmp_path / ("head" if size == 2 else "with space")
        blocks = read_files(spark, str(folder), size)
        got = {r.nth: r.n_tokens for r in document_lengths(blocks, 65_535).where("ended").collect()}
        assert [got[i] for i in range(len(got))] == want[:len(got)].tolist() and len(got) == (len(want) if size > 2 else (ends < 400).sum())
    assert read_files(spark, str(tmp_path / "with space"), 50).rdd.getNumPartitions() > 1
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "flat.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number of 2-byte ids"):
        read_files(spark, str(tmp_path / "odd")).collect()
    with pytest.raises(ValueError, match="multiple"):
        read_files(spark, str(tmp_path / "odd"), 3)


def test_ids_must_fit():
    assert token_scan._narrow(np.array([1, 65_535], "<u4").tobytes()) == np.array([1, 65_535], "<u2").tobytes()
    with pytest.raises(OverflowError):
        token_scan._narrow(np.array([65_536], "<u4").tobytes())
