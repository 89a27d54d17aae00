"""Packing: ids against the tokenizer itself, the plan against plain best fit decreasing, exact placement."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pagelens.llm.packing import CapacityTree, pack, plan_bins, tokenised
from pagelens.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aBé ß.\n\t\x1c\x85\xa0\u0301İΣς<|endoftext|>'s1"))))
def test_ids_are_the_tokenizers(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = t
    t.encode_special_tokens = True
    if not hasattr(test_ids_are_the_tokenizers, "e"):
        test_ids_are_the_tokenizers.e = encoder(cache_pieces=50)
    assert np.frombuffer(test_ids_are_the_tokenizers.e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def best_fit_decreasing(lengths, capacity):
    bins, free = 0, []
    for x in sorted(lengths, reverse=True):
        at = bisect_left(free, x)
        if at == len(free):
            bins += 1
            left = capacity - x
        else:
            left = free.pop(at) - x
        insort(free, left)
    return bins, sorted(free)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    histogram = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400))))
    filled, offsets, items = defaultdict(int), defaultdict(set), Counter()
    for length, rank, n, first, per, offset in plan_bins(histogram, capacity):
        assert rank == items[length]
        items[length] += n
        for r in range(n):
            b, at = first + r // per, offset + r % per * length
            assert filled[b] == at
            filled[b] += length
            offsets[b].add(at)
    assert items == Counter(histogram)
    bins, free = best_fit_decreasing([x for x, n in histogram.items() for _ in range(n)], capacity)
    assert (len(filled), sorted(capacity - x for x in filled.values())) == (bins, free)


def test_tree():
    tree = CapacityTree(9)
    for x in (3, 9, 5):
        tree.add(x, 1)
    assert [tree.tightest(n) for n in range(10)] == [3, 3, 3, 3, 5, 5, 9, 9, 9, 9]
    tree.add(9, -1)
    assert tree.tightest(6) is None


def test_pack(spark, tokenizer):
    texts = [None, "", "one two", "Größe, naïve!", "word " * 9000, "x" * 30_000, "one two", "😀 <|endoftext|> é"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "one", 5), (2, "one two", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    got = pack(docs).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.start.tolist() == list(range(0, len(ids), 4096))
        for row in mine.itertuples():
            assert zlib.crc32(ids[row.start:row.start + row.length].tobytes()) == row.ids_crc32
    assert len(got[got.doc_id == 2]) == 2 and got.doc_id.isna().sum() == 1
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 4096
    assert got.sequence_id.nunique() == best_fit_decreasing(got.length.tolist(), 4096)[0]
    assert pack(docs.limit(0)).count() == 0
    ids = tokenised(docs.where("doc_id = 2"), with_ids=True).first()["ids"]
    assert ids == [*tokenizer.encode("one two", add_special_tokens=False).ids, 1]


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = pack(docs).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == want


def test_one_encoder_for_all_tasks_of_a_worker(spark):
    """Tasks of one process share the encoder, though its code is shipped with every plan."""
    from pagelens.llm import tokens

    def run(batches):
        import os

        for batch in batches:
            encode = tokens.worker_encoder()
            encode("word")
            yield pa.RecordBatch.from_arrays(
                [pa.array([os.getpid()], pa.int64()), pa.array([id(encode)], pa.int64())], ["pid", "made"])

    rows = [tuple(r) for _ in range(3) for r in spark.range(8).repartition(8).mapInArrow(run, "pid bigint, made bigint").collect()]
    assert len(set(rows)) == len({pid for pid, _ in rows}) < len(rows)
