"""The pipeline's stages against what they should keep, and the registration."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from test_near_copies import kept as brute_force

import __spark_entry__
import corpus_pipeline
from pagelens.llm import decontaminate
from pagelens.llm.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    for step in steps[1:5]:
        assert step.columns == steps[0].columns


def test_decisions_take_effect(spark, steps):
    docs, kept, single, cleaned, masked, packed = steps
    assert 0.6 * docs.count() < kept.count() <= docs.count()
    # Five-word shingles, Jaccard similarity 0.8, every pair compared.
    assert {r.doc_id for r in single.collect()} == brute_force([(r.doc_id, r.text) for r in kept.collect()])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.overlaps(single, bench).collect()}
    assert {r.doc_id for r in cleaned.collect()} == {r.doc_id for r in single.collect()} - hit
    before, after = ({r.doc_id: r for r in df.collect()} for df in (cleaned, masked))
    assert before.keys() == after.keys()
    hexes = re.compile("[0-9a-f]{24,}")
    for i, r in after.items():
        assert r.text is None or not hexes.search(r.text) and r.n_chars == len(r.text)
        if not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|bearer|[0-9a-f]{24}", before[i].text or ""):
            assert r.text == before[i].text
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps[-1].collect())


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
