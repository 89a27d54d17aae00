"""What a chain of writes leaves on the disks: shuffles freed, artifacts compressed, tables shuffled and written once."""

from __future__ import annotations

import glob
import time
import uuid

from pyspark.sql import functions as F

from pagelens import session
from pagelens.catalog import QUERIES
from pagelens.operators import search
from pagelens.operators.embedding import hashed_words
from pagelens.plans.ingest import index_files
from pagelens.session import FREE_SHUFFLES, materialize
from pagelens.sources.store import RecordStore
from pagelens.sources.tables import read_artifact, shares_of, table_records, write_sidecars

CELLS = "pdf_path string, page int, table_no int, row_no int, cells array<string>, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def cells(spark):
    rows = [(f"f{i % 7}.pdf", i // 7, 0, r, ["a", None, f" {i}-{r} "] if r % 5 else None, None) for i in range(21) for r in range(14)]
    rows += [(None, None, 1, 0, ["x"], None), ("f1.pdf", None, None, 0, ["y"], (0.0, 1.0, 2.0, 3.0)), ("f2.pdf", 9, 9, 1, None, None)]
    return spark.createDataFrame(rows, CELLS)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    kept = materialize(spark.range(10_000).repartition(5, F.col("id")).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert kept.count() == 7 and spark.conf.get(FREE_SHUFFLES, "false") == "false"
    spark.range(10).repartition(2, F.col("id")).write.format("noop").mode("overwrite").save()  # the count's own shuffle and this one stay
    end = time.time() + 20
    while shuffle_files(spark) > before + 14 and time.time() < end:
        time.sleep(0.2)
    plain = shuffle_files(spark)
    for _ in range(3):
        materialize(spark.range(10_000).repartition(50, F.col("id")).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    end = time.time() + 20
    while shuffle_files(spark) > plain and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= plain


def test_records_by_folder_are_the_same(spark, plan_of, tmp_path):
    plain = table_records(cells(spark))
    dealt = table_records(cells(spark), shares=3)
    assert dealt.columns == ["bucket", *plain.columns]
    key = lambda r: str(r)
    assert sorted(dealt.drop("bucket").collect(), key=key) == sorted(plain.collect(), key=key)
    assert plan_of(dealt).count("Exchange hashpartitioning") == 1
    write_sidecars(dealt, str(tmp_path / "dealt"), compression="gzip")
    write_sidecars(plain, str(tmp_path / "plain"))
    assert glob.glob(f"{tmp_path}/dealt/records/bucket=*/*.json.gz") and not glob.glob(f"{tmp_path}/dealt/records/bucket=*/*.json")
    one, two = (spark.read.json(f"{tmp_path}/{n}/records") for n in ("dealt", "plain"))
    assert one.columns == two.columns and sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert shares_of(cells(spark)) == 1


def test_text_search_writes_its_vectors_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda _, label: f"{tmp_path}/scratch/{label}-{uuid.uuid4().hex}")
    monkeypatch.setattr(search, "MANY_QUESTIONS", 3)  # the way of many questions
    words = "ab cd ef gh ij kl mn op".split()
    docs = [(i, " ".join(words[(i + j) % 8] for j in range(4)) + f" n{i}", "en", f"src{i % 3}", 0) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, 0, "user", docs[i][1]) for i in range(9)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("search_text", "ask_documents"):
        before = set(glob.glob(f"{tmp_path}/scratch/corpus-*"))
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(set(glob.glob(f"{tmp_path}/scratch/corpus-*")) - before) == 1
        assert {r.qid for r in rows} == {1000 * i for i in range(9)}
        if name == "search_text":
            assert len(rows) == 36 and all(abs(r.score) < 1e-9 for r in rows if r["rank"] == 1)
        else:
            assert all(docs[r.qid // 1000][1] in r.prompt.split("Context:")[1] and r.ok for r in rows)


def test_ingest_writes_its_tables_once(spark, tmp_path, monkeypatch):
    made = cells(spark).where("pdf_path is not null and page is not null")
    files = made.select("pdf_path").distinct().withColumn("doc_hash", F.sha2("pdf_path", 256))
    store = RecordStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(session, "scratch_path", lambda _, label: f"{tmp_path}/scratch/{label}-{uuid.uuid4().hex}")
    index_files(store, files, cells=made, embed=hashed_words(), artifact_root=str(tmp_path / "art"))
    assert glob.glob(f"{tmp_path}/scratch/table-records-*") and not glob.glob(f"{tmp_path}/scratch/tables-*")
    assert glob.glob(f"{tmp_path}/art/batch=0/records/bucket=*/*.json.gz")
    record = store.collection("pdf_tables").orderBy("table_id").first()
    (line,) = read_artifact(spark, record["json_path"]).collect()
    assert line["table_id"] == record["table_id"] and line["preview_text"] and len(line["rows"]) == 10
    assert read_artifact(spark, record["csv_path"]).count() == line["row_count"] + 1
    assert store.collection("pdf_tables").count() == 21
