"""Files, images, page tables, sidecars, and a stored collection asked end to end."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from pagelens.model import PAGES, TABLE_CELLS
from pagelens.plans.answer import answer
from pagelens.plans.ingest import describe_images, image_rows, index_files
from pagelens.sources.files import read_files, read_images
from pagelens.sources.pages import pages_from_rows, read_pages
from pagelens.sources.store import RecordStore
from pagelens.sources.tables import table_records, write_sidecars


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pdf").write_bytes(b"two")
    (tmp_path / "note.txt").write_bytes(b"three")
    got = {r.pdf_path.rsplit("/", 1)[-1]: r.doc_hash for r in read_files(spark, str(tmp_path), "*.pdf").collect()}
    assert got == {"a.pdf": hashlib.sha256(b"one").hexdigest(), "b.pdf": hashlib.sha256(b"two").hexdigest()}


def test_images(spark, tmp_path):
    folder = tmp_path / "figures" / "paper"
    folder.mkdir(parents=True)
    for name in ("fig-p0001-img00-ab12cd.png", "fig-p0002-img10-ab12ce.JPG", "fig-p0002-full-ab12cf.png", "other.png", "fig-px-img01-x.png"):
        (folder / name).write_bytes(name.encode())
    got = read_images(spark, str(tmp_path))
    assert {(r.image_id, r.page, r.image_no, r.kind, r.pdf_path) for r in got.collect()} == {
        ("fig-p0001-img00-ab12cd", 1, 0, "embedded", "paper"), ("fig-p0002-img10-ab12ce", 2, 10, "embedded", "paper"),
        ("fig-px-img01-x", None, 1, "embedded", "paper")}
    assert {r.image_no for r in read_images(spark, str(tmp_path), "fullpage").collect()} == {None}
    assert read_images(spark, str(tmp_path), "both").count() == 4 and read_images(spark, str(tmp_path), num_pages=1).count() == 1
    files = spark.createDataFrame([("paper", "f" * 64)], "pdf_path string, doc_hash string")
    row = image_rows(describe_images(read_images(spark, str(tmp_path), num_pages=1)), files).first()
    sha = hashlib.sha1(b"fig-p0001-img00-ab12cd.png").hexdigest()[:12]
    assert row.id == f"{'f' * 16}:image:p0001:{sha}" and row.text == "Image on page 1 of paper" and row.bbox_sig == "none"


def test_page_cap_reaches_the_scan(spark, tmp_path, plan_of):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("a.pdf", i, str(i), "x") for i in range(5)] + [("a.pdf", None, None, "y")], PAGES).write.parquet(path)
    assert read_pages(spark, path, num_pages=2).count() == 3 and read_pages(spark, path, num_pages=0).count() == 6
    plan = plan_of(read_pages(spark, path, num_pages=2).select("pdf_path"))
    assert "text" not in plan.split("ReadSchema")[1] and "page0" in plan.split("DataFilters")[1]


def test_pages_from_rows(spark):
    rows = spark.createDataFrame([(7, "s", "c"), (3, "s", "a"), (5, "s", "b"), (1, "t", "z")], "n bigint, s string, text string")
    got = pages_from_rows(rows, file="s", order="n", rows_per_bucket=4)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("s.pdf", 0, "1", "a"), ("s.pdf", 1, "2", "b"), ("s.pdf", 2, "3", "c"), ("t.pdf", 0, "1", "z")]


def test_sidecars(spark, tmp_path):
    cells = spark.createDataFrame([("d/a.pdf", 1, 0, i, [f"r{i}"], None) for i in range(30)], TABLE_CELLS)
    write_sidecars(table_records(cells, "art"), str(tmp_path))
    (file,) = tmp_path.glob("records/bucket=*/*.json")
    record = json.loads(file.read_text())
    assert record["rows"] == [[f"r{i}"] for i in range(1, 11)] and record["headers"] == ["r0"] and record["row_count"] == 29
    assert record["title"] is None and record["bbox"] is None and record["csv_path"].startswith("art/tables/bucket=")
    assert record["csv_path"].endswith("#" + record["table_id"]) and record["table_id"].startswith("tbl-0001-00-")


def test_ask_a_stored_collection(spark, tmp_path):
    pages = spark.createDataFrame([(f"{w}.pdf", 0, "1", f"{w} {w} notes") for w in ("apple", "pear", "plum")], PAGES)
    files = pages.select("pdf_path", F.sha2("pdf_path", 256).alias("doc_hash"))
    store = RecordStore(spark, str(tmp_path / "store"))
    index_files(store, files, pages=pages, enable_text=True)
    questions = spark.createDataFrame([(1, "pear"), (2, "plum"), (3, "nothing known")], "qid int, question string")
    got = {r.qid: r for r in answer(store.current(), questions, lambda p: p[-20:], k_each=2, top_n=2).collect()}
    assert got[1].contexts[0] == "[pdf_text p1] pear pear notes\n(Source: pear.pdf)" and len(got[1].contexts) == 2
    assert got[2].contexts[0].startswith("[pdf_text p1] plum") and got[3].ok
