"""The record store: upsert by batch, replays, pruning; and ingest of all modalities into it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelens.operators.identity import not_indexed
from pagelens.model import IMAGES, PAGES, RECORDS, TABLE_CELLS
from pagelens.plans.ingest import all_records, index_files, ingest, table_rows as stored_rows
from pagelens.sources.store import RecordStore
from pagelens.sources.tables import csv_rows, read_artifact, table_records, table_rows, write_table_csv


def records(spark, rows):
    """Rows of (collection, id, text, doc_hash)."""
    df = spark.createDataFrame(rows, "collection string, id string, text string, doc_hash string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORDS.fields])


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"))


def content(df):
    return {r.id: r.text for r in df.collect()}


def test_upsert_by_batches(spark, store):
    assert store.current().count() == 0
    store.append(records(spark, [("pdf_text", "a", "one", "h1"), ("pdf_text", "b", "one", "h1"), ("pdf_tables", "t", "one", "h1")]))
    store.append(records(spark, [("pdf_text", "a", "two", "h1"), ("pdf_images", "i", "two", "h2"), ("pdf_images", "i", "two", "h2")]))
    store.append(records(spark, [("pdf_text", "a", "three", "h1")]))
    assert content(store.current()) == {"a": "three", "b": "one", "t": "one", "i": "two"}
    assert store.current().count() == 4
    assert content(store.current(before=1)) == {"a": "one", "b": "one", "t": "one"}
    assert content(store.collection("pdf_tables")) == {"t": "one"}
    assert content(store.get(doc_hash="h2")) == {"i": "two"}


def test_same_batch_again_changes_nothing(spark, store):
    first = records(spark, [("pdf_text", "a", "one", "h1"), ("pdf_text", "b", "one", "h1")])
    second = records(spark, [("pdf_text", "a", "two", "h1")])
    store.append(first, 0)
    for _ in range(3):
        store.append(second, 1)
    assert content(store.current()) == {"a": "two", "b": "one"} and store.current().count() == 2


def test_scans_are_pruned(spark, store, plan_of):
    store.append(records(spark, [(c, c, "x", "h") for c in ("pdf_text", "pdf_tables", "pdf_images")]))
    plan = plan_of(store.collection("pdf_text").select("id"))
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("collection" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in filters)
    probe = plan_of(store.current().select("doc_hash").where("doc_hash = 'h'"))
    assert "embedding" not in probe and "EqualTo(doc_hash,h)" in probe


def test_probe_reads_only_the_asked_prefixes(spark, store, plan_of):
    rows = [("pdf_text", f"i{i}", "x", f"{i:02x}" + "0" * 62) for i in range(256)] + [("pdf_text", "n", "x", None), ("pdf_text", "e", "x", "")]
    store.append(records(spark, rows))
    store.append(records(spark, [("pdf_text", "late", "x", "07" + "1" * 62)]))
    asked = spark.createDataFrame([("07" + "0" * 62,), ("07" + "1" * 62,), ("07" + "2" * 62,), ("a1" + "3" * 62,)], "doc_hash string")
    found = store.known_hashes(asked)
    plan = plan_of(found)
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "prefix" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "embedding" not in plan
    assert found.count() == 3  # of 257 hashes those of two folders
    assert {r.doc_hash[:3] for r in not_indexed(asked, found).collect()} == {"072", "a13"}
    assert not_indexed(asked, store.known_hashes(asked, before=1)).count() == 3
    assert store.known_hashes(asked.limit(0)).count() == 0


def test_unfinished_batch_is_not_read(spark, store):
    store.append(records(spark, [("pdf_text", "a", "one", "h1")]))
    # A writer that died before its last write.
    records(spark, [("pdf_text", "a", "two", "h2")]).write.partitionBy("collection").parquet(f"{store.root}/records/batch=1")
    assert content(store.current()) == {"a": "one"} and store.batches() == [0]
    assert store.append(records(spark, [("pdf_text", "a", "three", "h3")])) == 1
    assert content(store.current()) == {"a": "three"}


def test_rows_that_cannot_be_taken_are_counted(spark, store):
    """Unlisted files, rows without a path, images without bytes, table rows without a number: the rest is stored."""
    pages, cells, pictures, files = sample(spark)
    more_pages = pages.unionByName(spark.createDataFrame([(None, 0, "1", "lost"), ("", 1, "1", "lost"), ("in/b.txt", 0, "1", "x"), ("in/b.txt", 1, "1", "x")], PAGES))
    more_cells = cells.unionByName(spark.createDataFrame([("in/a.pdf", 1, 0, None, ["?"], None), ("in/z.pdf", 1, 0, 0, ["h"], None)], TABLE_CELLS))
    more_pictures = pictures.unionByName(spark.createDataFrame([("fig", "in/a.pdf", 1, None, "f.png", None, None, None)], IMAGES))
    index_files(store, files, pages=more_pages, cells=more_cells, images=more_pictures, enable_text=True)
    got = {(r.kind, r.pdf_path, r.reason): r.n_rows for r in store.rejects().collect()}
    assert got == {
        ("pages", None, "no path"): 1, ("pages", "", "no path"): 1, ("pages", "in/b.txt", "file not listed"): 2,
        ("cells", "in/a.pdf", "no row number"): 1, ("cells", "in/z.pdf", "file not listed"): 1, ("images", "in/a.pdf", "no content"): 1}
    bare = RecordStore(spark, store.root + "-bare")
    index_files(bare, files, pages=pages, cells=cells, images=pictures, enable_text=True)
    assert content(store.current()) == content(bare.current()) and bare.rejects().count() == 0


def test_changed_file_gives_up_its_records(spark, store):
    files = "pdf_path string, doc_hash string"
    page = [("in/a.pdf", 0, "1", "First version"), ("in/a.pdf", 1, "2", "Second page"), ("in/b.pdf", 0, "1", "Other file")]
    index_files(store, spark.createDataFrame([("in/a.pdf", "a" * 64), ("in/b.pdf", "b" * 64)], files), pages=spark.createDataFrame(page, PAGES), enable_text=True)
    changed = spark.createDataFrame([("in/a.pdf", "c" * 64), ("in/b.pdf", "b" * 64)], files)
    new = spark.createDataFrame([("in/a.pdf", 0, "1", "Third version"), page[2]], PAGES)
    both = RecordStore(spark, store.root)
    index_files(both, changed, pages=new, enable_text=True, replace=True)
    assert sorted(content(store.current()).values()) == ["Other file", "Third version"]
    assert sorted(content(store.current(before=1)).values()) == ["First version", "Other file", "Second page"]
    index_files(store, changed, pages=new, enable_text=True, replace=True)  # nothing new, nothing lost
    assert sorted(content(store.current()).values()) == ["Other file", "Third version"]


def sample(spark):
    pages = spark.createDataFrame(
        [("in/a.pdf", 0, "i", "Alpha text. " * 200), ("in/a.pdf", 1, "ii", None), ("in/a.pdf", 2, "iii", "  "),
         ("in/a.pdf", None, None, "missing page number"), ("in/b.pdf", 0, "1", "Beta"), ("in/copy.pdf", 0, "1", "Beta")], PAGES)
    box = (0.5, 1.5, 10.0, 20.0)
    cells = spark.createDataFrame(
        [("in/a.pdf", 1, 0, 0, [" h1", None], box), ("in/a.pdf", 1, 0, 1, ["1", "x,y"], box), ("in/a.pdf", 1, 0, 2, ['say "no"', "2"], box),
         ("in/a.pdf", 2, 0, 0, ["only", "headers"], None), ("in/a.pdf", 2, 1, 0, [""], None), ("in/b.pdf", 1, 0, 0, ["h"], None),
         ("in/b.pdf", 1, 0, 1, ["v"], None), ("in/b.pdf", 5, 0, 0, None, None)], TABLE_CELLS)
    pictures = spark.createDataFrame(
        [("fig-p0001-img00-a", "in/a.pdf", 1, None, "figures/a/fig-p0001-img00-a.png", None, None, bytearray(b"pixels")),
         ("fig-p0001-img01-b", "in/a.pdf", 1, None, "figures/a/fig-p0001-img01-b.png", None, None, bytearray(b"pixels")),
         ("fig-p0002-full-c", "in/b.pdf", 2, box, "figures/b/fig-p0002-full-c.jpg", None, None, bytearray(b"page"))], IMAGES)
    files = spark.createDataFrame(
        [("in/a.pdf", "a" * 64), ("in/b.pdf", "b" * 64), ("in/copy.pdf", "b" * 64)], "pdf_path string, doc_hash string")
    return pages, cells, pictures, files


def test_all_modalities(spark):
    def say_mime(content, *, mime):
        if content == b"page":
            raise RuntimeError("no")
        return f" {mime} "

    pages, cells, pictures, files = sample(spark)
    done = ingest(pages=pages, cells=cells, images=pictures, enable_text=True, captioner=say_mime, ocr=lambda c: " text ", run_ocr=True)
    assert {tuple(r) for r in done["stats"].collect()} == {("in/a.pdf", 4, 3, 2), ("in/b.pdf", 1, 1, 1), ("in/copy.pdf", 1, 0, 0)}
    rows = {r.id: r for r in all_records(done, files).collect()}
    h = "a" * 16
    tables = sorted(i for i in rows if i.startswith(f"{h}:table"))
    assert tables == [f"{h}:table:p0001:0_2_10_20:00", f"{h}:table:p0002:none:01", f"{h}:table:p0002:none:02"]
    assert rows[tables[0]].text == 'Table. Headers: h1 | . Example rows: 1 | x,y ; say "no" | 2'
    assert rows[tables[1]].text == "Table. Headers: only | headers" and rows[tables[1]].bbox_x0 is None
    texts = sorted(i for i in rows if i.startswith(f"{h}:text"))
    assert texts[0] == f"{h}:text:p0001:c0000" and len(texts) == 4  # three chunks of page one, one of the page without number
    images = [r for i, r in rows.items() if i.startswith(f"{h}:image")]
    assert len(images) == 1 and images[0].image_id == "fig-p0001-img00-a"
    assert images[0].text == "image/png\nOCR: text" and images[0].has_caption and images[0].has_ocr
    broken = next(r for i, r in rows.items() if i.startswith("b" * 16 + ":image"))
    assert broken.text == "OCR: text" and not broken.has_caption and broken.bbox_y1 == 20.0
    assert all(r.doc_tag in ("a", "b", "copy") and len(r.embedding) == 64 for r in rows.values())


def test_branches_and_page_cap(spark):
    pages, cells, pictures, files = sample(spark)
    off = ingest(pages=pages, cells=cells, images=pictures, num_pages=1)
    assert off["text"] is None
    assert {tuple(r) for r in off["stats"].collect()} == {("in/a.pdf", 0, 1, 2), ("in/b.pdf", 0, 1, 0)}
    assert ingest(pages=pages, enable_text=True, num_pages=0)["text"].count() == 6
    with pytest.raises(ValueError):
        all_records(ingest(enable_tables=False, enable_images=False), files)


def test_known_content_is_skipped(spark, store):
    pages, cells, pictures, files = sample(spark)
    given = dict(pages=pages, cells=cells, images=pictures, enable_text=True)
    stats = index_files(store, files, **given)
    assert {r.pdf_path for r in stats.collect()} == {"in/a.pdf", "in/b.pdf"}  # the copy has known content
    stored = store.current().count()
    index_files(store, files, **given)
    assert store.current().count() == stored == store.all_batches().count()
    index_files(store, files, force=True, **given)
    assert store.current().count() == stored < store.all_batches().count()


def test_table_of_one_huge_group(spark):
    rows = spark.range(5000).select(
        F.lit("f.pdf").alias("pdf_path"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.col("id").cast("int").alias("row_no"),
        F.array(F.col("id").cast("string")).alias("cells"), F.lit(None).cast(TABLE_CELLS["bbox"].dataType).alias("bbox"))
    record = table_records(rows.repartition(4)).first()
    assert record.row_count == 4999 and record.headers == ["0"] and [r[0] for r in record.first_rows] == [str(i) for i in range(1, 11)]


def test_csv_artifact(spark, tmp_path):
    _, cells, _, _ = sample(spark)
    write_table_csv(cells, str(tmp_path), rows_per_part=2)
    for record in table_records(cells, str(tmp_path)).collect():
        want = csv_rows(cells).where(F.col("table_id") == record.table_id)
        got = read_artifact(spark, record.csv_path).orderBy("row_no").collect()
        assert [r.value for r in got] == [r.value for r in want.orderBy("row_no").collect()] and got
        if record.table_id.startswith("tbl-0001-00") and record.pdf_path == "in/a.pdf":
            assert [r.value for r in got] == ["h1,", '1,"x,y"', '"say ""no""",2']
    assert {r.value for r in csv_rows(cells).where("table_id like 'tbl-0002-01%'").collect()} == {'""'}


def test_no_table_row_is_lost(spark):
    rows = [("a/x.pdf", 1, 0, i, None if i in (0, 3, 4) else [f"a{i}"], None) for i in range(15)]
    rows += [("b/x.pdf", 1, 0, i, [f"b{i}"], None) for i in range(3)] + [(None, None, None, i, [f"n{i}"], None) for i in range(2)]
    cells = spark.createDataFrame(rows, TABLE_CELLS)
    got = {r.pdf_path: r for r in table_records(cells).collect()}
    assert got["a/x.pdf"].headers == [] and got["a/x.pdf"].row_count == 14 and len(got["a/x.pdf"].first_rows) == 10
    assert got[None].headers == ["n0"] and len({r.table_id for r in got.values()}) == 3
    assert table_rows(cells).count() == 14 + 2 + 1
    files = spark.createDataFrame([("a/x.pdf", "1" * 64), ("b/x.pdf", "2" * 64)], "pdf_path string, doc_hash string")
    assert stored_rows(table_records(cells.where("pdf_path is not null")), files).count() == 2


def test_table_rows_are_made_once(spark, tmp_path):
    """Rejects, records, lines and sidecars of one ingest read the table rows that were written, not what makes them."""
    pages, cells, pictures, files = sample(spark)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = cells.mapInArrow(count, cells.schema)
    index_files(RecordStore(spark, str(tmp_path / "store")), files, cells=counted, artifact_root=str(tmp_path / "artifacts"))
    assert made.value == cells.count()


def test_sidecar_folders_hold_few_files(spark, tmp_path):
    from pagelens.sources.tables import write_sidecars

    rows = [(f"f{i % 3}.pdf", i, 0, r, ["a"], None) for i in range(60) for r in range(2)]
    records = table_records(spark.createDataFrame(rows, TABLE_CELLS).repartition(12)).repartition(12)
    write_sidecars(records, str(tmp_path))
    files = list((tmp_path / "records").glob("bucket=*/part-*"))
    assert len(files) == 3 and spark.read.json(str(tmp_path / "records")).count() == 60
