"""Files to collection records: text chunks, tables and images with stable ids and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions import ids as I
from pagelens.functions.media import media_type
from pagelens.functions.text import file_name, file_stem, has_text, image_body, page_number, table_body
from pagelens.model import RECORDS
from pagelens.operators.chunking import recursive_chunks
from pagelens.operators.embedding import hashed_words
from pagelens.operators.identity import keep_first, not_indexed
from pagelens.operators.inference import caption, recognise_text
from pagelens.operators.numbering import running_number, running_total
from pagelens.session import materialize, spread
from pagelens.sources.files import cap_pages, with_figure_paths, write_figures
from pagelens.sources.store import REJECTS, RecordStore
from pagelens.sources.tables import shares_of, table_records, write_sidecars, write_table_csv

Embedder = Callable[[Column], Column]
# Pages (or table pages) of one file that a single task numbers; a longer file uses several tasks.
PAGES_PER_BUCKET = 10_000


def _bucket(page: str) -> Column:
    return F.expr(f"{page} div {PAGES_PER_BUCKET}")


def with_provenance(rows: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Add each file's hash and tag. ``files`` is (pdf_path, doc_hash); Spark broadcasts it when its
    measured size is small and shuffles by path otherwise. A row of a file that ``files`` lacks is an error;
    if not ``strict``, such rows are left out on purpose."""
    tag = F.coalesce(F.nullif(F.col("doc_tag"), F.lit("")), file_stem(F.col("pdf_path")))
    if "doc_hash" in rows.columns:  # attached earlier
        return rows
    known = files if "doc_tag" in files.columns else files.withColumn("doc_tag", F.lit(None).cast("string"))
    narrow = known.select("pdf_path", "doc_hash", tag.alias("doc_tag"))
    if not strict:
        return rows.join(narrow, "pdf_path")
    lost = F.raise_error(F.concat(F.lit("no such file is listed: "), F.coalesce("pdf_path", F.lit("null"))))
    return rows.join(narrow, "pdf_path", "left").withColumn("doc_hash", F.coalesce("doc_hash", lost.cast("string")))


def with_paths(files: DataFrame) -> DataFrame:
    """The files; one without a path is an error when it is read."""
    given = F.when(F.length("pdf_path") > 0, F.col("pdf_path")).otherwise(F.raise_error(F.lit("a file needs a path")).cast("string"))
    return files.withColumn("pdf_path", given)


def _record(df: DataFrame, collection: str, kind: str) -> DataFrame:
    """Fill up the common layout; the vector comes later."""
    given = df.withColumn("collection", F.lit(collection)).withColumn("type", F.lit(kind)).withColumn(
        "file_name", file_name(F.col("pdf_path")))
    return given.select(*[
        (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RECORDS.fields if f.name != "embedding"
    ])


def text_records(pages: DataFrame, files: DataFrame, chunks: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of every page. The chunk number in an id counts over the whole file: the splitter runs once and its
    chunks are stored; only the pages' chunk counts are numbered, and each page gets back how many chunks come
    before it."""
    split = chunks or recursive_chunks()
    cut = with_provenance(pages.where(has_text(F.col("text"))), files).select(
        "pdf_path", "doc_hash", "doc_tag", page_number(F.col("page0")).alias("page"), "page_label",
        F.xxhash64("text").alias("_tie"), split(F.col("text")).alias("_chunks"))
    stored = materialize(cut.withColumn("_n", F.size("_chunks")).withColumn("_row", F.monotonically_increasing_id()), "chunks")
    counted = running_total(
        # Page numbers should be unique, but a repeated one must not make ids hang on the order of arrival.
        stored.select("pdf_path", "page", "page_label", "_tie", "_n", "_row"),
        ["pdf_path"], ["page", "page_label", "_tie"], _bucket("page"), F.col("_n"), "_before")
    rows = stored.drop("_tie", "_n").join(counted.select("_row", "_before"), "_row").select(
        "pdf_path", "page", "page_label", "doc_hash", "doc_tag", "_before",
        F.posexplode("_chunks").alias("_no", "_c"))
    rows = rows.select("*", F.col("_c.chunk").alias("text"), (F.col("_before") + F.col("_no")).alias("position"))
    return _record(rows.withColumn("id", I.text_id(F.col("doc_hash"), F.col("page"), F.col("position"))),
                   "pdf_text", "text")


def table_rows(records: DataFrame, files: DataFrame, written: bool = False) -> DataFrame:
    """Table records (see ``sources.tables``) with ids; the table number counts over the file.

    Numbering reads its input twice. Records are far smaller than the cell rows they are grouped from, so
    they are written once instead of grouping all cells again; ``written`` says that they are already.
    """
    narrow = records.drop("title", "headers", "first_rows", "row_count", "bucket")
    numbered = running_number(narrow if written else materialize(narrow, "tables"), ["pdf_path"], ["page", "table_no"], _bucket("page"))
    known = with_provenance(numbered, files).withColumn("bbox_sig", I.bbox_sig(F.col("bbox")))
    vid = I.table_id(F.col("doc_hash"), F.col("page"), F.col("bbox_sig"), F.col("position"))
    body = table_body(F.col("preview_text"), F.col("page"))
    return _record(known.select("*", *I.bbox_fields(F.col("bbox")), vid.alias("id"), body.alias("text")),
                   "pdf_tables", "table")


def image_rows(images: DataFrame, files: DataFrame) -> DataFrame:
    """Image records with content-addressed ids: the same image twice on a page is one record."""
    known = with_provenance(images, files).withColumn("bbox_sig", I.bbox_sig(F.col("bbox")))
    vid = I.image_id(F.col("doc_hash"), F.col("page"), I.image_hash(F.col("content")))
    body = image_body(F.col("caption"), F.col("ocr_text"), F.col("page"), F.col("pdf_path"))
    rows = known.select(
        "*", *I.bbox_fields(F.col("bbox")), vid.alias("id"), body.alias("text"),
        has_text(F.col("caption")).alias("has_caption"), has_text(F.col("ocr_text")).alias("has_ocr"))
    return keep_first(_record(rows, "pdf_images", "image"), ["id"], ["image_id", "png_path", "text"])


def describe_images(images: DataFrame, captioner=None, ocr=None) -> DataFrame:
    """Fill caption and ocr_text by injected models; without one, empty caption and null text."""
    suffix = F.regexp_extract("png_path", r"(\.[^./]*)$", 1)
    said = caption(F.col("content"), media_type(suffix), captioner) if captioner else F.lit("")
    seen = recognise_text(F.col("content"), ocr) if ocr else F.lit(None).cast("string")
    bbox = F.col("bbox") if "bbox" in images.columns else F.lit(None)
    return images.withColumn("caption", said).withColumn("ocr_text", seen).withColumn(
        "bbox", bbox.cast("struct<x0:double,y0:double,x1:double,y1:double>"))


def ingest(
    *, pages: DataFrame | None = None, cells: DataFrame | None = None, images: DataFrame | None = None,
    enable_text: bool = False, enable_tables: bool = True, enable_images: bool = True,
    num_pages: int | None = None, captioner=None, ocr=None, caption_images: bool = True, run_ocr: bool = False,
    artifact_dir: str = "artifacts", shares: int | None = None,
) -> dict[str, DataFrame | None]:
    """Run the enabled branches: text pages, table records, described images, and their counts."""
    text = cap_pages(pages, num_pages, page_number(F.col("page0"))) if enable_text and pages is not None else None
    tables = table_records(cap_pages(cells, num_pages, F.col("page")), artifact_dir, shares=shares) \
        if enable_tables and cells is not None else None
    pictures = describe_images(cap_pages(images, num_pages, F.col("page")),
                               captioner if caption_images else None, ocr if run_ocr else None) \
        if enable_images and images is not None else None
    branches = {"text": text, "tables": tables, "images": pictures}
    return {**branches, "stats": ingest_stats(**branches)}


def ingest_stats(
    text: DataFrame | None = None, tables: DataFrame | None = None, images: DataFrame | None = None,
) -> DataFrame | None:
    """(pdf_path, text_pages, tables, images); a disabled or empty branch counts 0."""
    names = {"text_pages": text, "tables": tables, "images": images}
    marked = [df.select("pdf_path", F.lit(name).alias("what")) for name, df in names.items() if df is not None]
    if not marked:
        return None
    rows = marked[0]
    for more in marked[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("pdf_path").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def all_records(
    ingested: dict[str, DataFrame | None], files: DataFrame, embed: Embedder | None = None,
    chunks: Callable[[Column], Column] | None = None, tables_written: bool = False,
) -> DataFrame:
    """Records of all modalities with vectors; ``chunks`` is another splitter than the recursive one. ``tables_written`` tells that
    the table records are read from where they were written."""
    known = with_paths(files)
    made = []
    if ingested.get("text") is not None:
        made.append(text_records(ingested["text"], known, chunks))
    if ingested.get("tables") is not None:
        made.append(table_rows(ingested["tables"], known, tables_written))
    if ingested.get("images") is not None:
        made.append(image_rows(ingested["images"], known))
    if not made:
        raise ValueError("nothing to index: every branch is disabled")
    records = made[0]
    for more in made[1:]:
        records = records.unionByName(more)
    return spread(records).withColumn("embedding", (embed or hashed_words())(F.col("text"))).select(*RECORDS.names)


KINDS = ("pages", "cells", "images")


def unusable(kind: str) -> Column:
    """Why a row cannot be taken, whatever the files are; null if it can."""
    reason = F.when(F.coalesce(F.col("pdf_path"), F.lit("")) == "", "no path")
    if kind == "cells":
        return reason.when(F.col("row_no").isNull(), "no row number")
    return reason.when(F.col("content").isNull(), "no content") if kind == "images" else reason


def rejected(given: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(kind, pdf_path, reason, n_rows) of the rows of ``given`` that cannot be taken. Counted by path in every task before the paths
    meet ``files``, so texts and bytes are neither read nor shuffled."""
    listed = files.select("pdf_path").distinct().withColumn("_listed", F.lit(True))
    found = None
    for kind, rows in given.items():
        counted = rows.select("pdf_path", unusable(kind).alias("reason")).groupBy("pdf_path", "reason").agg(
            F.count(F.lit(1)).alias("n_rows"))
        reason = F.coalesce("reason", F.when(F.col("_listed").isNull(), "file not listed"))
        judged = counted.join(listed, "pdf_path", "left").select(F.lit(kind).alias("kind"), "pdf_path", reason.alias("reason"), "n_rows")
        found = judged if found is None else found.unionByName(judged)
    if found is None:
        return files.sparkSession.createDataFrame([], REJECTS)
    return found.where("reason is not null")


def index_files(
    store: RecordStore, files: DataFrame, *, embed: Embedder | None = None, force: bool = False,
    batch: int | None = None, artifact_root: str | None = None, chunks: Callable[[Column], Column] | None = None,
    replace: bool = False, **branches,
) -> DataFrame:
    """Ingest files whose content no stored record has, and store their records as one batch.
    Returns the per-file counts. Known files drop out before any splitting, captioning or embedding. With ``replace``, a file that is
    stored with other content under the same path gives up its earlier records.

    Rows that cannot be taken leave the rest alone: pages, table rows and images without a path, of a file that ``files`` does not list,
    images without bytes and table rows without a number are counted by file and reason in ``store.rejects()``. Given rows are the
    stored ones, those of known files, and the rejected.

    With an ``artifact_root``, the tables' CSV lines and JSON records and the images' bytes are written below it, in a folder
    of this batch, where the records' csv_path, json_path and png_path say. ``pages`` may be a loader instead of a table: a function that
    gets the new files and returns their page rows.
    """
    batch = store.next_batch() if batch is None else batch
    if artifact_root is not None:
        branches["artifact_dir"] = f"{artifact_root}/batch={batch}"
    # One file per content, so that the ids of this batch are unique.
    # Written once: it decides for every branch, and its size then tells Spark what may be broadcast.
    narrow = materialize(with_paths(files).select(*[c for c in ("pdf_path", "doc_hash", "doc_tag") if c in files.columns]), "files")
    fresh = materialize(
        keep_first(not_indexed(narrow, store.known_hashes(narrow, batch), force), ["doc_hash"], ["pdf_path"]), "fresh")
    if callable(branches.get("pages")):
        branches["pages"] = branches["pages"](fresh)
    if branches.get("cells") is not None:
        # Rejects, records, lines and sidecars all read the table rows: what makes them (often a numbering of every row) runs once.
        branches["cells"] = materialize(branches["cells"], "cells", "zstd")
        if artifact_root is not None:
            branches["shares"] = shares_of(branches["cells"])
    given = {n: branches[n] for n in KINDS if branches.get(n) is not None}
    # Their path, and whether a needed value is there, is all that is read of the rows here.
    store.reject(rejected(given, narrow), batch)
    wanted = {n: with_provenance(rows.where(unusable(n).isNull()), fresh, strict=False) for n, rows in given.items() if n != "cells"}
    if "cells" in given:  # cell rows are narrowed here and get their file's hash as records
        wanted["cells"] = given["cells"].where(unusable("cells").isNull()).join(fresh.select("pdf_path"), "pdf_path", "left_semi")
    ingested = ingest(**{**branches, **wanted})
    if artifact_root is not None and ingested["tables"] is not None:
        cells = cap_pages(wanted["cells"], branches.get("num_pages"), F.col("page"))
        write_table_csv(cells, branches["artifact_dir"])
        ingested["tables"] = materialize(ingested["tables"], "table-records", "zstd")
        write_sidecars(ingested["tables"], branches["artifact_dir"], compression="gzip")
    if artifact_root is not None and ingested["images"] is not None:
        ingested["images"] = with_figure_paths(ingested["images"], branches["artifact_dir"])
        # The bytes come from the given images: no model runs for them.
        write_figures(with_figure_paths(cap_pages(wanted["images"], branches.get("num_pages"), F.col("page")), branches["artifact_dir"]),
                      branches["artifact_dir"])
    tables_written = artifact_root is not None and ingested["tables"] is not None
    store.append(all_records(ingested, fresh, embed, chunks, tables_written), batch, unique=True, changed=fresh if replace else None)
    return ingested["stats"]
