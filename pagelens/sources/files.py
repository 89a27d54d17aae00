"""Files as rows, with their content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens.functions.ids import content_hash, image_hash, short_hash
from pagelens.functions.text import file_name
from pagelens.session import freed_shuffles
from pagelens.sources.tables import artifact_path, path_mark


def with_hashes(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``doc_hash`` (64 hex digits), ``id_hash`` (its first 16) and ``image_hash`` (12)."""
    whole = content_hash(F.col(content))
    return df.select(
        "*", whole.alias("doc_hash"), short_hash(whole).alias("id_hash"),
        image_hash(F.col(content)).alias("image_hash"),
    )


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``binaryFile`` rows below ``path``: pdf_path, modificationTime, length, content, doc_hash."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("pdf_path"), "modificationTime", "length", "content",
        content_hash(F.col("content")).alias("doc_hash"),
    )


def cap_pages(df: DataFrame, num_pages: int | None, page: Column) -> DataFrame:
    """First ``num_pages`` pages by 1-based number; none, zero or less keeps all. A plain filter,
    so it reaches the scan."""
    return df.where(page <= num_pages) if num_pages and num_pages > 0 else df


def read_images(spark: SparkSession, path: str, kind: str = "embedded", num_pages: int | None = None) -> DataFrame:
    """Image files named ``fig-pNNNN-imgNN-*`` (embedded) or ``fig-pNNNN-full-*`` (whole page) in one
    folder per document. ``kind`` is ``embedded``, ``fullpage`` or ``both``."""
    globs = {"embedded": "fig-p*-img*", "fullpage": "fig-p*-full-*", "both": "fig-p*"}
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", globs[kind]).load(path)
    )
    return cap_pages(image_records(files), num_pages, F.col("page"))


def image_records(files: DataFrame) -> DataFrame:
    """(path, content) rows to image records; page and index come from the file name."""
    name = file_name(F.col("path"))
    return files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("image_id"),
        F.element_at(F.split("path", "/"), -2).alias("pdf_path"),
        F.regexp_extract(name, r"^fig-p(\d+)-", 1).try_cast("int").alias("page"),
        F.when(name.rlike(r"^fig-p\d+-full-"), "fullpage").otherwise("embedded").alias("kind"),
        F.regexp_extract(name, r"-img(\d+)", 1).try_cast("int").alias("image_no"),
        F.col("path").alias("png_path"), "content",
    )


def with_figure_paths(images: DataFrame, artifact_dir: str) -> DataFrame:
    """The image records with ``png_path`` where :func:`write_figures` puts their bytes; the suffix stays."""
    name = F.concat(F.coalesce("image_id", F.lit("")), F.regexp_extract(F.coalesce("png_path", F.lit("")), r"(\.[^./]*)$", 1))
    return images.withColumn("png_path", artifact_path(artifact_dir, "figures", F.col("pdf_path"), F.concat(path_mark(F.col("pdf_path")), F.lit("-"), name)))


def write_figures(images: DataFrame, out_dir: str) -> None:
    """Bytes of all images, packed: ``figures/bucket=hh`` holds (name, content), the name as behind ``#`` in png_path."""
    rows = images.select(
        path_mark(F.col("pdf_path"), 2).alias("bucket"), F.element_at(F.split("png_path", "#"), -1).alias("name"), "content")
    with freed_shuffles(images.sparkSession):
        rows.write.partitionBy("bucket").parquet(f"{out_dir}/figures")
