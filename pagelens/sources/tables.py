"""Extracted tables: cell rows in; one record per table, every row beside it, artifacts in packed files.

An artifact's path is ``<folder>/bucket=<hh>#<table id>``: the folder holds the artifacts of many tables, so a million
tables are at most 256 folders, and the part behind ``#`` picks one. What a record names is what the writers write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens.functions.text import clean_cells, table_preview
from pagelens.session import freed_shuffles

SAMPLE_ROWS = 10
# Table rows of one artifact folder that a single task takes; of more rows, the tables of a folder are dealt to several tasks.
SHARE_ROWS = 1 << 24
KEY = ("pdf_path", "page", "table_no")


def path_mark(path: Column, digits: int = 8) -> Column:
    """Hex digits that tell files of one name in different folders apart."""
    return F.substring(F.sha2(F.coalesce(path, F.lit("")), 256), 1, digits)


def table_name() -> Column:
    """Unique over all files: page, number on the page, mark of the file. A null page or number is 0."""
    page, number = (F.coalesce(F.col(c), F.lit(0)) for c in ("page", "table_no"))
    return F.format_string("tbl-%04d-%02d-%s", page, number, path_mark(F.col("pdf_path")))


def artifact_path(root: str, kind: str, path: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{root}/{kind}/bucket="), path_mark(path, 2), F.lit("#"), name)


def shares_of(cells: DataFrame) -> int:
    """Tasks that a folder's tables are dealt to, were all rows of ``cells`` (best written ones) one folder's."""
    return 1 + cells.count() // SHARE_ROWS


def table_records(
    cells: DataFrame, artifact_dir: str = "artifacts", sample_rows: int = SAMPLE_ROWS, shares: int | None = None,
) -> DataFrame:
    """One record per table: headers, row count, preview, artifact paths, and ``first_rows`` for the JSON sidecar.

    ``row_no`` counts from 0 (the headers) without gaps; a null row is an empty one. All data rows are the
    record's companion :func:`table_rows`: a table of any length must not become one value, so only the header and
    the first ``sample_rows`` rows enter the record, pre-aggregated before the shuffle. Tables without
    rows, or whose rows are all null, have no record.

    With ``shares`` the rows are shuffled by their artifact folder, each dealt to that many tasks, and the records carry it as
    ``bucket``: where they are written by folder, that is the only shuffle.
    """
    folder = []
    if shares is not None:
        folder = ["bucket", "_share"]
        # Rows that no record shows are counted, their cells stay behind.
        cells = cells.select(
            path_mark(F.col("pdf_path"), 2).alias("bucket"), F.pmod(F.xxhash64("page", "table_no"), F.lit(shares)).cast("int").alias("_share"), *KEY,
            "row_no", "bbox", F.when(F.coalesce(F.col("row_no") <= sample_rows, F.lit(False)), F.col("cells")).alias("cells"),
            F.col("cells").isNotNull().alias("_has"),
        ).repartition(*folder)
    given = F.count("cells") if shares is None else F.count_if("_has")
    head = F.when(F.col("row_no") <= sample_rows, F.struct("row_no", _row().alias("cells")))
    grouped = cells.groupBy(*folder, *KEY).agg(
        F.array_sort(F.collect_list(head)).alias("_rows"),
        (F.count(F.lit(1)) - 1).alias("row_count"),
        F.min("bbox").alias("bbox"), given.alias("_given"),
    ).where("_given > 0")
    rows = F.transform("_rows", lambda r: r["cells"])
    return (
        grouped.withColumn("_all", rows)
        .select(
            *folder[:1], table_name().alias("table_id"), *KEY, "bbox", F.lit(None).cast("string").alias("title"),
            F.get("_all", F.lit(0)).alias("headers"),
            F.slice("_all", F.lit(2), F.lit(sample_rows)).alias("first_rows"),
            F.col("row_count").cast("int").alias("row_count"),
            artifact_path(artifact_dir, "tables", F.col("pdf_path"), table_name()).alias("csv_path"),
            artifact_path(artifact_dir, "records", F.col("pdf_path"), table_name()).alias("json_path"),
        )
        .withColumn("preview_text", table_preview(
            F.col("title"), F.col("headers"), F.get("first_rows", F.lit(0)), F.get("first_rows", F.lit(1))))
    )


def _row() -> Column:
    return F.coalesce(clean_cells(F.col("cells")), F.array().cast("array<string>"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Every data row of every table, cleaned: table_id, the key, row_no (from 1) and cells."""
    return cells.where(F.col("row_no") > 0).select(table_name().alias("table_id"), *KEY, "row_no", _row().alias("cells"))


def csv_rows(cells: DataFrame) -> DataFrame:
    """The lines of each table's CSV artifact, header first."""
    cell = F.transform(_row(), lambda c: F.when(
        c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return cells.select(
        path_mark(F.col("pdf_path"), 2).alias("bucket"), table_name().alias("table_id"), "row_no",
        # A lone empty cell is quoted, so that its row is not an empty line.
        F.when((F.size(cell) == 1) & (F.get(cell, F.lit(0)) == ""), '""')
        .otherwise(F.array_join(cell, ",")).alias("value"),
    )


def write_table_csv(cells: DataFrame, out_dir: str, rows_per_part: int = 1_000_000) -> None:
    """The CSV lines of all tables, packed: ``tables/bucket=hh`` holds (table_id, row_no, value) in order.

    A table longer than ``rows_per_part`` rows is written in several files by several tasks.
    """
    lines = csv_rows(cells).withColumn("_part", F.expr(f"row_no div {rows_per_part}"))
    with freed_shuffles(cells.sparkSession):
        (
            lines.repartition("bucket", "_part").sortWithinPartitions("bucket", "table_id", "row_no")
            .drop("_part").write.partitionBy("bucket").parquet(f"{out_dir}/tables", compression="zstd")
        )


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the table artifact that a record names: its folder's rows of its table, in any order."""
    folder, name = path.rsplit("#", 1)
    kind = folder.rsplit("/", 2)[-2]
    rows = spark.read.parquet(folder) if kind == "tables" else spark.read.json(folder)
    return rows.where(F.col("table_id") == name)


def sidecar(records: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The JSON artifact: the whole record with its first rows only."""
    return records.withColumn("rows", F.slice("first_rows", 1, sample_rows)).drop("first_rows")


def write_sidecars(records: DataFrame, out_dir: str, sample_rows: int = SAMPLE_ROWS, compression: str | None = None) -> None:
    """``records/bucket=hh``: one JSON line per table. A folder is one task's work, but for large ones, which adaptive execution
    splits; otherwise every task would write a file into each. Records that carry their ``bucket`` lie by it already. JSON lines repeat
    their names and paths: for many tables ``gzip`` makes a tenth of them, which Spark reads back like plain ones."""
    lines = sidecar(records, sample_rows)
    if "bucket" not in records.columns:
        lines = lines.withColumn("bucket", path_mark(F.col("pdf_path"), 2)).hint("rebalance", "bucket")
    with freed_shuffles(records.sparkSession):
        lines.write.option("ignoreNullFields", "false").partitionBy("bucket").json(f"{out_dir}/records", compression=compression)
