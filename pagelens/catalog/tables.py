"""Extracted tables: records, previews, ids, artifacts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pagelens.catalog import roles as R
from pagelens.catalog.registry import query, table
from pagelens.functions import ids as I
from pagelens.functions.text import table_preview
from pagelens.operators.numbering import running_number
from pagelens.plans.ingest import ingest, ingest_stats, table_rows as stored_rows
from pagelens.session import materialize, scratch_path
from pagelens.sources.tables import csv_rows, read_artifact, shares_of, sidecar, table_records, table_rows, write_sidecars, write_table_csv


# A record names its table; the checksum is over all of its data rows, summed up row by row.
@query("table_records", f"""WITH {R.TABLES_SQL},
sums AS (SELECT table_id, CAST(sum(CAST(('0x' || md5(concat(i, ':', array_to_string(all_rows[i], '|')))[1:8]) AS BIGINT)) AS BIGINT) AS rows_checksum
  FROM (SELECT table_id, all_rows, unnest(range(1, row_count + 1)) AS i FROM records) GROUP BY table_id)
SELECT pdf_path, page, table_no, table_id, 'line|part|quantity|price|flag' AS headers, rows_checksum,
       CAST(row_count AS INTEGER) AS row_count FROM records JOIN sums USING (table_id)""")
def table_records_query(spark, sf_dir):
    cells = R.table_cells(spark, sf_dir)
    line = F.concat(F.col("row_no").cast("string"), F.lit(":"), F.array_join("cells", "|"))
    one = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")
    sums = table_rows(cells).groupBy("table_id").agg(F.sum(one).alias("rows_checksum"))
    return table_records(cells).join(sums, "table_id").select(
        "pdf_path", "page", "table_no", "table_id", F.array_join("headers", "|").alias("headers"), "rows_checksum", "row_count")


@query("table_rows_long", f"""WITH {R.TABLES_SQL}
SELECT table_id, pdf_path, page, table_no, CAST(i AS INTEGER) AS row_no, array_to_string(all_rows[i], '|') AS cells
FROM (SELECT *, unnest(range(1, row_count + 1)) AS i FROM records)""")
def table_rows_long(spark, sf_dir):
    return table_rows(R.table_cells(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


# Pages of files, some of them without a page number or a file: no row is lost and the numbers stay gap-free.
@query("null_keys", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT position) AS BIGINT) AS positions, CAST(max(position) AS BIGINT) AS last, file
FROM (SELECT file, row_number() OVER (PARTITION BY file ORDER BY page NULLS FIRST, doc_id) - 1 AS position FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN source END AS file, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS page FROM documents)) GROUP BY file""")
def null_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("file"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("page"))
    numbered = running_number(rows, ["file"], ["page", "doc_id"], F.expr("page div 1000"))
    return numbered.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("positions"), F.max("position").alias("last"))


@query("table_preview", f"WITH {R.TABLES_SQL} SELECT pdf_path, page, table_no, preview_text FROM records")
def table_preview_query(spark, sf_dir):
    return table_records(R.table_cells(spark, sf_dir)).select("pdf_path", "page", "table_no", "preview_text")


# Customers of each nation as a table, titled with the nation's name for every other nation.
@query("titled_preview", """SELECT c_nationkey, concat(CASE WHEN c_nationkey % 2 = 0 THEN concat('Table: ', n_name, '.') ELSE 'Table.' END,
  ' Headers: key | name', '. Example rows: ', arr[1], CASE WHEN len(arr) > 1 THEN concat(' ; ', arr[2]) ELSE '' END) AS preview
FROM (SELECT c_nationkey, list(concat(c_custkey, ' | ', c_name) ORDER BY c_custkey) AS arr FROM customer GROUP BY 1)
JOIN nation ON n_nationkey = c_nationkey""")
def titled_preview(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    row = F.array(F.col("c_custkey").cast("string"), F.col("c_name"))
    first = table(spark, sf_dir, "customer").withColumn("place", place).where("place <= 2").groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("place", row.alias("row")))).alias("r"))
    title = F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return first.join(nation, "c_nationkey").select("c_nationkey", table_preview(
        title, F.array(F.lit("key"), F.lit("name")), F.get("r", F.lit(0))["row"], F.get("r", F.lit(1))["row"]).alias("preview"))


@query("table_sidecar", f"""WITH {R.TABLES_SQL}
SELECT table_id, pdf_path, page, concat('artifacts/records/bucket=', sha256(pdf_path)[1:2], '#', table_id) AS json_path,
       CAST(least(row_count, 2) AS INTEGER) AS rows_kept, CAST(row_count AS INTEGER) AS row_count FROM records""")
def table_sidecar(spark, sf_dir):
    return sidecar(table_records(R.table_cells(spark, sf_dir)), sample_rows=2).select(
        "table_id", "pdf_path", "page", "json_path", F.size("rows").alias("rows_kept"), "row_count")


@query("table_ids", f"""WITH {R.TABLES_SQL}
SELECT printf('%s:table:p%04d:%s:%02d', sha256(pdf_path)[1:16], page, bbox_sig,
         row_number() OVER (PARTITION BY pdf_path ORDER BY page, table_no) - 1) AS id,
       table_id, pdf_path, page, bbox_sig, trim(preview_text) AS text,
       concat('artifacts/tables/bucket=', sha256(pdf_path)[1:2], '#', table_id) AS csv_path,
       x0 AS bbox_x0, y0 AS bbox_y0, x0 + 100.5 AS bbox_x1, y0 + 50 AS bbox_y1 FROM records""")
def table_ids(spark, sf_dir):
    cells = R.table_cells(spark, sf_dir)
    return stored_rows(table_records(cells), R.table_files(spark, sf_dir)).select(
        "id", "table_id", "pdf_path", "page", "bbox_sig", "text", "csv_path", "bbox_x0", "bbox_y0", "bbox_x1", "bbox_y1")


@query("bbox_fields", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 5 = 0 THEN 'none' ELSE concat(CAST(round_even(l_quantity / 2, 0) AS BIGINT), '_', CAST(round_even(l_tax * 50, 0) AS BIGINT),
    '_', CAST(round_even(l_quantity * 1.5, 0) AS BIGINT), '_', CAST(round_even(l_quantity * 2, 0) AS BIGINT)) END AS bbox_sig,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity / 2 END AS bbox_x0, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax * 50 END AS bbox_y0,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity * 1.5 END AS bbox_x1, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity * 2 END AS bbox_y1
FROM lineitem""")
def bbox_fields(spark, sf_dir):
    q = F.col("l_quantity")
    sides = (q / 2, F.col("l_tax") * 50, q * 1.5, q * 2)
    box = F.when(F.col("l_orderkey") % 5 != 0, F.struct(*[s.alias(n) for n, s in zip(I.BOX_SIDES, sides)]))
    return table(spark, sf_dir, "lineitem").withColumn("bbox", box).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", I.bbox_sig(F.col("bbox")).alias("bbox_sig"),
        *I.bbox_fields(F.col("bbox")))


CSV_SQL = f"""WITH {R.TABLES_SQL},
long AS (SELECT sha256(pdf_path)[1:2] AS bucket, table_id, row_count, all_rows FROM records),
csv AS (SELECT bucket, table_id, CAST(0 AS INTEGER) AS row_no, 'line,part,quantity,price,flag' AS value FROM long
  UNION ALL SELECT bucket, table_id, CAST(i AS INTEGER), array_to_string(all_rows[i], ',') FROM
    (SELECT bucket, table_id, all_rows, unnest(range(1, row_count + 1)) AS i FROM long))"""


@query("table_csv", CSV_SQL + " SELECT bucket, table_id, row_no, value FROM csv")
def table_csv(spark, sf_dir):
    return csv_rows(R.table_cells(spark, sf_dir))


# Written through the artifact layout and read back: one table per source, listing its documents. Two files of one
# name in different folders stay apart.
@query("artifact_files", """SELECT concat('tbl-0001-00-', sha256(concat(folder, '/', source, '.pdf'))[1:8]) AS table_id, concat(folder, ',', doc_id, ',', lang) AS value
FROM documents, (VALUES ('a'), ('b')) AS f(folder)""")
def artifact_files(spark, sf_dir):
    out = scratch_path(spark, "artifacts")
    docs = running_number(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"),
                          ["source"], ["doc_id"], F.expr("doc_id div 65536"), "row_no")
    cells = docs.withColumn("folder", F.explode(F.array(F.lit("a"), F.lit("b")))).select(
        F.concat("folder", F.lit("/"), "source", F.lit(".pdf")).alias("pdf_path"), F.lit(1).alias("page"), F.lit(0).alias("table_no"),
        "row_no", F.array("folder", F.col("doc_id").cast("string"), "lang").alias("cells"))
    write_table_csv(cells, out)
    return spark.read.parquet(f"{out}/tables").select("table_id", "value")


# The lines of one table, found by the path in its record.
@query("artifact_by_path", CSV_SQL + """, first AS (SELECT min(table_id) AS table_id FROM records)
SELECT table_id, row_no, value FROM csv JOIN first USING (table_id)""")
def artifact_by_path(spark, sf_dir):
    out = scratch_path(spark, "artifacts")
    cells = materialize(R.table_cells(spark, sf_dir), "cells")
    write_table_csv(cells, out)
    path = table_records(cells, out).orderBy("table_id").select("csv_path").first()[0]
    return read_artifact(spark, path).select("table_id", "row_no", "value")


@query("sidecar_files", f"""WITH {R.TABLES_SQL}
SELECT table_id, pdf_path, CAST(row_count AS BIGINT) AS row_count, preview_text FROM records""")
def sidecar_files(spark, sf_dir):
    out = scratch_path(spark, "sidecars")
    # Written once, which frees the shuffles of its numbering ahead of the next one.
    cells = materialize(R.table_cells(spark, sf_dir), "cells", "zstd")
    write_sidecars(table_records(cells, shares=shares_of(cells)), out, compression="gzip")
    return spark.read.schema("table_id string, pdf_path string, row_count bigint, preview_text string").json(
        f"{out}/records").select("table_id", "pdf_path", "row_count", "preview_text")


@query("ingest_stats", f"""WITH {R.PAGES_SQL}, {R.TABLES_SQL}, {R.IMAGES_SQL},
n AS (SELECT pdf_path, 1 AS p, 0 AS t, 0 AS i FROM pages UNION ALL SELECT pdf_path, 0, 1, 0 FROM tables
  UNION ALL SELECT pdf_path, 0, 0, 1 FROM images)
SELECT pdf_path, CAST(sum(p) AS BIGINT) AS text_pages, CAST(sum(t) AS BIGINT) AS tables, CAST(sum(i) AS BIGINT) AS images
FROM n GROUP BY pdf_path""")
def ingest_stats_query(spark, sf_dir):
    tables = table_records(R.table_cells(spark, sf_dir))
    return ingest_stats(R.pages(spark, sf_dir), tables, R.images(spark, sf_dir))


@query("ingest_branches", f"""WITH {R.PAGES_SQL}, {R.TABLES_SQL},
n AS (SELECT pdf_path, 1 AS p, 0 AS t FROM pages WHERE page0 < 3 UNION ALL SELECT pdf_path, 0, 1 FROM tables WHERE page <= 3)
SELECT pdf_path, CAST(sum(p) AS BIGINT) AS text_pages, CAST(sum(t) AS BIGINT) AS tables, CAST(0 AS BIGINT) AS images
FROM n GROUP BY pdf_path""")
def ingest_branches(spark, sf_dir):
    return ingest(pages=R.pages(spark, sf_dir), cells=R.table_cells(spark, sf_dir), images=R.images(spark, sf_dir),
                  enable_text=True, enable_images=False, num_pages=3)["stats"]
