"""The shared tables in the roles the library works on, in Spark and as SQL.

documents: page text (file = source). lineitem: extracted table rows (table = order). part: images.
embeddings: stored vectors and question vectors. conversations: questions and answers. events: log
lines. Every role covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.catalog.registry import table
from pagelens.functions.ids import content_hash
from pagelens.operators.identity import document_hashes
from pagelens.operators.numbering import running_number
from pagelens.sources.files import image_records
from pagelens.sources.pages import pages_from_rows

# ---- pages ---------------------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from_rows(table(spark, sf_dir, "documents"), file="source", order="doc_id")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_hashes(pages(spark, sf_dir))


PAGES_SQL = """pages AS (
  SELECT concat(source, '.pdf') AS pdf_path,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page0,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS page_label,
         text
  FROM documents)"""

PAGE_FILES_SQL = """leaves AS (SELECT pdf_path, page0 AS n, sha256(text) AS h FROM pages),
level1 AS (SELECT pdf_path, n // 4096 AS up, sha256(string_agg(h, '' ORDER BY n)) AS h FROM leaves GROUP BY ALL),
level2 AS (SELECT pdf_path, up // 4096 AS up2, sha256(string_agg(h, '' ORDER BY up)) AS h FROM level1 GROUP BY pdf_path, up // 4096),
page_files AS (SELECT pdf_path, sha256(string_agg(h, '' ORDER BY up2)) AS doc_hash FROM level2 GROUP BY pdf_path)"""

CHUNKS_SQL = """page_chunks AS (
  SELECT pdf_path, page0 + 1 AS page, page_label, s AS chunk_no,
         s * 1050 AS start, least(s * 1050 + 1200, length(text)) AS "end", text[s * 1050 + 1 : s * 1050 + 1200] AS chunk
  FROM (SELECT *, unnest(range(0, (length(text) - 1) // 1050 + 1)) AS s FROM pages WHERE length(text) > 0))"""

# ---- table rows ----------------------------------------------------------------------------------

LEDGER_HEADERS = ("line", "part", "quantity", "price", "flag")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order: a header row, then one row per line item; some cells are padded or null."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    order = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    # Never falls along the row order, and spreads an order with very many parts over tasks.
    bucket = F.expr("l_partkey div 50000")
    rows = running_number(items, ["l_orderkey"], order, bucket)
    cells = F.array(
        F.col("l_linenumber").cast("string"), F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.lit(" ")),
        F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
        F.nullif(F.col("l_returnflag"), F.lit("N")))
    body = F.struct((F.col("position") + 1).cast("int").alias("row_no"), cells.alias("cells"))
    head = F.struct(F.lit(0).alias("row_no"), F.array(*[F.lit(h) for h in LEDGER_HEADERS]).alias("cells"))
    x0, y0 = F.expr("(l_orderkey % 60) / 2.0D"), F.expr("l_orderkey % 7 + 0.25D")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 100.5).alias("x1"), (y0 + 50).alias("y1"))
    return rows.withColumn("bbox", F.when(F.col("l_orderkey") % 5 != 0, box)).select(
        F.expr("concat('ledger-', l_orderkey div 1000, '.pdf')").alias("pdf_path"),
        F.expr("cast(l_orderkey % 1000 div 4 + 1 as int)").alias("page"),
        F.expr("cast(l_orderkey % 4 as int)").alias("table_no"),
        "bbox", F.explode(F.when(F.col("position") == 0, F.array(head, body)).otherwise(F.array(body))).alias("_r"),
    ).select("pdf_path", "page", "table_no", "_r.row_no", "_r.cells", "bbox")


TABLES_SQL = """item_rows AS (
  SELECT l_orderkey, row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag) AS row_no,
         [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
          CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR),
          CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END] AS cells
  FROM lineitem),
tables AS (
  SELECT concat('ledger-', l_orderkey // 1000, '.pdf') AS pdf_path,
         CAST((l_orderkey % 1000) // 4 + 1 AS INTEGER) AS page, CAST(l_orderkey % 4 AS INTEGER) AS table_no,
         CASE WHEN l_orderkey % 5 <> 0 THEN (l_orderkey % 60) / 2.0 END AS x0,
         CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 7 + 0.25 END AS y0,
         count(*) AS row_count, list(cells ORDER BY row_no) AS all_rows
  FROM item_rows GROUP BY l_orderkey),
records AS (
  SELECT *, printf('tbl-%04d-%02d-%s', page, table_no, sha256(pdf_path)[1:8]) AS table_id,
         concat('Table. Headers: line | part | quantity | price | flag. Example rows: ',
                array_to_string(all_rows[1], ' | '),
                CASE WHEN row_count > 1 THEN concat(' ; ', array_to_string(all_rows[2], ' | ')) ELSE '' END) AS preview_text,
         CASE WHEN x0 IS NULL THEN 'none' ELSE concat(
           CAST(round_even(x0, 0) AS BIGINT), '_', CAST(round_even(y0, 0) AS BIGINT), '_',
           CAST(round_even(x0 + 100.5, 0) AS BIGINT), '_', CAST(round_even(y0 + 50, 0) AS BIGINT)) END AS bbox_sig
  FROM tables)"""

# ---- images --------------------------------------------------------------------------------------


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) as a scan of image files gives them, with what a model would see in each."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 10 == 0, "full").otherwise(F.format_string("img%02d", F.col("p_partkey") % 100))
    suffix = F.when(F.col("p_partkey") % 3 == 1, ".JPG").otherwise(".png")
    return part.select(
        F.concat(F.lit("figures/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"),
                 F.format_string("fig-p%04d-", "p_size"), kind, F.lit("-"), F.col("p_partkey").cast("string"), suffix
                 ).alias("path"),
        F.encode("p_name", "UTF-8").alias("content"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), "p_name", F.lit("  "))).otherwise("").alias("caption"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("ocr_text"),
        F.when(F.col("p_partkey") % 10 == 0, F.expr(
            "named_struct('x0', 0D, 'y0', 0D, 'x1', p_size * 1.5D, 'y1', p_size * 2.5D)")).alias("bbox"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = image_files(spark, sf_dir)
    parsed = image_records(files)
    extra = files.select(F.col("path").alias("png_path"), "caption", "ocr_text", "bbox")
    return parsed.join(extra, "png_path")


def _hashed_paths(rows: DataFrame, path: str) -> DataFrame:
    """(pdf_path, doc_hash) for roles whose files have no bytes in the shared tables."""
    return rows.select(F.expr(path).alias("pdf_path")).distinct().withColumn(
        "doc_hash", content_hash(F.col("pdf_path")))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_paths(table(spark, sf_dir, "lineitem"), "concat('ledger-', l_orderkey div 1000, '.pdf')")


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_paths(table(spark, sf_dir, "part"), "replace(p_brand, '#', '-')")


IMAGES_SQL = """images AS (
  SELECT replace(p_brand, '#', '-') AS pdf_path, p_size AS page,
         concat('fig-', printf('p%04d', p_size), '-',
                CASE WHEN p_partkey % 10 = 0 THEN 'full' ELSE printf('img%02d', p_partkey % 100) END,
                '-', p_partkey) AS image_id,
         CASE WHEN p_partkey % 10 = 0 THEN 'fullpage' ELSE 'embedded' END AS kind,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS INTEGER) END AS image_no,
         CASE WHEN p_partkey % 3 = 1 THEN 'JPG' ELSE 'png' END AS suffix,
         p_name AS content, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS caption,
         CASE WHEN p_partkey % 4 = 0 THEN p_type END AS ocr_text,
         CASE WHEN p_partkey % 10 = 0 THEN concat('0_0_', CAST(round_even(p_size * 1.5, 0) AS BIGINT), '_',
           CAST(round_even(p_size * 2.5, 0) AS BIGINT)) ELSE 'none' END AS bbox_sig,
         CASE WHEN p_partkey % 10 = 0 THEN p_size * 1.5 END AS bbox_x1
  FROM part),
image_rows AS (
  SELECT *, concat('figures/', pdf_path, '/', image_id, '.', suffix) AS png_path,
         CASE WHEN caption <> '' AND ocr_text IS NOT NULL THEN concat(caption, chr(10), 'OCR: ', ocr_text)
              WHEN caption <> '' THEN caption
              WHEN ocr_text IS NOT NULL THEN concat('OCR: ', ocr_text)
              ELSE concat('Image on page ', page, ' of ', pdf_path) END AS body
  FROM images)"""

# ---- stored vectors and questions ----------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with the text and place of the page of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.expr("element_at(array('pdf_text', 'pdf_tables', 'pdf_images'), cast(label % 3 + 1 as int))").alias("collection"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("vec_id").alias("doc_id"), "embedding")
    texts = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat("source", F.lit(".pdf")).alias("pdf_path"))
    return vectors.join(texts, "doc_id", "left").select(
        "collection", "id", "text", "pdf_path", F.col("pdf_path").alias("file_name"),
        F.when(F.col("doc_id") % 11 != 0, F.expr("cast(doc_id % 50 + 1 as int)")).alias("page"), "embedding")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), F.concat(F.lit("Question "), F.col("vec_id").cast("string")).alias("question"),
        F.col("embedding").alias("qvec"))


RECORDS_SQL = """corpus AS (
  SELECT ['pdf_text', 'pdf_tables', 'pdf_images'][label % 3 + 1] AS collection, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS id,
         label % 3 AS ordinal, d.text, d.source || '.pdf' AS file_name,
         CASE WHEN vec_id % 11 <> 0 THEN CAST(vec_id % 50 + 1 AS INTEGER) END AS page,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id)"""


def hits_sql(score: str, k: int = 4, top_n: int = 6) -> str:
    """CTEs ranked and hits: every stored vector asked as a question over all collections."""
    return RECORDS_SQL + f""",
scored AS (
  SELECT q.vec_id AS qid, c.collection, c.ordinal, c.id, {score} AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings) q, corpus c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY score, id) AS rank FROM scored
  QUALIFY rank <= {k}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, ordinal, rank) AS pos FROM ranked
  QUALIFY pos <= {top_n})"""


L2_SQL = "pow(list_distance(q.q, c.v), 2)"
COSINE_SQL = "1 - list_cosine_similarity(q.q, c.v)"
IP_SQL = "1 - list_inner_product(q.q, c.v)"

# ---- questions and answers -----------------------------------------------------------------------


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.expr("conv_id * 1000 + turn").alias("qid"), F.col("text").alias("question"))


def given_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, answer): the assistant turn that directly follows a question."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.expr("conv_id * 1000 + turn - 1").alias("qid"), F.col("text").alias("answer"))


QA_SQL = """questions AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id * 1000 + turn - 1 AS qid, text AS answer FROM conversations WHERE role = 'assistant')"""

# ---- log lines -----------------------------------------------------------------------------------

# The same expressions render a line in Spark and in SQL, {text} being the string type.
_LEVEL = """CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
  WHEN event_type = 'signup' THEN 'WARNING' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END"""
_LOGGER = """CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'app.model' WHEN event_id % 7 = 0
  THEN 'app.search:run:12' WHEN event_type = 'click' THEN 'app.search' ELSE concat('app.worker_', event_id % 13) END"""
_SECONDS = "CAST(CAST(value AS DECIMAL(10,2)) AS {text})"
_MESSAGE = """CASE
  WHEN event_type = 'click' THEN concat('Retrieved ', event_id % 12, ' documents in ', {s}, 's (from ', event_id % 12 + 1, ' total hits)')
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN concat('Generation completed in ', {s}, 's (response: ', event_id % 7000, ' chars)')
  WHEN event_type = 'purchase' AND event_id % 4 = 1 THEN concat('Evaluation completed in ', {s}, 's (judge: 1.00s)')
  WHEN event_type = 'purchase' AND event_id % 4 = 2 THEN concat('Results - Faithfulness: ',
    CAST(CAST(event_id % 101 AS DECIMAL(10,4)) / 100 AS DECIMAL(10,4)), ', Answer Relevancy: ',
    CAST(CAST(event_id % 89 AS DECIMAL(10,4)) / 100 AS DECIMAL(10,4)))
  WHEN event_type = 'purchase' THEN concat('Vision generation completed in ', {s}, 's (response: ', event_id % 300, ' chars)')
  WHEN event_type = 'error' AND event_id % 4 = 0 THEN concat('Generation failed after ', {s}, 's: api call failed')
  WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'Evaluation failed after 1.00s: Connection to database lost'
  WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'Vision call failed after 2.00s: rate limit, schema check failed'
  WHEN event_type = 'error' THEN concat('Disk path refused for user ', user_id % 9, ' while the worker wrote the '
    , 'artifact folder of a long running ingest that had already finished most of its work')
  WHEN event_type = 'signup' THEN concat('Starting text generation (prompt length: ', event_id % 6000, ' chars)')
  ELSE concat('Answer generated in ', {s}, 's (answer length: ', event_id % 900, ' chars)') END"""


def _line(text: str, stamp: str) -> str:
    s = _SECONDS.format(text=text)
    return f"concat({stamp}, ' | ', rpad({_LEVEL}, 8, ' '), ' | ', {_LOGGER}, ' | ', {_MESSAGE.format(s=s)})"


def log_lines_of(events: DataFrame) -> DataFrame:
    """Events as lines of one log file per day; works on a stream of events too."""
    return events.select(
        F.expr("concat('rag_', date_format(ts, 'yyyyMMdd'), '.log')").alias("file"), F.col("event_id").alias("line_no"),
        F.expr(_line("STRING", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')")).alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_of(table(spark, sf_dir, "events"))


LOGS_SQL = f"""lines AS (
  SELECT concat('rag_', strftime(ts, '%Y%m%d'), '.log') AS file, event_id AS line_no,
         {_line("VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS value
  FROM events),
facts AS (
  SELECT *,
    CASE WHEN contains(value, '| DEBUG') THEN 'DEBUG' WHEN contains(value, '| INFO') THEN 'INFO'
         WHEN contains(value, '| WARNING') THEN 'WARNING' WHEN contains(value, '| ERROR') THEN 'ERROR'
         WHEN contains(value, '| CRITICAL') THEN 'CRITICAL' END AS level,
    nullif(regexp_extract(value, '\\| ([a-zA-Z0-9_.]+) \\|', 1), '') AS module,
    strptime(value[1:19], '%Y-%m-%d %H:%M:%S') AS ts,
    CASE WHEN contains(value, 'Generation completed in') THEN 'api'
         WHEN contains(value, 'Retrieved') AND contains(value, 'documents in') THEN 'retrieval'
         WHEN contains(value, 'Evaluation completed in') THEN 'evaluation'
         WHEN contains(value, 'Vision generation') AND contains(value, 'completed in') THEN 'vision'
         WHEN contains(value, 'Answer generated in') THEN 'answer' END AS operation,
    TRY_CAST(nullif(regexp_extract(value, 'in (\\d+\\.\\d+)s', 1), '') AS DOUBLE) AS took,
    TRY_CAST(nullif(regexp_extract(value, 'Faithfulness: (\\d+\\.\\d+)', 1), '') AS DOUBLE) AS faithfulness,
    TRY_CAST(nullif(regexp_extract(value, 'Answer Relevancy: (\\d+\\.\\d+)', 1), '') AS DOUBLE) AS relevancy,
    contains(value, 'ERROR') AS is_error,
    trim(string_split(value, '|')[4]) AS message
  FROM lines),
facts_s AS (SELECT *, CASE WHEN operation IS NOT NULL THEN took END AS seconds FROM facts)"""
