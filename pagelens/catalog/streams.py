"""Monitors and ingest over streams of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.catalog import roles as R
from pagelens.catalog.registry import query, table
from pagelens.functions import logs as L
from pagelens.operators.embedding import hashed_words
from pagelens.operators.heavy import most_frequent, summaries
from pagelens.plans.ingest import text_records
from pagelens.session import scratch_path
from pagelens.sources.tail import tail_logs, write_logs
from pagelens.sources.store import RecordStore
from pagelens.streaming import monitors as M
from pagelens.streaming.ingest import run_ingest

W = f"WITH {R.LOGS_SQL}"


def _stream(spark, sf_dir, name):
    # As a pattern the path may be one file or a folder of files.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _lines(spark, sf_dir):
    return R.log_lines_of(_stream(spark, sf_dir, "events"))


@query("stream_errors", W + " SELECT line_no, value, true AS seen FROM facts WHERE is_error")
def stream_errors(spark, sf_dir):
    return M.run_append(M.error_alerts(_lines(spark, sf_dir))).select(
        "line_no", "value", F.col("detected_at").isNotNull().alias("seen"))


@query("stream_slow", W + " SELECT line_no, took FROM facts WHERE contains(value, 'completed in') AND took > 5.0")
def stream_slow(spark, sf_dir):
    return M.run_append(M.slow_alerts(_lines(spark, sf_dir))).select("line_no", "took")


@query("stream_quality", W + """ SELECT line_no, 'faithfulness' AS metric, faithfulness AS score FROM facts WHERE faithfulness < 0.7
UNION ALL SELECT line_no, 'relevancy', relevancy FROM facts WHERE relevancy < 0.7""")
def stream_quality(spark, sf_dir):
    return M.run_append(M.quality_alerts(_lines(spark, sf_dir))).select("line_no", "metric", "score")


@query("stream_hourly", W + """ SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n_lines,
  count(*) FILTER (is_error) AS n_errors FROM facts GROUP BY 1""")
def stream_hourly(spark, sf_dir):
    # No watermark: a backfill must count every line, and hourly state stays small.
    return M.run_windows(M.windowed_counts(_lines(spark, sf_dir), watermark=None)).select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n_lines", "n_errors")


# Hourly counts with bounded state. The second file brings the last day and every twentieth line of the days before: those are
# behind the watermark by then, are not counted, and are reported apart.
@query("stream_hourly_late", W + """, told AS (SELECT ts, is_error, date_trunc('hour', ts) AS w,
  CASE WHEN line_no % 20 = 0 OR date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM facts) THEN 2 ELSE 1 END AS part FROM facts WHERE ts IS NOT NULL),
marks AS (SELECT max(ts) FILTER (part = 1) - INTERVAL 10 MINUTE AS first, max(ts) - INTERVAL 10 MINUTE AS last FROM told),
judged AS (SELECT *, part = 2 AND w + INTERVAL 1 HOUR <= first AS late FROM told, marks)
SELECT strftime(w, '%Y-%m-%d %H') AS hour, count(*) FILTER (NOT late) AS n_lines, count(*) FILTER (is_error AND NOT late) AS n_errors,
  count(*) FILTER (late) AS n_late FROM judged WHERE w + INTERVAL 1 HOUR <= last GROUP BY 1""")
def stream_hourly_late(spark, sf_dir):
    lines = R.log_lines(spark, sf_dir).withColumn("day", F.substring("value", 1, 10))
    last = lines.agg(F.max("day")).first()[0]
    second = (F.col("line_no") % 20 == 0) | (F.col("day") == last)
    folder, out, progress = (scratch_path(spark, name) for name in ("late-lines", "windows", "progress"))
    for part in (~second, second):
        lines.where(part).select("value").write.mode("append").parquet(folder)
        closed = M.run_closed_windows(spark.readStream.schema("value string").parquet(folder), out=out, progress=progress)
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n_lines", "n_errors", "n_late")


# The heaviest error messages of a stream: each micro-batch leaves summaries of its tasks, and what can be among the first is
# counted exactly in the end.
@query("stream_heavy_errors", W + " SELECT message, count(*) AS n FROM facts WHERE is_error GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def stream_heavy_errors(spark, sf_dir):
    def messages(lines):
        return lines.where(L.is_error(F.col("value"))).select(L.error_text(F.col("value")).alias("message"))

    stored = M.run_append(summaries(messages(_lines(spark, sf_dir)), "message"))
    return most_frequent(messages(R.log_lines(spark, sf_dir)), "message", 10, summed=stored).withColumnRenamed("value", "message")


@query("stream_ingest", """SELECT sha256(text) AS doc_hash, concat(lpad(CAST(min(doc_id) AS VARCHAR), 12, '0'), '.pdf') AS pdf_path FROM documents GROUP BY 1""")
def stream_ingest(spark, sf_dir):
    files = _stream(spark, sf_dir, "documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf")).alias("pdf_path"), "text",
        F.sha2("text", 256).alias("doc_hash"))

    def to_records(fresh):
        pages = fresh.select("pdf_path", F.lit(0).alias("page0"), F.lit("1").alias("page_label"), "text")
        return text_records(pages, fresh.select("pdf_path", "doc_hash")).withColumn(
            "embedding", hashed_words()(F.col("text")))

    store = run_ingest(files, RecordStore(spark, scratch_path(spark, "store")), to_records)
    return store.current().select("doc_hash", "pdf_path").distinct()


# Logs followed while they grow and rotate: read after eight hours of each day, then with the whole day, whose last eight
# hours went to a new file, then once more with nothing new.
@query("stream_tail", f"""WITH {R.LOGS_SQL}, told AS (SELECT file, line_no, value, hour(ts) AS h FROM facts)
SELECT file, CAST(coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file, h < 16 ORDER BY h, line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, value FROM told""")
def stream_tail(spark, sf_dir):
    lines = R.log_lines(spark, sf_dir).withColumn("h", F.substring("value", 12, 2).cast("int"))
    ordered = lines.withColumn("line_no", F.col("h") * F.lit(10 ** 15) + F.col("line_no"))
    rotates = ordered.groupBy("file").agg((F.max("h") >= 16).alias("rotates"))
    folder, out, progress = (scratch_path(spark, name) for name in ("live-logs", "alerts", "progress"))

    def follow():
        return M.run_append(tail_logs(spark, folder), out, progress)

    write_logs(ordered.where("h < 8").select("file", "line_no", "value"), folder)
    follow()
    # What was there goes on under the rotated name, the rest of the day under the current one.
    old = F.when(F.col("rotates"), F.concat("file", F.lit(".1"))).otherwise(F.col("file"))
    write_logs(ordered.where("h < 16").join(rotates, "file").select(old.alias("file"), "line_no", "value"), folder)
    write_logs(ordered.where("h >= 16").select("file", "line_no", "value"), folder)
    follow()
    return follow()
