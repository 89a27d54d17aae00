"""Streams give what the same work gives in batch."""

from __future__ import annotations

from conftest import service_log
from pyspark.sql import functions as F

from pagelens.plans.ingest import text_records
from pagelens.operators.embedding import hashed_words
from pagelens.sources.logs import read_logs, stream_logs
from pagelens.sources.store import RecordStore
from pagelens.streaming import monitors as M
from pagelens.streaming.ingest import run_ingest

POOR = "2025-10-19 15:00:00 | INFO     | app.quality | Results - Faithfulness: 0.2000, Answer Relevancy: 0.6999"


def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = service_log()
    (folder / "rag_20251019.log").write_text("\n".join(lines[:61]) + "\n")
    (folder / "rag_20251020.log").write_text("\n".join(lines[61:] + [POOR]) + "\n")
    return str(folder)


def test_monitors(spark, tmp_path):
    path = logs(tmp_path)
    for monitor, n in ((M.error_alerts, 1), (M.slow_alerts, 4), (M.quality_alerts, 2)):
        live = M.run_append(monitor(stream_logs(spark, path)), str(tmp_path / monitor.__name__), str(tmp_path / f"p-{monitor.__name__}"))
        batch = monitor(read_logs(spark, path))
        assert sorted(r.value for r in live.collect()) == sorted(r.value for r in batch.collect()) and live.count() == n
    assert {(r.metric, r.score) for r in M.quality_alerts(read_logs(spark, path)).collect()} == {("faithfulness", 0.2), ("relevancy", 0.6999)}


def test_restart_reads_only_what_is_new(spark, tmp_path):
    path, out, progress = logs(tmp_path), str(tmp_path / "out"), str(tmp_path / "progress")
    assert M.run_append(M.error_alerts(stream_logs(spark, path)), out, progress).count() == 1
    assert M.run_append(M.error_alerts(stream_logs(spark, path)), out, progress).count() == 1
    (tmp_path / "logs" / "rag_20251021.log").write_text("2025-10-21 00:00:00 | ERROR    | app.x | late\n")
    assert M.run_append(M.error_alerts(stream_logs(spark, path)), out, progress).count() == 2


def test_windows(spark, tmp_path):
    path = logs(tmp_path)
    one_by_one = stream_logs(spark, path)
    for watermark in (None, "10 minutes"):
        live = M.run_windows(M.windowed_counts(one_by_one, watermark=watermark))
        batch = M.windowed_counts(read_logs(spark, path), watermark=None)
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    assert {(r.window_start.hour, r.n_lines, r.n_errors) for r in live.collect()} == {(12, 61, 1), (14, 17, 0), (15, 1, 0)}


def test_windows_over_several_micro_batches(spark, tmp_path):
    path, out, progress = logs(tmp_path), str(tmp_path / "out"), str(tmp_path / "progress")
    M.run_windows(M.windowed_counts(stream_logs(spark, path), watermark=None), out, progress)
    (tmp_path / "logs" / "rag_20251021.log").write_text("2025-10-19 12:00:00 | ERROR    | app.x | late\n")
    live = M.run_windows(M.windowed_counts(stream_logs(spark, path), watermark=None), out, progress)
    assert {(r.window_start.hour, r.n_lines, r.n_errors) for r in live.collect()} == {(12, 62, 2), (14, 17, 0), (15, 1, 0)}


def test_incremental_ingest(spark, tmp_path):
    """Three files one by one: copies inside a batch and of earlier batches are stored once."""
    source = str(tmp_path / "in")
    for part, rows in enumerate([[("a", "x"), ("b", "x"), ("c", "y")], [("d", "y"), ("e", "z")], [("f", "x"), ("g", "w")]]):
        spark.createDataFrame(rows, "pdf_path string, text string").coalesce(1).write.mode("append").parquet(source)
    files = spark.readStream.schema("pdf_path string, text string").option("maxFilesPerTrigger", 1).parquet(source).withColumn(
        "doc_hash", F.sha2("text", 256))

    def to_records(fresh):
        pages = fresh.select("pdf_path", F.lit(0).alias("page0"), F.lit("1").alias("page_label"), "text")
        return text_records(pages, fresh.select("pdf_path", "doc_hash")).withColumn("embedding", hashed_words()(F.col("text")))

    store = run_ingest(files, RecordStore(spark, str(tmp_path / "store")), to_records, checkpoint=str(tmp_path / "progress"))
    rows = store.all_batches().collect()
    assert sorted(r.text for r in rows) == ["w", "x", "y", "z"]
    assert {r.batch for r in rows} == {0, 1, 2} or len({r.batch for r in rows}) > 1
