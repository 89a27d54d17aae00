"""Live monitors over a stream of log lines, and how to run one to a parquet sink.

The monitors are plain projections, so the same function serves ``read_logs`` and ``stream_logs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pagelens.functions import logs as L
from pagelens.session import scratch_path


def error_alerts(lines: DataFrame) -> DataFrame:
    """Every line that contains ERROR, with the time it was seen."""
    return lines.where(L.is_error(F.col("value"))).withColumn("detected_at", F.current_timestamp())


def slow_alerts(lines: DataFrame, limit_seconds: float = L.ALERT_SECONDS) -> DataFrame:
    return (
        lines.where(F.contains("value", F.lit("completed in")))
        .withColumn("took", L.seconds(F.col("value"))).where(F.col("took") > limit_seconds)
    )


def quality_alerts(lines: DataFrame, limit: float = L.LOW_SCORE) -> DataFrame:
    """One alert per low score: a line with both scores low gives two."""
    pairs = F.array(
        F.struct(F.lit("faithfulness").alias("metric"), L.faithfulness(F.col("value")).alias("score")),
        F.struct(F.lit("relevancy").alias("metric"), L.relevancy(F.col("value")).alias("score")))
    low = F.filter(pairs, lambda p: p["score"] < limit)
    return lines.select("*", F.explode(low).alias("_p")).select(*lines.columns, "_p.metric", "_p.score")


def error_lines(lines: DataFrame) -> DataFrame:
    """What the errors-only log holds: lines of level ERROR or above."""
    return lines.where(L.is_error(F.col("value"), compat=False))


def windowed_counts(lines: DataFrame, width: str = "1 hour", watermark: str | None = "10 minutes") -> DataFrame:
    """Lines and errors per time window. With a watermark, state of old windows is dropped and later
    lines for them are not counted; without one no line is lost and state is one row per window."""
    timed = lines.select(
        L.time_of(F.col("value")), L.is_error(F.col("value")).alias("is_error")).where(F.col("ts").isNotNull())
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_error").alias("n_errors"),
    ).select(F.col("w.start").alias("window_start"), "n_lines", "n_errors")


def run_closed_windows(
    lines: DataFrame, width: str = "1 hour", watermark: str = "10 minutes", out: str | None = None, progress: str | None = None,
) -> DataFrame:
    """Process all input that is there with bounded state: (window_start, n_lines, n_errors, n_late) of every closed window.

    A window is closed once the watermark has passed its end; its state is dropped then, its counts are final and written once. Lines that
    come for it later are not in ``n_lines`` but in ``n_late``: a second query without state counts all lines of each
    micro-batch by window, and late is what the first one has not counted. Both go on from their checkpoints below ``progress``.
    """
    spark = lines.sparkSession
    out = out or scratch_path(spark, "windows")
    progress = progress or scratch_path(spark, "progress")
    closed = run_append(windowed_counts(lines, width, watermark), f"{out}/closed", f"{progress}/closed")
    seen = F.window("ts", width).alias("w")

    def count(batch: DataFrame, batch_id: int) -> None:
        timed = batch.select(L.time_of(F.col("value"))).where(F.col("ts").isNotNull())
        timed.groupBy(seen).agg(F.count(F.lit(1)).alias("n_seen"), F.max("ts").alias("newest")).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_seen", "newest",
        ).write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    query = lines.writeStream.foreachBatch(count).trigger(availableNow=True).option("checkpointLocation", f"{progress}/seen").start()
    query.awaitTermination()
    every = spark.read.schema("window_start timestamp, window_end timestamp, n_seen bigint, newest timestamp, batch bigint").parquet(f"{out}/seen")
    newest = every.agg(F.unix_micros(F.max("newest"))).first()[0]  # one number; without lines there is none, and no window
    passed = F.timestamp_micros(F.lit(newest).cast("bigint")) - F.expr(f"interval {watermark}")
    totals = every.groupBy("window_start", "window_end").agg(F.sum("n_seen").alias("n_seen")).where(F.col("window_end") <= passed)
    return totals.join(closed, "window_start", "left").select(
        "window_start", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        (F.col("n_seen") - F.coalesce("n_lines", F.lit(0))).alias("n_late"))


def run_append(alerts: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all input that is there, append alerts to parquet, and read them back."""
    spark = alerts.sparkSession
    out = out or scratch_path(spark, "alerts")
    checkpoint = checkpoint or scratch_path(spark, "progress")
    query = (
        alerts.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(alerts.schema).parquet(out)


def run_windows(counts: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all input that is there in update mode. Every micro-batch writes the windows it touched
    to a folder of its own, so a repeated batch replaces itself; the newest row of a window counts."""
    spark = counts.sparkSession
    out = out or scratch_path(spark, "windows")
    checkpoint = checkpoint or scratch_path(spark, "progress")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    values = [c for c in counts.columns if c != "window_start"]
    written = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return written.groupBy("window_start").agg(*[F.max_by(c, "batch").alias(c) for c in values])
