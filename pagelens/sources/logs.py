"""Service log lines, from files or as a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Current logs only: a rotated file has a number after ``.log``.
CURRENT_LOGS = "rag_*.log"


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_name").alias("file"), "value")


def read_logs(spark: SparkSession, path: str, glob: str = CURRENT_LOGS) -> DataFrame:
    """(file, value): one row per line of every current log below ``path``."""
    return _lines(spark.read.option("pathGlobFilter", glob).text(path))


def stream_logs(spark: SparkSession, path: str, glob: str = CURRENT_LOGS) -> DataFrame:
    """The same rows as an unbounded source: lines of files as they arrive in ``path``."""
    return _lines(spark.readStream.option("pathGlobFilter", glob).text(path))


def read_latest_log(spark: SparkSession, path: str, glob: str = CURRENT_LOGS) -> DataFrame:
    """Lines of the current log with the greatest name. Names come from the file listing alone, and
    only the chosen file is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    newest = listed.agg(F.max(F.element_at(F.split("path", "/"), -1))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no {glob} below {path}")
    return read_logs(spark, path, newest)


def latest_log(lines: DataFrame) -> DataFrame:
    """Lines of the log with the greatest file name. The name is one pre-aggregated value."""
    newest = lines.agg(F.max("file").alias("file"))
    return lines.join(F.broadcast(newest), "file", "left_semi")
