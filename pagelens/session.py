"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Vectors and page texts are wide: smaller Arrow batches keep a Python worker's memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def build_session(app: str = "pagelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """The settings that a session built elsewhere needs as well. Log times carry no zone; reading them as
    UTC keeps results equal on every cluster. Batches for Python hold whole texts: fewer rows at a time."""
    for key in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(key, DEFAULTS[key])
    return spark


_own_root: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of its own; on a cluster its
    executors would write to their own disks, so there the setting is asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, tempfile.mkdtemp(prefix="pagelens-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to a folder of its own. Results that still read from it must have been
    used; a shared ``spark.checkpoint.dir`` is its owner's to clear."""
    root = _own_root.pop(spark.sparkContext.applicationId, None)
    if root:
        shutil.rmtree(root, ignore_errors=True)


def spread(df: DataFrame, tasks: int | None = None, small_mb: int = 16) -> DataFrame:
    """Rows dealt over all cores, for slow Python behind it. Input that Spark estimates at more than
    ``small_mb`` for each core comes in enough partitions already and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if tasks is None:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if estimate > cores * small_mb * 2 ** 20:
            return df
    return df.repartition(tasks or cores)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go as soon as it is written. Otherwise they stay until the driver happens to
    collect its garbage, and a chain of writes fills the disks with all of them."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed once, lineage cut,
    and still there when an executor is lost."""
    path = scratch_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
