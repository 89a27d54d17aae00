"""Running positions inside a group that stay parallel when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one group that a single task may order. A group with more is spread over several tasks.
BUCKET_ROWS = 262_144


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, weight: Column, name: str,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the group.

    A plain window over ``group`` would sort a whole group in one task. Here ``bucket`` (an
    expression that never falls as ``order`` rises, e.g. ``page div 10000``) splits each group:
    totals per bucket are pre-aggregated and summed up over the few buckets, and the windows over
    rows run per bucket. Group and bucket travel as one struct, in which nulls equal each other: rows
    whose group, order or bucket is null are numbered like any others (nulls first).
    """
    key = F.struct(*group, bucket.alias("_bucket"))
    rows = df.withColumn("_key", key).withColumn("_weight", weight.cast("bigint"))
    whole = F.struct(*[F.col("_key").getField(g) for g in group])
    earlier_buckets = Window.partitionBy(whole).orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_key").agg(F.sum("_weight").alias("_sum"))
        .select("_key", F.coalesce(F.sum("_sum").over(earlier_buckets), F.lit(0)).alias("_offset"))
    )
    earlier_rows = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_weight").over(earlier_rows), F.lit(0)))
    return (
        local.join(offsets, "_key")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .select(*df.columns, name)
    )


def running_number(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, name: str = "position",
) -> DataFrame:
    """0-based position of each row in its group; ``order`` must be unique inside a group."""
    return running_total(df, group, order, bucket, F.lit(1), name)
