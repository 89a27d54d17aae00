"""Count, mean, exact median, extremes of many numeric series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.operators.numbering import running_total

RANGES = 1024


def series_stats(
    values: DataFrame, by: Sequence[str] = ("metric",), value: str = "value", flag: Column | None = None,
) -> DataFrame:
    """Per series: n, avg_value, median_value, min_value, max_value and n_flagged (rows where ``flag``,
    an expression over the series and value columns, holds).

    Equal values are counted before any shuffle, and each series' range is cut into RANGES equal parts: counts
    per part are summed up first and values are ordered inside their part only, so a series of very many distinct
    values is spread over many tasks. The median is exact. A series of nulls only has its count.
    """
    distinct = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    spans = values.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(F.lit(1)).alias("_total"))
    placed = distinct.join(spans, list(by))
    # Never falls as the value rises; NaN is the greatest double and goes last.
    share = (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
    part = F.when(F.isnan(F.col(value).cast("double")), RANGES + 1).when(F.col(value).isNotNull(), F.coalesce(
        F.least(F.floor(F.nanvl(share.cast("double"), F.lit(0.0)) * RANGES), F.lit(RANGES)), F.lit(0))).cast("int")
    before = running_total(placed, by, [value], part, F.col("_n"), "_before")
    ranked = before.withColumn("_to", F.col("_before") + F.col("_n"))

    def holds(rank: str) -> Column:
        return F.max(F.when(F.expr(f"_to - _n < {rank} and {rank} <= _to"), F.col(value)))

    flagged = F.when(flag, F.col("_n")).otherwise(0) if flag is not None else F.lit(0)
    return ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("avg_value"),
        ((holds("(_total + 1) div 2") + holds("_total div 2 + 1")) / 2).alias("median_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.sum(flagged).cast("bigint").alias("n_flagged"),
    )
