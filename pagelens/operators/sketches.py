"""Quantiles of long series from sketches that are stored once and merged ever after.

``operators/series.py`` is exact and orders the counted values. Over years of logs that is more than a report needs: here each
period (a day) is reduced once to a KLL sketch of a few kilobytes, and any span of periods is a merge of their sketches. A quantile is
then off by less than RANK_ERROR of the rank, whatever the number of values; counts, sums and extremes stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Size of a sketch, and the error of a rank that it keeps to (as a share of all values, with wide margin).
SIZE = 800
RANK_ERROR = 0.01


def quantile_sketches(values: DataFrame, by: Sequence[str], value: str = "value", size: int = SIZE) -> DataFrame:
    """One row per group: n, total, min_value, max_value and ``sketch``, built in every task before the shuffle.
    Null and NaN values are not counted."""
    number = F.col(value).cast("double")
    return values.where(number.isNotNull() & ~F.isnan(number)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"), F.min(number).alias("min_value"), F.max(number).alias("max_value"),
        F.kll_sketch_agg_double(number, F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantile(share: float) -> Column:
    """Of the column ``sketch``: a value whose rank is within RANK_ERROR of ``share``."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


class SketchStore:
    """Sketches below ``path``, one folder for each period. A period written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, period: str = "day", series: str = "metric"):
        self.spark, self.path, self.period, self.series = spark, path.rstrip("/"), period, series

    def add(self, values: DataFrame, value: str = "value") -> None:
        """Store the periods that occur in ``values``, which must hold all values of each of them."""
        made = quantile_sketches(values.where(F.col(self.period).isNotNull()), (self.period, self.series), value)
        made.repartition(self.period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.period).parquet(self.path)

    def read(self) -> DataFrame:
        schema = f"{self.series} string, n bigint, total double, min_value double, max_value double, sketch binary, {self.period} string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def over(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Per series over the periods from ``first`` to ``last``: n, avg_value, median_value, p95_value, min_value, max_value and the
        merged sketch. Only the folders of these periods are read."""
        chosen = self.read()
        if first is not None:
            chosen = chosen.where(F.col(self.period) >= first)
        if last is not None:
            chosen = chosen.where(F.col(self.period) <= last)
        return merged(chosen, (self.series,)).select(
            self.series, "n", (F.col("total") / F.col("n")).alias("avg_value"), quantile(0.5).alias("median_value"),
            quantile(0.95).alias("p95_value"), "min_value", "max_value", "sketch")
