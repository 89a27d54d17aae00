"""The most frequent values of a column too varied to count in full.

Each task keeps a summary of CAPACITY counters: values it has seen, with counts that are too small by at most the task's
``missed``. When there are more values than counters, the count of the first one without a place is taken off all and the rest
goes, which is the mergeable form of space-saving summaries. Merged, the summaries hold every value that occurs more often than all
misses together. Those that can be among the first are then counted exactly, in one more pass, so counts and order are exact.

If the last of the first n does not exceed the misses (a flat distribution), a value outside the summaries might belong there:
then everything is counted, by a plain aggregate. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagelens.session import materialize

CAPACITY = 10_000
SCHEMA = "value string, n bigint, missed bigint"


class Summary:
    """Counters of one task. ``missed`` bounds how much any count is too small, and the count of what is not held."""

    def __init__(self, capacity: int):
        self.capacity, self.missed = capacity, 0
        self.counts: dict[str, int] = {}

    def add(self, values: pa.Array) -> None:
        for entry in pc.value_counts(values.drop_null()).to_pylist():
            self.counts[entry["values"]] = self.counts.get(entry["values"], 0) + entry["counts"]
        if len(self.counts) > self.capacity:
            n = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            off = int(np.partition(n, -self.capacity - 1)[-self.capacity - 1])
            self.counts = {v: c - off for v, c in self.counts.items() if c > off}
            self.missed += off


def summaries(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(value, n, missed): the counters of every task, and one row without value for its misses. A projection without state, so it
    serves streams as well: stored summaries of micro-batches are merged like those of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            summary.add(batch.column(0))
        values, counts = list(summary.counts), list(summary.counts.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*values, None], pa.string()), pa.array([*counts, 0], pa.int64()),
             pa.array([0] * len(values) + [summary.missed], pa.int64())], ["value", "n", "missed"])

    return df.select(F.col(column).cast("string").alias("value")).mapInArrow(run, SCHEMA)


def certain_candidates(summed: DataFrame, first: int) -> DataFrame | None:
    """(value) of what can be among the ``first`` most frequent, or None if something outside the summaries could be."""
    merged = materialize(summed.groupBy("value").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed")), "summaries")
    missed = merged.agg(F.coalesce(F.sum("missed"), F.lit(0))).first()[0]
    held = merged.where("value is not null")
    leaders = held.orderBy(F.desc("n")).limit(first).collect()  # ``first`` rows
    last = leaders[-1]["n"] if len(leaders) == first else 0
    if missed and last <= missed:
        return None
    # What falls short of the last leader even with all misses added is out.
    return held.where(F.col("n") + missed >= last).select("value")


def most_frequent(
    df: DataFrame, column: str, first: int, capacity: int = CAPACITY, summed: DataFrame | None = None,
) -> DataFrame:
    """(value, n): the ``first`` most frequent values with exact counts, ties by value; null does not count. ``summed`` are stored
    summaries of the same rows, if there are any."""
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
    chosen = certain_candidates(summaries(df, column, capacity) if summed is None else summed, first)
    if chosen is not None:
        values = values.join(chosen, "value", "left_semi")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(first)
