"""Merged sketches against exact ranks; heaviest values against a plain count; closed windows and late lines."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelens.operators import heavy
from pagelens.operators.heavy import Summary, most_frequent, summaries
from pagelens.operators.sketches import RANK_ERROR, SketchStore
from pagelens.session import materialize
from pagelens.streaming import monitors as M


def close(values, estimate, share):
    n = len(values)
    return sum(v < estimate for v in values) <= (share + RANK_ERROR) * n and sum(v <= estimate for v in values) >= (share - RANK_ERROR) * n


def test_sketches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2025-10-{d:02d}", m, rng.lognormvariate(d / 5, 1) if m == "a" else float(rng.randint(0, 3))) for d in range(1, 13) for m in "ab" for _ in range(3000)]
    rows += [("2025-10-01", "a", None), ("2025-10-01", "a", float("nan")), (None, "a", 1e9), ("2025-10-03", "lone", 7.5)]
    schema = "day string, metric string, value double"
    store = SketchStore(spark, str(tmp_path / "sketches"))
    assert store.over().count() == 0
    table = spark.createDataFrame(rows, schema).repartition(5)
    store.add(table.where("day <= '2025-10-06'"))
    store.add(table.where("day >= '2025-10-06'"))  # a day written again replaces itself
    for first, last in ((None, None), ("2025-10-04", "2025-10-09")):
        for r in store.over(first, last).collect():
            values = [v for d, m, v in rows if m == r.metric and d and v is not None and v == v and (not first or first <= d <= last)]
            assert (r.n, r.min_value, r.max_value) == (len(values), min(values), max(values))
            assert r.avg_value == pytest.approx(sum(values) / len(values))
            assert close(values, r.median_value, 0.5) and close(values, r.p95_value, 0.95)
    assert {r.metric for r in store.over("2025-10-03", "2025-10-03").collect()} == {"a", "b", "lone"}


def test_span_reads_its_days_only(spark, tmp_path, plan_of):
    store = SketchStore(spark, str(tmp_path / "sketches"))
    store.add(spark.createDataFrame([(f"2025-10-{d:02d}", "a", 1.0) for d in range(1, 9)], "day string, metric string, value double"))
    scan = next(line for line in plan_of(store.over("2025-10-02", "2025-10-03")).splitlines() if "PartitionFilters" in line)
    assert "day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]


def top(values, n):
    return sorted(Counter(values).items(), key=lambda e: (-e[1], e[0]))[:n]


@pytest.mark.parametrize("capacity", [3, 20, 10_000])
@pytest.mark.parametrize("kind", ["skewed", "flat"])
def test_most_frequent(spark, capacity, kind):
    """Exact whatever the capacity, also where a flat distribution leaves the summaries uncertain."""
    rng = random.Random(capacity)
    values = [f"v{min(int(rng.expovariate(.3 if kind == 'skewed' else .002)), 900)}" for _ in range(6000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "message string").repartition(6)
    got = [tuple(r) for r in most_frequent(df, "message", 5, capacity).collect()]
    assert got == top([v for v in values if v is not None], 5)
    stored = materialize(summaries(df, "message", capacity), "summaries")
    assert [tuple(r) for r in most_frequent(df, "message", 5, summed=stored).collect()] == got
    assert most_frequent(df.limit(0), "message", 5).count() == 0
    assert most_frequent(df, "message", 2000, capacity).count() == len(set(values) - {None})


def test_summary_is_bounded():
    """Counters never exceed the capacity by more than a batch, and no count is off by more than was missed."""
    rng = random.Random(2)
    values = [f"v{int(rng.expovariate(.01))}" for _ in range(20_000)]
    summary = Summary(50)
    for i in range(0, len(values), 500):
        summary.add(pa.array(values[i:i + 500]))
        assert len(summary.counts) <= 50
    true = Counter(values)
    assert summary.missed <= len(values) / 51
    assert all(true[v] - summary.missed <= n <= true[v] for v, n in summary.counts.items())
    assert all(n <= summary.missed for v, n in true.items() if v not in summary.counts)


def test_candidates_are_few(spark):
    values = [f"hot{i % 3}" for i in range(3000)] + [f"rare{i}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "message string").repartition(3)
    chosen = heavy.certain_candidates(summaries(df, "message", 40), 3)
    assert {r.value for r in chosen.collect()} == {"hot0", "hot1", "hot2"}


def log(stamp, level="INFO"):
    return f"{stamp} | {level:<8} | app.x | line"


def test_closed_windows(spark, tmp_path):
    """Late lines are counted apart, open windows are not reported, and a window is written once."""
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def feed(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").parquet(folder)
        rows = M.run_closed_windows(spark.readStream.schema("value string").parquet(folder), out=out, progress=progress)
        return {(r.window_start.hour, r.n_lines, r.n_errors, r.n_late) for r in rows.collect()}

    day = "2025-10-19"
    assert feed(log(f"{day} 08:00:00"), log(f"{day} 08:30:00", "ERROR"), log(f"{day} 10:20:00"), "no time") == {(8, 2, 1, 0)}
    # 08:59 is behind the watermark (10:10), 10:05 is not; hour 9 was never seen in time.
    assert feed(log(f"{day} 08:59:00"), log(f"{day} 10:05:00"), log(f"{day} 09:59:59", "ERROR"), log(f"{day} 11:15:00")) == {
        (8, 2, 1, 1), (9, 0, 0, 1), (10, 2, 0, 0)}
    assert feed(log(f"{day} 08:01:00")) == {(8, 2, 1, 2), (9, 0, 0, 1), (10, 2, 0, 0)}
    assert spark.read.parquet(f"{out}/closed").groupBy("window_start").count().where(F.col("count") > 1).count() == 0
