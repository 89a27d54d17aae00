"""Aggregations over log lines. Every function takes the columns of ``log_facts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagelens.functions import logs as L
from pagelens.operators.series import series_stats

SCORES = ("faithfulness", "relevancy")

# Service targets. (metric, lower is better, target edge, critical edge)
TARGETS = (
    ("api", True, 3.0, 5.0),
    ("retrieval", True, 1.5, 3.0),
    ("evaluation", True, 15.0, 25.0),
    ("faithfulness", False, 0.8, 0.6),
    ("relevancy", False, 0.8, 0.6),
    ("error_rate", True, 1.0, 5.0),
)


def _rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def level_counts(facts: DataFrame) -> DataFrame:
    """(level, n, pct) for all five levels, zeros included. Lines without a level are not counted.
    One aggregate row, then unfolded."""
    one = facts.agg(*[F.count_if(F.col("level") == name).alias(name) for name in L.LEVELS])
    total = F.nullif(sum((F.col(name) for name in L.LEVELS), F.lit(0)), F.lit(0))
    cells = F.array(*[F.struct(
        F.lit(name).alias("level"), F.col(name).alias("n"),
        F.coalesce(F.col(name) * 100 / total, F.lit(0.0)).alias("pct")) for name in L.LEVELS])
    return one.select(F.explode(cells).alias("c")).select("c.level", "c.n", "c.pct")


def module_counts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("module").isNotNull()).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def top_modules(facts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        module_counts(facts).orderBy(F.desc("n"), "module").limit(limit)
        .select(L.module_short(F.col("module")).alias("module"), "n")
    )


def measurements(facts: DataFrame, *keep: str) -> DataFrame:
    """Long (metric, value) and ``keep``: seconds per operation and both scores, in one pass over the lines."""
    pairs = F.array(
        F.struct(F.col("operation").alias("metric"), F.col("seconds").alias("value")),
        *[F.struct(F.lit(s).alias("metric"), F.col(s).alias("value")) for s in SCORES],
    )
    return (
        facts.select(*keep, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
        .select(*keep, "p.metric", "p.value").where(F.col("metric").isNotNull())
    )


def flagged_value() -> Column:
    """Over (metric, value): a slow operation, or a low score."""
    flag = F.col("metric").isin(*SCORES) & (F.col("value") < L.LOW_SCORE)
    for metric, limit in L.SLOW_SECONDS.items():
        flag = flag | ((F.col("metric") == metric) & (F.col("value") > limit))
    return flag


def measurement_stats(facts: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Statistics of each metric; one that never occurs has a row with ``n = 0`` and nulls.

    ``n_flagged`` counts slow operations (above the metric's limit) or low scores (below 0.7).
    """
    long = measurements(facts).where(F.col("metric").isin(*metrics))
    names = F.broadcast(_rows(facts.sparkSession, [(m,) for m in metrics], "metric string"))  # fixed, few rows
    return names.join(series_stats(long, flag=flagged_value()), "metric", "left").select(
        "metric", F.coalesce("n", F.lit(0)).alias("n"), "avg_value", "median_value", "min_value", "max_value",
        F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"),
    )


def timing_stats(facts: DataFrame) -> DataFrame:
    return measurement_stats(facts, ("api", "retrieval", "evaluation"))


def score_stats(facts: DataFrame) -> DataFrame:
    """Score statistics with the quality band of the mean."""
    return measurement_stats(facts, SCORES).withColumn("band", L.quality_band(F.col("avg_value")))


def error_rate(facts: DataFrame) -> DataFrame:
    """One row: error lines, lines with a level, percentage and band."""
    one = facts.agg(
        F.count_if(F.col("is_error")).alias("errors"),
        F.count_if(F.col("level").isin(*L.LEVELS)).alias("total"),
    )
    rate = F.coalesce(F.col("errors") * 100 / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return one.select("errors", "total", rate.alias("rate_pct"),
                      L.error_rate_band(F.col("errors"), rate).alias("band"))


def recent_errors(facts: DataFrame, limit: int = 5, *, tie_break: str | None = None) -> DataFrame:
    """The last errors with their shortened message; a sort with a limit, not a window."""
    newest = [F.desc_nulls_last("ts"), F.desc("file"), *([F.desc(tie_break)] if tie_break else []), F.desc("value")]
    return (
        facts.where("is_error").orderBy(*newest).limit(limit)
        .select("ts", "file", L.error_short(F.col("value")).alias("message"))
    )


def error_messages(facts: DataFrame, limit: int | None = 10) -> DataFrame:
    counted = (
        facts.where("is_error").groupBy(L.error_text(F.col("value")).alias("message"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.orderBy(F.desc("n"), "message").limit(limit) if limit else counted


def errors_by_module(facts: DataFrame) -> DataFrame:
    """Errors per logger: the third ``|`` field."""
    logger = F.trim(F.get(F.split("value", r"\|"), F.lit(2)))
    return (
        facts.where("is_error").groupBy(F.coalesce(logger, F.col("value")).alias("module"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def errors_hourly(facts: DataFrame) -> DataFrame:
    return (
        facts.where("is_error").groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def errors_by_category(facts: DataFrame, exclusive: bool = True) -> DataFrame:
    line = F.col("value")
    category = L.error_category(line) if exclusive else F.explode(L.error_categories(line))
    return (
        facts.where("is_error").select(category.alias("category")).groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def slow_operations(facts: DataFrame, limit_seconds: float = L.ALERT_SECONDS) -> DataFrame:
    """Every line that reports a completed operation above the limit."""
    took = L.seconds(F.col("value"))
    return (
        facts.where(F.contains("value", F.lit("completed in")))
        .withColumn("took", took).where(F.col("took") > limit_seconds)
    )


def _mean_of(operation: str) -> Column:
    return F.avg(F.when(F.col("operation") == operation, F.col("seconds")))


def daily_report(facts: DataFrame) -> DataFrame:
    """Per day: lines per level, mean seconds and scores; one conditional aggregate."""

    def lines(level: str) -> Column:
        return F.count_if(F.col("level") == level).alias(f"n_{level.lower()}")

    # Lines without a time form one group that is dropped afterwards: a filter on ts ahead of the
    # aggregate would parse every line a second time.
    return facts.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("ts").alias("_timed"), lines("INFO"), lines("WARNING"), lines("ERROR"), lines("CRITICAL"),
        _mean_of("api").alias("avg_api_s"), _mean_of("retrieval").alias("avg_retrieval_s"),
        _mean_of("evaluation").alias("avg_evaluation_s"),
        F.avg("faithfulness").alias("avg_faithfulness"), F.avg("relevancy").alias("avg_relevancy"),
    ).where("_timed > 0").drop("_timed")


def daily_top_errors(facts: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent error messages of each day, ranked after they are counted."""
    counted = (
        facts.where(F.col("is_error") & F.col("ts").isNotNull())
        .groupBy(F.to_date("ts").alias("day"), L.error_text(F.col("value")).alias("message"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("day").orderBy(F.desc("n"), "message")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def health_windows(facts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Lines, errors, warnings and critical lines per time window."""
    return facts.where(F.col("ts").isNotNull()).groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_error").alias("n_errors"),
        F.count_if(F.col("level") == "WARNING").alias("n_warnings"),
        F.count_if(F.col("level") == "CRITICAL").alias("n_critical"),
    ).select(F.col("w.start").alias("window_start"), "n_lines", "n_errors", "n_warnings", "n_critical")


def failure_rates(facts: DataFrame) -> DataFrame:
    """Failed attempts over all attempts, per operation."""
    ended = facts.select(*L.attempt(F.col("value"))).where(F.col("operation").isNotNull())
    failed, done = F.count_if(F.col("outcome") == "failed"), F.count_if(F.col("outcome") == "completed")
    return ended.groupBy("operation").agg(
        failed.alias("n_failed"), done.alias("n_completed"), (failed * 100 / (failed + done)).alias("failure_pct"))


def size_checks(facts: DataFrame, max_chars: int = 5000, least: int = 6, most: int = 10) -> DataFrame:
    """One row: how many responses and result sets keep to their expected sizes."""
    sized = facts.select(*L.counts(F.col("value")))
    return sized.agg(
        F.count("response_chars").alias("n_responses"),
        F.count_if(F.col("response_chars") >= max_chars).alias("n_long_responses"),
        F.count("hits").alias("n_retrievals"),
        F.count_if(F.col("hits").between(least, most)).alias("n_expected_sizes"),
        F.count_if(F.col("hits") == 0).alias("n_empty"),
    )


def slo_status(facts: DataFrame) -> DataFrame:
    """Measured means against the service targets: ok, warning, critical or no data. A value on an edge
    is a warning. All means come from one aggregate row."""
    total = F.count_if(F.col("level").isin(*L.LEVELS))
    means = {
        **{name: _mean_of(name) for name in ("api", "retrieval", "evaluation")},
        **{name: F.avg(name) for name in SCORES},
        "error_rate": F.count_if("is_error") * 100 / F.nullif(total, F.lit(0)),
    }
    one = facts.agg(*[mean.alias(f"_{name}") for name, mean in means.items()])

    def judged(metric: str, low: bool, target: float, critical: float) -> Column:
        value = F.col(f"_{metric}")
        good, bad = (value < target, value > critical) if low else (value > target, value < critical)
        status = F.when(value.isNull(), "no data").when(good, "ok").when(bad, "critical").otherwise("warning")
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), status.alias("status"))

    return one.select(F.explode(F.array(*[judged(*t) for t in TARGETS])).alias("t")).select("t.*")


# Every item that the report shows even when the logs hold nothing for it.
_REPORT_ITEMS = (
    *[("levels", name) for name in L.LEVELS],
    *[("timings", name) for name in ("api", "retrieval", "evaluation")],
    *[("scores", name) for name in SCORES],
    ("errors", "all"),
)


def report(facts: DataFrame, top: int = 10, *, tie_break: str | None = None) -> DataFrame:
    """All sections as one long (section, item, measure, value, note) table.

    One pass over the lines tallies levels, modules, timings, scores and errors together (each line
    becomes a few short rows that are counted before the shuffle); a second one picks the last errors.
    """

    def row(section: str, item: Column, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), item.alias("metric"),
                                     value.cast("double").alias("value")))

    nothing = F.lit(None).cast("double")
    rows = F.array_compact(F.array(
        row("levels", F.col("level"), nothing, F.col("level").isin(*L.LEVELS)),
        row("modules", F.col("module"), nothing, F.col("module").isNotNull()),
        row("timings", F.col("operation"), F.col("seconds"),
            F.col("seconds").isNotNull() & F.col("operation").isin("api", "retrieval", "evaluation")),
        *[row("scores", F.lit(s), F.col(s), F.col(s).isNotNull()) for s in SCORES],
        row("errors", F.lit("all"), nothing, F.col("is_error")),
    ))
    tall = facts.select(F.explode(rows).alias("r")).select("r.*")
    shown = F.broadcast(_rows(facts.sparkSession, list(_REPORT_ITEMS), "section string, metric string"))
    stats = series_stats(tall, ["section", "metric"], flag=flagged_value()).join(
        shown, ["section", "metric"], "full_outer").na.fill(0, ["n", "n_flagged"])
    # From here on there is one row per item: levels, modules, a handful of metrics.
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "metric"))
    lines = F.sum(F.when(F.col("section") == "levels", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    pct = F.coalesce(F.col("n") * 100 / F.nullif(lines, F.lit(0)), F.lit(0.0))
    listed = stats.withColumn("place", place).withColumn("pct", pct).where(
        (F.col("section") != "modules") | (F.col("place") <= top))
    has_pct = F.col("section").isin("levels", "errors")
    is_series = F.col("section").isin("timings", "scores")

    def cell(measure: str, column: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(measure).alias("measure"), F.col(column).cast("double").alias("value")))

    cells = F.array_compact(F.array(
        cell("count", "n", F.lit(True)), cell("percent", "pct", has_pct), cell("average", "avg_value", is_series),
        cell("median", "median_value", is_series), cell("min", "min_value", is_series),
        cell("max", "max_value", is_series), cell("flagged", "n_flagged", is_series)))
    note = (
        F.when(is_series & (F.col("n") == 0), "no data")
        .when(F.col("section") == "scores", L.quality_band(F.col("avg_value")))
        .when(F.col("section") == "errors", L.error_rate_band(F.col("n"), F.col("pct")))
    )
    item = F.when(F.col("section") == "modules", L.module_short(F.col("metric"))).otherwise(F.col("metric"))
    table = listed.select("section", item.alias("item"), F.explode(cells).alias("c"), note.alias("note")).select(
        "section", "item", "c.measure", "c.value", "note")
    newest = recent_errors(facts, tie_break=tie_break).select(
        F.lit("recent errors").alias("section"), F.col("message").alias("item"), F.lit("count").alias("measure"),
        F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("note"))
    return table.unionByName(newest)
