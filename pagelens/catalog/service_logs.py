"""Log parsing and log statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.catalog import roles as R
from pagelens.catalog.registry import query
from pagelens.functions import logs as L
from pagelens.operators.sketches import RANK_ERROR, SketchStore
from pagelens.plans import log_analysis as A
from pagelens.session import scratch_path
from pagelens.sources.logs import latest_log, read_logs, stream_logs
from pagelens.streaming.monitors import error_lines, run_windows, windowed_counts

W = f"WITH {R.LOGS_SQL}"


def _facts(spark, sf_dir, compat=True):
    return L.log_facts(R.log_lines(spark, sf_dir), compat)


def _stamp(column="ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _rounded(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query("log_parse", W + """ SELECT line_no, value[1:19] AS ts, trim(string_split(value, ' | ')[2]) AS level,
  string_split(string_split(value, ' | ')[3], ':')[1] AS module, string_split(string_split(value, ' | ')[3], ':')[2] AS func,
  string_split(string_split(value, ' | ')[3], ':')[3] AS lineno, string_split(value, ' | ')[4] AS message FROM lines""")
def log_parse(spark, sf_dir):
    return L.parse_log(R.log_lines(spark, sf_dir)).select(
        "line_no", _stamp().alias("ts"), "level", "module", "func", F.col("lineno").cast("string").alias("lineno"), "message")


@query("log_facts", W + """ SELECT line_no, level, module, operation, seconds, faithfulness, relevancy, is_error FROM facts_s""")
def log_facts_query(spark, sf_dir):
    return _facts(spark, sf_dir).select(
        "line_no", "level", "module", "operation", "seconds", "faithfulness", "relevancy", "is_error")


@query("log_levels", W + """ SELECT l.level, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100 / sum(coalesce(n, 0)) OVER (), 6) AS pct
FROM (VALUES ('DEBUG'), ('INFO'), ('WARNING'), ('ERROR'), ('CRITICAL')) l(level)
LEFT JOIN (SELECT level, count(*) AS n FROM facts GROUP BY 1) f ON f.level = l.level""")
def log_levels(spark, sf_dir):
    return A.level_counts(_facts(spark, sf_dir)).select("level", "n", *_rounded("pct"))


@query("log_levels_parsed", W + """ SELECT trim(string_split(value, ' | ')[2]) AS level, count(*) AS n FROM lines GROUP BY 1""")
def log_levels_parsed(spark, sf_dir):
    return A.level_counts(_facts(spark, sf_dir, compat=False)).where("n > 0").select("level", "n")


@query("log_modules", W + " SELECT module, count(*) AS n FROM facts WHERE module IS NOT NULL GROUP BY 1")
def log_modules(spark, sf_dir):
    return A.module_counts(_facts(spark, sf_dir))


@query("top_modules", W + """ SELECT CASE WHEN length(module) > 45 THEN module[1:42] || '...' ELSE module END AS module, n
FROM (SELECT module, count(*) AS n FROM facts WHERE module IS NOT NULL GROUP BY 1 ORDER BY n DESC, module LIMIT 10)""")
def top_modules(spark, sf_dir):
    return A.top_modules(_facts(spark, sf_dir))


STATS = """round(avg(v), 6) AS avg_value, round(median(v), 6) AS median_value, min(v) AS min_value, max(v) AS max_value"""


@query("log_timings", W + f""" SELECT operation AS metric, count(*) AS n, {STATS},
  count(*) FILTER (v > CASE operation WHEN 'api' THEN 5.0 WHEN 'retrieval' THEN 2.0 ELSE 20.0 END) AS n_flagged
FROM (SELECT operation, seconds AS v FROM facts_s WHERE seconds IS NOT NULL) WHERE operation IN ('api', 'retrieval', 'evaluation') GROUP BY 1""")
def log_timings(spark, sf_dir):
    return A.timing_stats(_facts(spark, sf_dir)).select(
        "metric", "n", *_rounded("avg_value", "median_value"), "min_value", "max_value", "n_flagged")


# Daily sketches stored once and merged over all days: counts and extremes exact, the rank of median and 95th percentile within the
# stated error, measured against all values.
@query("log_sketches", W + """ SELECT operation AS metric, count(*) AS n, round(avg(seconds), 6) AS avg_value, min(seconds) AS min_value,
  max(seconds) AS max_value, true AS median_ok, true AS p95_ok FROM facts_s WHERE seconds IS NOT NULL AND operation IS NOT NULL GROUP BY 1""")
def log_sketches(spark, sf_dir):
    values = A.measurements(_facts(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day").where(~F.col("metric").isin(*A.SCORES))
    store = SketchStore(spark, scratch_path(spark, "sketches"))
    store.add(values)
    made = store.over()
    joined = values.select("metric", "value").join(F.broadcast(made.select("metric", "median_value", "p95_value")), "metric")  # one row per metric

    def close(estimate: str, share: float):
        """The ranks that the estimate takes up among all values reach into the allowed band."""
        below, upto = F.count_if(F.col("value") < F.col(estimate)), F.count_if(F.col("value") <= F.col(estimate))
        return (below <= (share + RANK_ERROR) * F.count(F.lit(1))) & (upto >= (share - RANK_ERROR) * F.count(F.lit(1)))

    ranks = joined.groupBy("metric").agg(close("median_value", 0.5).alias("median_ok"), close("p95_value", 0.95).alias("p95_ok"))
    return made.join(ranks, "metric").select("metric", "n", *_rounded("avg_value"), "min_value", "max_value", "median_ok", "p95_ok")


# A report whose sections are partly empty: logs in which nothing was evaluated.
@query("log_empty_sections", W + f""", names AS (SELECT unnest(['api', 'retrieval', 'evaluation']) AS metric)
SELECT metric, count(v) AS n, {STATS}, count(*) FILTER (v > CASE metric WHEN 'api' THEN 5.0 WHEN 'retrieval' THEN 2.0 ELSE 20.0 END) AS n_flagged
FROM names LEFT JOIN (SELECT operation AS metric, seconds AS v FROM facts_s WHERE seconds IS NOT NULL AND operation = 'api') USING (metric) GROUP BY 1""")
def log_empty_sections(spark, sf_dir):
    return A.timing_stats(_facts(spark, sf_dir).where("operation = 'api'")).select(
        "metric", "n", *_rounded("avg_value", "median_value"), "min_value", "max_value", "n_flagged")


@query("log_scores", W + f""", tall AS (SELECT 'faithfulness' AS metric, faithfulness AS v FROM facts WHERE faithfulness IS NOT NULL
  UNION ALL SELECT 'relevancy', relevancy FROM facts WHERE relevancy IS NOT NULL)
SELECT metric, count(*) AS n, {STATS}, count(*) FILTER (v < 0.7) AS n_flagged,
  CASE WHEN avg(v) >= 0.9 THEN 'Excellent' WHEN avg(v) >= 0.7 THEN 'Good' WHEN avg(v) >= 0.5 THEN 'Fair' ELSE 'Poor' END AS band FROM tall GROUP BY 1""")
def log_scores(spark, sf_dir):
    return A.score_stats(_facts(spark, sf_dir)).select(
        "metric", "n", *_rounded("avg_value", "median_value"), "min_value", "max_value", "n_flagged", "band")


@query("slow_operations", W + " SELECT line_no, took FROM facts WHERE contains(value, 'completed in') AND took > 5.0")
def slow_operations(spark, sf_dir):
    return A.slow_operations(_facts(spark, sf_dir)).select("line_no", "took")


ERROR_RATE_SQL = """rate AS (SELECT count(*) FILTER (is_error) AS errors, count(level) AS total, count(*) FILTER (is_error) * 100 / count(level) AS rate_pct FROM facts)"""


@query("log_error_rate", W + f""", {ERROR_RATE_SQL} SELECT errors, total, round(rate_pct, 6) AS rate_pct,
  CASE WHEN errors = 0 THEN 'No errors' WHEN rate_pct < 1 THEN 'Excellent' WHEN rate_pct < 5 THEN 'Good' ELSE 'High' END AS band FROM rate""")
def log_error_rate(spark, sf_dir):
    return A.error_rate(_facts(spark, sf_dir)).select("errors", "total", *_rounded("rate_pct"), "band")


# The last five is the feature here.
@query("recent_errors", W + """ SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, file, CASE WHEN length(message) > 100 THEN message[1:100] || '...' ELSE message END AS message
FROM facts WHERE is_error ORDER BY ts DESC, file DESC, line_no DESC LIMIT 5""")
def recent_errors(spark, sf_dir):
    return A.recent_errors(_facts(spark, sf_dir), tie_break="line_no").withColumn("ts", _stamp())


@query("error_messages", W + " SELECT message, count(*) AS n FROM facts WHERE is_error GROUP BY 1")
def error_messages(spark, sf_dir):
    return A.error_messages(_facts(spark, sf_dir), limit=None)


@query("top_errors", W + " SELECT message, count(*) AS n FROM facts WHERE is_error GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def top_errors(spark, sf_dir):
    return A.error_messages(_facts(spark, sf_dir), limit=10)


@query("errors_by_module", W + " SELECT trim(string_split(value, '|')[3]) AS module, count(*) AS n FROM facts WHERE is_error GROUP BY 1")
def errors_by_module(spark, sf_dir):
    return A.errors_by_module(_facts(spark, sf_dir))


@query("errors_hourly", W + " SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM facts WHERE is_error GROUP BY 1")
def errors_hourly(spark, sf_dir):
    return A.errors_hourly(_facts(spark, sf_dir)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


_FITS = {name: f"regexp_matches(value, '(?i){p}')" for name, p in L.ERROR_CATEGORIES.items()}


@query("error_categories", W + " SELECT CASE " + " ".join(f"WHEN {m} THEN '{n}'" for n, m in _FITS.items())
       + " ELSE 'other' END AS category, count(*) AS n FROM facts WHERE is_error GROUP BY 1")
def error_categories(spark, sf_dir):
    return A.errors_by_category(_facts(spark, sf_dir))


@query("error_category_overlap", W + " SELECT category, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS category FROM facts WHERE is_error AND {m}" for n, m in _FITS.items()) + ") GROUP BY 1")
def error_category_overlap(spark, sf_dir):
    return A.errors_by_category(_facts(spark, sf_dir), exclusive=False)


@query("daily_report", W + """ SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (level = 'INFO') AS n_info, count(*) FILTER (level = 'WARNING') AS n_warning,
  count(*) FILTER (level = 'ERROR') AS n_error, count(*) FILTER (level = 'CRITICAL') AS n_critical,
  round(avg(seconds) FILTER (operation = 'api'), 6) AS avg_api_s, round(avg(seconds) FILTER (operation = 'retrieval'), 6) AS avg_retrieval_s,
  round(avg(seconds) FILTER (operation = 'evaluation'), 6) AS avg_evaluation_s, round(avg(faithfulness), 6) AS avg_faithfulness,
  round(avg(relevancy), 6) AS avg_relevancy FROM facts_s GROUP BY 1""")
def daily_report(spark, sf_dir):
    return A.daily_report(_facts(spark, sf_dir)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n_info", "n_warning", "n_error", "n_critical",
        *_rounded("avg_api_s", "avg_retrieval_s", "avg_evaluation_s", "avg_faithfulness", "avg_relevancy"))


@query("daily_top_errors", W + """ SELECT strftime(ts, '%Y-%m-%d') AS day, message, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY count(*) DESC, message) AS INTEGER) AS rank
FROM facts WHERE is_error GROUP BY 1, 2 QUALIFY rank <= 5""")
def daily_top_errors(spark, sf_dir):
    return A.daily_top_errors(_facts(spark, sf_dir)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "message", "n", "rank")


@query("health_windows", W + """ SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_lines,
  count(*) FILTER (is_error) AS n_errors, count(*) FILTER (level = 'WARNING') AS n_warnings, count(*) FILTER (level = 'CRITICAL') AS n_critical
FROM facts GROUP BY 1""")
def health_windows(spark, sf_dir):
    return A.health_windows(_facts(spark, sf_dir), "1 day").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("failure_rates", W + """, ended AS (SELECT CASE WHEN contains(value, 'Generation completed in') OR contains(value, 'Generation failed after') THEN 'api'
    WHEN contains(value, 'Vision generation completed in') OR contains(value, 'Vision call failed after') THEN 'vision'
    WHEN contains(value, 'Evaluation completed in') OR contains(value, 'Evaluation failed after') THEN 'evaluation' END AS operation,
  contains(value, 'failed after') AS failed FROM lines)
SELECT operation, count(*) FILTER (failed) AS n_failed, count(*) FILTER (NOT failed) AS n_completed,
  round(count(*) FILTER (failed) * 100 / count(*), 6) AS failure_pct FROM ended WHERE operation IS NOT NULL GROUP BY 1""")
def failure_rates(spark, sf_dir):
    return A.failure_rates(_facts(spark, sf_dir)).select("operation", "n_failed", "n_completed", *_rounded("failure_pct"))


@query("size_checks", W + """, sized AS (SELECT TRY_CAST(regexp_extract(value, 'response: (\\d+) chars', 1) AS BIGINT) AS r,
  TRY_CAST(regexp_extract(value, 'Retrieved (\\d+) documents', 1) AS BIGINT) AS h FROM lines)
SELECT count(r) AS n_responses, count(*) FILTER (r >= 5000) AS n_long_responses, count(h) AS n_retrievals,
  count(*) FILTER (h BETWEEN 6 AND 10) AS n_expected_sizes, count(*) FILTER (h = 0) AS n_empty FROM sized""")
def size_checks(spark, sf_dir):
    return A.size_checks(_facts(spark, sf_dir))


@query("count_fields", W + """ SELECT line_no, nullif(regexp_extract(value, 'Retrieved (\\d+) documents', 1), '') AS hits,
  nullif(regexp_extract(value, 'from (\\d+) total hits', 1), '') AS total_hits, nullif(regexp_extract(value, 'prompt length: (\\d+) chars', 1), '') AS prompt_chars,
  nullif(regexp_extract(value, 'response: (\\d+) chars', 1), '') AS response_chars, nullif(regexp_extract(value, 'answer length: (\\d+) chars', 1), '') AS answer_chars FROM lines""")
def count_fields(spark, sf_dir):
    return R.log_lines(spark, sf_dir).select("line_no", *[c.cast("string") for c in L.counts(F.col("value"))])


@query("slo_status", W + f""", {ERROR_RATE_SQL},
means AS (SELECT operation AS metric, avg(seconds) AS v FROM facts_s WHERE operation IN ('api', 'retrieval', 'evaluation') GROUP BY 1
  UNION ALL SELECT 'faithfulness', avg(faithfulness) FROM facts UNION ALL SELECT 'relevancy', avg(relevancy) FROM facts
  UNION ALL SELECT 'error_rate', rate_pct FROM rate)
SELECT metric, round(v, 6) AS value, CASE
  WHEN metric IN ('faithfulness', 'relevancy') THEN CASE WHEN v > 0.8 THEN 'ok' WHEN v < 0.6 THEN 'critical' ELSE 'warning' END
  WHEN v < CASE metric WHEN 'api' THEN 3 WHEN 'retrieval' THEN 1.5 WHEN 'evaluation' THEN 15 ELSE 1 END THEN 'ok'
  WHEN v > CASE metric WHEN 'api' THEN 5 WHEN 'retrieval' THEN 3 WHEN 'evaluation' THEN 25 ELSE 5 END THEN 'critical' ELSE 'warning' END AS status FROM means""")
def slo_status(spark, sf_dir):
    return A.slo_status(_facts(spark, sf_dir)).select("metric", *_rounded("value"), "status")


@query("log_report", W + """,
tall AS (SELECT 'levels' AS section, level AS item, NULL::DOUBLE AS v FROM facts WHERE level IS NOT NULL
  UNION ALL SELECT 'timings', operation, seconds FROM facts_s WHERE seconds IS NOT NULL AND operation IN ('api', 'retrieval', 'evaluation')
  UNION ALL SELECT 'scores', 'faithfulness', faithfulness FROM facts WHERE faithfulness IS NOT NULL
  UNION ALL SELECT 'scores', 'relevancy', relevancy FROM facts WHERE relevancy IS NOT NULL
  UNION ALL SELECT 'errors', 'all', NULL FROM facts WHERE is_error
  UNION ALL SELECT 'modules', module, NULL FROM facts WHERE module IN (SELECT module FROM facts WHERE module IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, module LIMIT 10)),
s AS (SELECT section, item, count(*) AS n, avg(v) AS a, median(v) AS m, min(v) AS lo, max(v) AS hi,
  count(*) FILTER (v > CASE item WHEN 'api' THEN 5.0 WHEN 'retrieval' THEN 2.0 WHEN 'evaluation' THEN 20.0 END OR (section = 'scores' AND v < 0.7)) AS f FROM tall GROUP BY 1, 2),
p AS (SELECT *, n * 100 / sum(n) FILTER (section = 'levels') OVER () AS pct FROM s),
l AS (SELECT section, item, 'count' AS measure, n AS value FROM p UNION ALL SELECT section, item, 'percent', pct FROM p WHERE section IN ('levels', 'errors')
  UNION ALL SELECT section, item, 'average', a FROM p WHERE section IN ('timings', 'scores') UNION ALL SELECT section, item, 'median', m FROM p WHERE section IN ('timings', 'scores')
  UNION ALL SELECT section, item, 'min', lo FROM p WHERE section IN ('timings', 'scores') UNION ALL SELECT section, item, 'max', hi FROM p WHERE section IN ('timings', 'scores')
  UNION ALL SELECT section, item, 'flagged', f FROM p WHERE section IN ('timings', 'scores'))
SELECT section, item, measure, round(CAST(value AS DOUBLE), 6) AS value, CASE section
  WHEN 'scores' THEN (SELECT CASE WHEN a >= 0.9 THEN 'Excellent' WHEN a >= 0.7 THEN 'Good' WHEN a >= 0.5 THEN 'Fair' ELSE 'Poor' END FROM p WHERE p.section = l.section AND p.item = l.item)
  WHEN 'errors' THEN (SELECT CASE WHEN pct < 1 THEN 'Excellent' WHEN pct < 5 THEN 'Good' ELSE 'High' END FROM p WHERE p.section = 'errors') END AS note FROM l
UNION ALL SELECT 'recent errors', CASE WHEN length(message) > 100 THEN message[1:100] || '...' ELSE message END, 'count', 1.0, NULL
FROM (SELECT * FROM facts WHERE is_error ORDER BY ts DESC, file DESC, line_no DESC LIMIT 5)""")
def log_report(spark, sf_dir):
    return A.report(_facts(spark, sf_dir), tie_break="line_no").select(
        "section", "item", "measure", *_rounded("value"), "note")


@query("latest_log", W + " SELECT file, line_no, value FROM lines WHERE file = (SELECT max(file) FROM lines)")
def latest_log_query(spark, sf_dir):
    return latest_log(R.log_lines(spark, sf_dir)).select("file", "line_no", "value")


# The errors-only sink, written and read back.
@query("error_sink", W + " SELECT value FROM lines WHERE trim(string_split(value, '|')[2]) IN ('ERROR', 'CRITICAL')")
def error_sink(spark, sf_dir):
    out = scratch_path(spark, "errors")
    error_lines(R.log_lines(spark, sf_dir)).select("value").write.text(out)
    return spark.read.text(out)


# Lines written as text files and read back as such: one file per day, names from the folder's listing.
def _written_logs(spark, sf_dir):
    out = scratch_path(spark, "logs")
    lines = R.log_lines(spark, sf_dir).select(F.regexp_replace("file", r"\.log$", "").alias("day"), "value")
    lines.write.partitionBy("day").text(out)
    return out


@query("text_logs", W + """ SELECT level, module, count(*) AS n, count(*) FILTER (is_error) AS n_errors, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first
FROM facts GROUP BY 1, 2""")
def text_logs(spark, sf_dir):
    facts = L.log_facts(read_logs(spark, _written_logs(spark, sf_dir), "*.txt"))
    return facts.groupBy("level", "module").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("n_errors"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"))


# The same files as a stream of lines, with a watermark: all lines are there from the start, so none is late.
@query("stream_text_logs", W + """ SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_lines, count(*) FILTER (is_error) AS n_errors FROM facts GROUP BY 1""")
def stream_text_logs(spark, sf_dir):
    lines = stream_logs(spark, _written_logs(spark, sf_dir) + "/*", "*.txt")
    return run_windows(windowed_counts(lines, "1 day", watermark="10 minutes")).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_lines", "n_errors")
