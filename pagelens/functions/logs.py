"""Typed columns out of service log lines: ``time | LEVEL    | logger | message``.

The logger is a module name or, in the detailed layout, ``module:function:line``. With
``compat=True`` level, module and errors are found by loose search in the whole line; with
``compat=False`` they are read from the four fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions.text import shorten, strip

# Level names in the order in which a line is searched for them.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
ERROR_LEVELS = ("ERROR", "CRITICAL")

# What a category's message contains, case ignored.
ERROR_CATEGORIES = {
    "api": "api.*fail|timeout|rate limit",
    "database": "chroma|database|connection",
    "validation": "validation|schema.*fail",
    "resource": "memory|resource",
}

# Seconds above which an operation is slow, and scores below which an answer is poor.
SLOW_SECONDS = {"api": 5.0, "retrieval": 2.0, "evaluation": 20.0}
LOW_SCORE = 0.7
ALERT_SECONDS = 5.0

_LAYOUT = r"^\S+ \S+ \| \w+\s+\| [\w.]+(:[\w<>]+:\d+)? \| "


def _found(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _number(line: Column, pattern: str, kind: str = "double") -> Column:
    # No match gives '', and '' is no number.
    return F.regexp_extract(line, pattern, 1).try_cast(kind)


def fields(line: Column) -> Column:
    """The four fields as an array; null for a line in another layout."""
    return F.when(line.rlike(_LAYOUT), F.split(line, r" \| ", 4))


def _field(parts: Column, at: int) -> Column:
    return F.get(parts, F.lit(at))


def _logger_part(parts: Column, at: int) -> Column:
    return F.get(F.split(_field(parts, 2), ":"), F.lit(at))


def field_columns(parts: Column) -> list[Column]:
    """ts, level, module, func, lineno, message out of ``fields``; all null where it is null."""
    return [
        _field(parts, 0).try_cast("timestamp").alias("ts"),
        F.rtrim(_field(parts, 1)).alias("level"),
        _logger_part(parts, 0).alias("module"),
        _logger_part(parts, 1).alias("func"),
        _logger_part(parts, 2).try_cast("int").alias("lineno"),
        _field(parts, 3).alias("message"),
    ]


def time_of(line: Column) -> Column:
    return field_columns(fields(line))[0]


def parse_log(lines: DataFrame) -> DataFrame:
    """Add the six field columns. The fields are a column of their own first, so that a line is matched
    and split once however many of them are used."""
    return lines.withColumn("_fields", fields(F.col("value"))).select(
        *lines.columns, *field_columns(F.col("_fields")))


def level_of(line: Column, compat: bool = True) -> Column:
    if not compat:
        return F.rtrim(_field(fields(line), 1))
    return F.coalesce(*[F.when(F.contains(line, F.lit(f"| {name}")), name) for name in LEVELS])


def module_of(line: Column, compat: bool = True) -> Column:
    if not compat:
        return _logger_part(fields(line), 0)
    return _found(line, r"\| ([a-zA-Z0-9_.]+) \|")


def is_error(line: Column, compat: bool = True) -> Column:
    if not compat:
        return F.coalesce(level_of(line, False).isin(*ERROR_LEVELS), F.lit(False))
    return F.contains(line, F.lit("ERROR"))


def seconds(line: Column) -> Column:
    return _number(line, r"in (\d+\.\d+)s")


def operation(line: Column) -> Column:
    """api, retrieval, evaluation, vision or answer; null for a line that reports no finished operation."""

    def has(*parts: str) -> Column:
        out = F.lit(True)
        for part in parts:
            out = out & F.contains(line, F.lit(part))
        return out

    return (
        F.when(has("Generation completed in"), "api")
        .when(has("Retrieved", "documents in"), "retrieval")
        .when(has("Evaluation completed in"), "evaluation")
        .when(has("Vision generation", "completed in"), "vision")
        .when(has("Answer generated in"), "answer")
    )


def faithfulness(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("Results - Faithfulness")), _number(line, r"Faithfulness: (\d+\.\d+)"))


def relevancy(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("Results - Faithfulness")), _number(line, r"Answer Relevancy: (\d+\.\d+)"))


def attempt(line: Column) -> list[Column]:
    """(operation, outcome) of a line that reports the end of a model call or evaluation, else nulls."""
    ends = [
        ("api", "completed", "Generation completed in"), ("api", "failed", "Generation failed after"),
        ("vision", "completed", "Vision generation completed in"),
        ("vision", "completed", "Vision generation with schema completed in"),
        ("vision", "failed", "Vision call failed after"),
        ("evaluation", "completed", "Evaluation completed in"), ("evaluation", "failed", "Evaluation failed after"),
    ]

    def pick(value_at: int) -> Column:
        return F.coalesce(*[F.when(F.contains(line, F.lit(e[2])), e[value_at]) for e in ends])

    return [pick(0).alias("operation"), pick(1).alias("outcome")]


def error_text(line: Column) -> Column:
    """Fourth ``|`` field of a line, stripped; a line with fewer fields as a whole."""
    parts = F.split(strip(line), r"\|")
    return F.when(F.size(parts) >= 4, strip(F.get(parts, F.lit(3)))).otherwise(strip(line))


def error_short(line: Column) -> Column:
    return shorten(error_text(line), 100, "...")


def module_short(module: Column) -> Column:
    return F.when(F.length(module) > 45, F.concat(F.substring(module, 1, 42), F.lit("..."))).otherwise(module)


def error_categories(line: Column) -> Column:
    """Every category that fits; an error may have several."""
    fits = [F.when(line.rlike(f"(?i){p}"), name) for name, p in ERROR_CATEGORIES.items()]
    return F.array_compact(F.array(*fits))


def error_category(line: Column) -> Column:
    """The first category that fits, or ``other``."""
    return F.coalesce(F.get(error_categories(line), F.lit(0)), F.lit("other"))


def counts(line: Column) -> list[Column]:
    """Hit and character counts that messages carry."""
    return [
        _number(line, r"Retrieved (\d+) documents", "bigint").alias("hits"),
        _number(line, r"from (\d+) total hits", "bigint").alias("total_hits"),
        _number(line, r"prompt length: (\d+) chars", "bigint").alias("prompt_chars"),
        _number(line, r"response: (\d+) chars", "bigint").alias("response_chars"),
        _number(line, r"answer length: (\d+) chars", "bigint").alias("answer_chars"),
    ]


def _band(value: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """Name of the first step that ``value`` reaches; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(value >= least, name)
    return out.otherwise(rest)


def quality_band(score: Column) -> Column:
    return _band(score, [(0.9, "Excellent"), (0.7, "Good"), (0.5, "Fair")], "Poor")


def error_rate_band(errors: Column, rate_pct: Column) -> Column:
    return F.when(errors == 0, "No errors").otherwise(_band(rate_pct, [(5.0, "High"), (1.0, "Good")], "Excellent"))


def log_facts(lines: DataFrame, compat: bool = True) -> DataFrame:
    """Add every derived column the aggregations use. What several columns build on is computed first,
    once per line; columns nobody reads are pruned."""
    line = F.col("value")
    based = lines.select("*", fields(line).alias("_fields"), operation(line).alias("operation"))
    ts, level, module, func, lineno, message = field_columns(F.col("_fields"))
    if compat:
        level, module = level_of(line).alias("level"), module_of(line).alias("module")
        error = is_error(line)
    else:
        error = F.coalesce(F.rtrim(_field(F.col("_fields"), 1)).isin(*ERROR_LEVELS), F.lit(False))
    return based.select(
        *lines.columns, ts, level, module, func, lineno, message, "operation",
        F.when(F.col("operation").isNotNull(), seconds(line)).alias("seconds"),
        faithfulness(line).alias("faithfulness"), relevancy(line).alias("relevancy"), error.alias("is_error"),
    )
