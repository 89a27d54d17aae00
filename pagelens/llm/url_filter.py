"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an expression and what a URL must hold to fit it: a list of alternatives, each a set of whole tokens. A URL that fits
holds all tokens of one alternative. The index keeps a rule under one token of each alternative, the one that the fewest
URLs of the corpus have. The tokens of a URL fetch the rules kept under them, and only those rules' expressions run on the URL.

Rules are a table (rule, pattern, verdict, base, tokens), so that lists of any length can be loaded with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens.session import materialize


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host and path put together. A base rule has its text in ``rule``; others decide
    only where no base rule fits. ``tokens``: the alternatives; none at all if every URL must be tried."""

    rule: str
    pattern: str
    verdict: str
    tokens: tuple[tuple[str, ...], ...]
    base: bool = False


TOKEN = r"[^\p{L}\p{N}]+"
# Rules are broadcast up to this number; beyond it they are joined by a shuffle on their token.
BROADCAST_RULES = 50_000
# Rules that name no token, at most.
MOST_OPEN = 256
RULE_SCHEMA = "rule string, pattern string, verdict string, base boolean, tokens array<array<string>>"


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def base_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and its subdomains if the path starts with ``path``. The last token of the path may go on in a
    URL, unless the path ends behind it, so it is no index token then."""
    whole = _tokens(path) if not path[-1:].isalnum() else _tokens(path)[:-1]
    return UrlRule(host + path, rf"\A(?:[^/]*\.)?{re.escape(host + path)}", verdict, ((*_tokens(host), *whole),), True)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """Fits where the word is a whole token of host or path."""
    return UrlRule(word, rf"(?i)(?:\A|[^\p{{L}}\p{{N}}]){re.escape(word)}(?:[^\p{{L}}\p{{N}}]|\z)", verdict, (tuple(_tokens(word)),))


def segment_rule(name: str, paths: Sequence[str], verdict: str = "block") -> UrlRule:
    """Fits where one of ``paths`` is a run of whole path segments, a file's ending left aside. Each is an alternative of its own."""
    any_of = "|".join(map(re.escape, paths))
    return UrlRule(name, rf"(?i)/(?:{any_of})(?:[/.]|\z)", verdict, tuple(tuple(_tokens(p)) for p in paths))


# The base rules.
BASE_RULES = (
    base_rule("org", "/", "allow"),
    base_rule("example.org", "/es/", "block"),
    base_rule("example.org", "/en/1", "block"),
    base_rule("com", "/fr/", "allow"),
    base_rule("com", "/de/", "block"),
)
# Words that as a whole token of host or path mark pages unfit for training.
MORE_RULES = (
    *(word_rule(w) for w in ("porn", "xxx", "casino", "betting", "viagra", "torrent", "warez", "doubleclick", "adserver")),
    segment_rule("login form", ("login", "signin", "logout")),
    segment_rule("cart", ("cart/add", "cart/checkout")),
    UrlRule("raw ip", r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|\z)", "block", ()),
)
RULES = BASE_RULES + MORE_RULES


def rule_table(spark: SparkSession, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.rule, r.pattern, r.verdict, r.base, [list(t) for t in r.tokens]) for r in rules], RULE_SCHEMA)


def host_rules(listed: DataFrame) -> DataFrame:
    """A rule table from (host, path, verdict): base rules for hosts with their subdomains and paths below a prefix, from Spark
    functions alone. The longest that fits wins."""
    parts = F.filter(F.split(F.lower("path"), TOKEN), lambda t: t != "")
    # The last token may go on in a URL, unless the path ends behind it.
    whole = F.when(F.col("path").rlike(r"[\p{L}\p{N}]\z"), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    tokens = F.concat(F.filter(F.split(F.lower("host"), TOKEN), lambda t: t != ""), whole)
    quoted = F.regexp_replace(F.concat("host", "path"), r"([^\p{L}\p{N}/])", r"\\$1")
    return listed.select(
        F.concat("host", "path").alias("rule"), F.concat(F.lit(r"\A(?:[^/]*\.)?"), quoted).alias("pattern"), "verdict",
        F.lit(True).alias("base"), F.array(tokens).alias("tokens"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules as rows, one for each ``token`` that a rule is kept under: of each alternative's tokens the one in the fewest distinct
    URLs (``target``), ties to the smaller; null for a rule without tokens, which every URL must try."""
    table = materialize(rules.select("rule", "pattern", "verdict", "base", "tokens").withColumn(
        "rule_id", F.monotonically_increasing_id()), "url-rules")
    wanted = table.select(F.explode(F.flatten("tokens")).alias("token")).distinct()
    if table.count() <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    seen = url_tokens(urls).join(wanted, "token", "left_semi").groupBy("token").count()
    each = table.select("rule_id", F.posexplode("tokens").alias("alternative", "some")).select(
        "rule_id", "alternative", F.explode("some").alias("token"))
    rarest = each.join(seen, "token", "left").groupBy("rule_id", "alternative").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    # An alternative without tokens asks for nothing: such a rule is tried on every URL, like one without alternatives.
    asks = ~F.exists("tokens", lambda t: F.size(t) == 0)
    kept = table.join(rarest.select("rule_id", "token").distinct(), "rule_id", "left")
    return materialize(kept.select(
        "rule_id", "rule", "pattern", "verdict", "base", F.when(asks, F.col("token")).alias("token")).distinct(), "url-index")


def url_tokens(urls: DataFrame) -> DataFrame:
    tokens = F.array_distinct(F.split(F.lower("target"), TOKEN))
    return urls.select("target", F.explode(tokens).alias("token")).where("token <> ''")


def decide(pages: DataFrame, url: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """Add host, path, rule and verdict to every row. ``rules`` is a rule table (default: RULES).

    The longest base rule that fits gives rule and verdict; without one, ``rule`` is null and the verdict is block if
    any other rule that blocks fits, else allow. Null URLs and those without ``://`` have empty host and path. Equal URLs are judged
    once; repeated rows and null ids pass through.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn(
        "_target", F.concat("host", "path"))
    urls = materialize(placed.select(F.col("_target").alias("target")).distinct(), "urls")
    index = rule_index(urls, rule_table(pages.sparkSession) if rules is None else rules)
    named = index.where("token is not null")
    if index.count() <= 4 * BROADCAST_RULES:  # a rule has a few alternatives
        named = F.broadcast(named)
    columns = ("rule", "pattern", "verdict", "base")
    # A token that a third of all URLs have is a skewed key: a broadcast has none, and adaptive execution splits it else.
    candidates = url_tokens(urls).join(named, "token").select("target", *columns)
    # Rules without tokens are tried on all URLs: they travel as constants of the plan.
    always = index.where("token is null").select(*columns).limit(MOST_OPEN + 1).collect()
    if len(always) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} rules name no token; every URL would have to try them all")
    if always:
        every = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in columns)) for r in always))
        candidates = candidates.unionByName(urls.select("target", F.explode(every).alias("r")).select("target", "r.*"))
    hit = candidates.where(F.expr("target rlike pattern"))
    weight = F.when(F.col("base"), F.length("rule")).otherwise((F.col("verdict") == "block").cast("int"))
    best = hit.groupBy("target").agg(F.max(F.struct("base", weight.alias("weight"), "rule", "verdict")).alias("_best"))
    judged = placed.join(best.withColumnRenamed("target", "_t"), F.col("_target") == F.col("_t"), "left")
    return judged.select(
        *kept, "host", "path", F.when(F.col("_best.base"), F.col("_best.rule")).alias("rule"),
        F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    return decide(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
