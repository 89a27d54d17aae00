"""Secret scans over a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must contain
(a conjunction of clauses, each a choice of sets of trigrams). The index is a table of postings: one row for each
trigram of any query and each distinct text that holds it. It is built once, in one pass over the texts, and written. A query
intersects and unites the lists of its trigrams by joins and counts on these narrow rows: a set is met where all its
trigrams are, a clause where one of its sets is, a rule where all its clauses are. Only the texts that are left are
verified by the expression itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagelens.llm.spans import count_of, digest, joined, no_spans, replaced, spans_of
from pagelens.session import materialize

_parse = re._parser.parse  # the standard library's own regex parser: no parser is written here


@dataclass(frozen=True)
class Rule:
    """``keep``: an expression that a match must fulfil besides, found by group 2 of ``pattern`` having
    at least ``group2`` characters. ``base`` rules make up the counts and the digest."""

    kind: str
    pattern: str
    group2: int = 0
    base: bool = False


# The three base rules. Runs below the stated minimum are dropped by the repeat count,
# which is the same thing where a failing match holds no other match.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group2=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
# Public formats of well-known credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE_RULES + MORE_RULES

Query = list[list[frozenset[str]]]  # AND of (OR of (AND of trigrams))
_MOST_STRINGS = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """What every match must contain, in lower case; empty if nothing is mandatory.

    Adjacent literals, alternatives, small classes and optional characters are multiplied out to the set
    of strings that may stand there; an unbounded or large class ends the set. A set whose strings all
    have three characters or more gives one condition: the trigrams of one of them.
    """
    found: Query = []

    def flush(strings: set[str]) -> set[str]:
        if all(len(s) >= 3 for s in strings):
            found.append(sorted({_trigrams(s) for s in strings}, key=sorted))
        return {""}

    def one(op, value) -> set[str] | None:
        """The strings a node may match, or None if they are too many."""
        name = str(op)
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
                return {chr(v).lower() for _, v in value}
            return None
        if name == "SUBPATTERN":
            return every(value[-1])
        if name == "BRANCH":
            parts = [every(branch) for branch in value[1]]
            return None if None in parts else set().union(*parts)
        if name in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            inner = every(body)
            if inner is None or high > 4:
                return None
            out: set[str] = set()
            for n in range(low, high + 1):
                strings = {""}
                for _ in range(n):
                    strings = {a + b for a in strings for b in inner}
                out |= strings
            return out if len(out) <= _MOST_STRINGS else None
        return {""} if name == "AT" else None

    def every(items) -> set[str] | None:
        strings = {""}
        for op, value in items:
            more = one(op, value)
            if more is None or len(strings) * len(more) > _MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    strings = {""}
    for op, value in _parse(pattern):
        more = one(op, value)
        if more is None:
            strings = flush(strings)
        elif len(strings) * len(more) > _MOST_STRINGS:
            strings = flush(strings)
            strings = more if len(more) <= _MOST_STRINGS else {""}
        else:
            strings = {a + b for a in strings for b in more}
    flush(strings)
    return found


# Texts are known to the index by 128 bits of hash.
_KEY = ("_h1", "_h2")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_h1": F.xxhash64(whole), "_h2": F.xxhash64(F.lit(1), whole)})


class TrigramIndex:
    """The postings of the trigrams that a rule set asks for. Rules are known by their place in the set."""

    def __init__(self, rules: Sequence[Rule]):
        self.queries = [trigram_query(rule.pattern) for rule in rules]
        used = {t for q in self.queries for ors in q for grams in ors for t in grams}
        self.number = {t: i for i, t in enumerate(sorted(used))}
        #: Rules that no trigram can narrow down.
        self.open = [i for i, q in enumerate(self.queries) if not q]

    def present(self, folded: Column) -> Column:
        """The numbers of the index's trigrams that a text in lower case holds."""
        found = [F.when(F.contains(folded, F.lit(t)), F.lit(i)) for t, i in self.number.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<int>")

    def postings(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(trigram, _h1, _h2): each text once in each of its lists, equal texts being one. Rows of a list lie together in their file."""
        # Folded in a step of its own: every trigram looks at the same lower-case text.
        folded = _keyed(docs.select(text), text).select(*_KEY, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("folded"))
        texts = folded.select(*_KEY, self.present(F.col("folded")).alias("grams")).dropDuplicates(list(_KEY))
        return materialize(texts.select(F.explode("grams").alias("trigram"), *_KEY).sortWithinPartitions("trigram"), "postings")

    def asked(self, spark: SparkSession) -> DataFrame:
        """The queries as rows (rule, clause, choice, trigram, needed), needed the size of the set; as many as the rules' trigrams."""
        rows = [(r, c, k, self.number[t], len(grams)) for r, q in enumerate(self.queries) for c, ors in enumerate(q)
                for k, grams in enumerate(ors) for t in grams]
        return spark.createDataFrame(rows, "rule int, clause int, choice int, trigram int, needed int")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(_h1, _h2, rules): what the intersected and united lists leave, for every text that any rule may match.

        One shuffle brings a text's postings together; sets, clauses and rules are then counted where they lie. A text has no more
        postings than the index has trigrams, so a list that a third of all texts are in is spread like any other.
        """
        spark = postings.sparkSession
        clauses = spark.createDataFrame([(r, len(q)) for r, q in enumerate(self.queries)], "rule int, clauses int")
        met = postings.repartition(*_KEY).join(F.broadcast(self.asked(spark)), "trigram").groupBy(*_KEY, "rule", "clause", "choice").agg(
            F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed")
        rules = met.groupBy(*_KEY, "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(clauses), "rule").where("n = clauses")
        return rules.groupBy(*_KEY).agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``secret_spans``: array of (start, rank, end, kind, found), every rule's matches in the whole text.

    Positions are code points, ends exclusive. Null and empty texts have no spans; repeated rows, null ids and
    further columns pass through (an input column of that name is replaced). Texts meet their candidate rules by the hash of the
    text; a text that very many rows have is a skewed key, which adaptive execution splits.
    """
    index = TrigramIndex(rules)
    kept = [c for c in docs.columns if c not in ("secret_spans", "_rules", *_KEY)]
    left = index.candidates(index.postings(docs, text)).withColumnRenamed("rules", "_rules")
    judged = _keyed(docs.select(*(f"`{c}`" for c in kept)), text).join(left, list(_KEY), "left")
    parts = []
    for rank, rule in enumerate(rules):
        keep = None
        if rule.group2:
            keep = lambda m, r=rule: F.length(F.regexp_extract(m, r.pattern, 2)) >= r.group2
        found = spans_of(F.col(text), rule.kind, rank, rule.pattern, keep)
        may = F.lit(True) if rank in index.open else F.coalesce(F.array_contains("_rules", rank), F.lit(False))
        parts.append(F.when(may, found).otherwise(no_spans()))
    return judged.select(*(f"`{c}`" for c in kept), F.array_sort(F.concat(*parts)).alias("secret_spans"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base rules, and all spans."""
    base = F.filter(F.col("secret_spans"), lambda s: s["rank"] < len(BASE_RULES))
    return scan(docs).select("doc_id", F.col("secret_spans"), base.alias("_base")).select(
        "doc_id",
        *(count_of(F.col("_base"), r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        digest(F.col("_base")).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret replaced by ``[KIND]``."""
    clean = replaced(F.col(text), F.col("secret_spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return scan(docs, text).withColumn(text, clean).select(*docs.columns)
