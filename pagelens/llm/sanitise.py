"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

The base patterns find the protected entities (addresses, numbers). A term in the texts of an entity's mentions may reveal
it as well, however far off. The corpus tells how strongly: with n(t) occurrences of term t, n(t, e) of them in the text
of a mention of entity e (once for each mention), and n(e) mentions among N words and mentions, the information that t gives
about e is

    PMI(t, e) = log2( P(e | t) / P(e) ),   P(e | t) = n(t, e) / n(t),   P(e) = n(e) / N

out of the entity's own IC(e) = -log2 P(e). A term whose share PMI / IC exceeds GENERALISE is replaced by its
kind, above REMOVE it is removed. Evidence is asked for: at least SUPPORT common occurrences. All counts are over
all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.llm.spans import SLICE, count_of, digest, joined, let, no_spans, replaced, running_max, spans_of
from pagelens.session import materialize

SUPPORT = 2
GENERALISE = 0.7
REMOVE = 0.9

# The base patterns. Where nothing can follow, repeats are possessive and a run is entered at its start
# or at the end of the last match (\G) only: the same matches, in linear time and without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
# A term: the letters of a white-space-delimited token without digits and at signs.
TERM = r"(?<!\S)[^\s\p{L}@0-9]*+\p{L}[\p{L}'’-]{2,}+[^\s\p{L}@0-9]*+(?!\S)"
_TERM_LETTERS = r"\p{L}[\p{L}'’-]*"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    def value(digits: Column) -> Column:
        def weight(i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

        places = F.sequence(F.lit(0), F.length(digits) - 1)
        right = F.aggregate(places, F.lit(0), lambda total, i: total + weight(i)) % 10 == 0
        return F.when(F.length(digits).between(12, 19), right).otherwise(F.lit(False))

    return let(_digits(found), value)


def pii_spans(text: Column) -> Column:
    """The base spans of a text, by kind."""
    whole = F.coalesce(text, F.lit(""))

    def only(possible: Column, spans: Column) -> Column:
        return F.when(possible, spans).otherwise(no_spans())

    return F.array_sort(F.concat(
        only(F.contains(whole, F.lit("@")), spans_of(text, "email", 0, EMAIL)),
        only(whole.rlike(r"[0-9]\.[0-9]"), spans_of(
            text, "ip", 1, IP, lambda m: m.rlike(rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"))),
        only(whole.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), spans_of(text, "card", 2, CARD, _luhn)),
        only(F.contains(whole, F.lit("+")), spans_of(
            text, "phone", 3, PHONE, lambda m: F.length(_digits(m)).between(9, 15))),
    ))


def _entity(span: Column) -> Column:
    bare = F.when(span["kind"] == "email", F.lower(span["found"])).when(
        span["kind"] == "ip", span["found"]).otherwise(_digits(span["found"]))
    return F.concat(span["kind"], F.lit(":"), bare)


def _gaps(text: Column, spans: Column) -> Column:
    """The whole text but its mentions, cut there: structs (at, side). No position outside a mention is left out."""

    def cut(ends: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: let(
            F.coalesce(F.get(ends, i - 1), F.lit(0)),
            lambda at: F.struct(at.alias("at"), F.substring(
                text, at + 1, F.greatest(F.coalesce(F.get(spans, i)["start"], F.length(text)) - at, F.lit(0))).alias("side"))))

    return F.when(F.size(spans) > 0, let(running_max(F.transform(spans, lambda s: s["end"])), cut))


def _terms(side: Column) -> Column:
    """(term, start, end) of the terms of a gap, positions in the document."""

    def place(t: Column) -> Column:
        term = F.regexp_extract(t["found"], _TERM_LETTERS, 0)
        start = side["at"] + t["start"] + F.instr(t["found"], term) - 1
        return F.struct(F.lower(term).alias("term"), start.alias("start"), (start + F.length(term)).alias("end"))

    return F.transform(spans_of(side["side"], "term", 0, TERM), place)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) over all texts, by the same tokens; pre-aggregated in each task."""
    tokens = F.explode(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)))
    return docs.select(tokens.alias("token")).select(
        F.lower(F.regexp_extract("token", _TERM_LETTERS, 0)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``base`` and ``added``: the pattern spans and those of disclosing terms (kinds remove and general)
    of every row, the latter at every place in all texts with their entity. Null and empty texts have none; repeated rows and null ids are rows of their own.

    Rows are numbered as they are stored, so only numbers, entities and terms are shuffled, never texts. Counts per
    (entity, term) and per term are pre-aggregated; a hot entity is a skewed join that adaptive execution splits.
    """
    spans = docs.select(*keep, F.col(text).alias("_text"), pii_spans(F.col(text)).alias("base"))
    terms = F.flatten(F.transform(_gaps(F.col("_text"), F.col("base")), _terms))
    found = materialize(
        spans.select(*keep, F.monotonically_increasing_id().alias("_row"), "base", terms.alias("_terms")), "pii")
    mentions = materialize(
        found.select("_row", F.explode("base").alias("s")).groupBy("_row", _entity(F.col("s")).alias("entity"))
        .agg(F.count("*").alias("m")), "mentions")
    beside = found.select("_row", F.explode("_terms").alias("t")).select("_row", "t.*")
    # Entities of a single text with equally many mentions stand beside the same terms, equally often: they are one
    # class and meet the terms once, however many mentions a text has.
    classes = materialize(
        mentions.join(mentions.groupBy("entity").agg(F.count("*").alias("_texts"), F.sum("m").alias("n_e")), "entity")
        .select("_row", "m", "n_e", F.when(F.col("_texts") == 1, F.concat_ws(":", F.lit("text"), "_row", "m"))
                .otherwise(F.col("entity")).alias("entity")).distinct(), "classes")
    total = mentions.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    mentions = classes.select("_row", "entity", "m")
    entities = classes.groupBy("entity").agg(F.max("n_e").alias("n_e"))
    # Every occurrence is beside every mention of its text; both are counted per text before they meet.
    together = (
        beside.groupBy("_row", "term").agg(F.count("*").alias("o")).join(mentions, "_row")
        .groupBy("entity", "term").agg(F.sum(F.col("o") * F.col("m")).alias("n_te")).where(F.col("n_te") >= SUPPORT))
    counts = materialize(term_counts(docs, text), "terms")
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Mentions count among the words, so no entity is more frequent than all words; one that is all of them has nothing to reveal.
    ic = F.log2(F.lit(float(max(words + total, 1))) / F.col("n_e"))
    # A term beside two mentions counts twice, but no more often than it occurs.
    share = F.coalesce(1 - F.try_divide(F.log2(F.col("n") / F.least("n_te", "n")), ic), F.lit(0.0))
    disclosing = materialize(
        together.join(counts, "term").join(entities, "entity").withColumn("share", share).where(F.col("share") >= GENERALISE)
        .select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("general").alias("action")), "disclosing")
    marked = mentions.join(disclosing, "entity").groupBy("_row", "term").agg(F.max("action").alias("action"))
    added = beside.join(marked, ["_row", "term"])
    rank = F.when(F.col("action") == "general", len(KINDS)).otherwise(len(KINDS) + 1)
    by_row = added.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", F.col("action").alias("kind"), F.col("term").alias("found")))).alias("added"))
    return found.join(by_row, "_row", "left").select(*keep, "base", F.coalesce("added", no_spans()).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    return find(docs).select(
        "doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        digest(F.col("base")).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced by ``[KIND]``, weakly disclosing terms by ``[TERM]`` and strongly
    disclosing ones removed. The texts are stored once with their spans."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_copy"))
    found = find(rows, "_copy", ("_doc",))

    def instead(span: Column) -> Column:
        return F.when(span["kind"] == "remove", "").when(span["kind"] == "general", "[TERM]").otherwise(
            F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))

    clean = replaced(F.col("_doc").getField(text), F.concat("base", "added"), instead)
    return found.select(F.col("_doc").withField(f"`{text}`", clean).alias("_doc")).select("_doc.*")
