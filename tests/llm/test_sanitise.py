"""Personal data against Python's re; disclosure against a brute-force count."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest

from pagelens.llm.sanitise import GENERALISE, REMOVE, report, sanitise


def luhn(digits):
    values = [int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def only(text):
    return re.sub("[^0-9]", "", text)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
]
TEXTS = [
    None, "", "plain words only", "a@b.com_c@d.org a@b @c.d x@y.z.", "a.b@c-d.e.f-g@h.i", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.0255",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111 1111 1111 11111", "0000000000000000000000 000000000000", "+1 (555) 123-4567 +123 +49.30.1234567- x",
    "+1+2+3 123456789 +123456789012345678", "é😀a@b.com 😀 1.1.1.1", "1" * 20_000 + ".1.1.1", "a" * 20_000, "a@b" + ".c" * 20_000,
    "1 " * 30_000, "x@y.z " * 3000, "1.1.1" + ".1" * 5000, "+" * 1000 + "1 2345678 9",
]


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p, keep) in enumerate(PLAIN) for m in re.finditer(p, text or "") if keep(m[0])]
    return sorted(spans)


def test_base_matches_re(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "c"), (3, TEXTS[3], None)]
    got = report(spark.createDataFrame(rows, "doc_id bigint, text string, base string")).collect()
    assert len(got) == len(rows)
    for row in got:
        spans = brute(TEXTS[3] if row.doc_id is None else TEXTS[row.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), row.doc_id
        kinds = Counter(s[3] for s in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [kinds[k] for k, *_ in PLAIN]
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


CORPUS = [
    "mister Quillon wrote from jo@x.org today", "as Quillon said, jo@x.org is busy today", "today the weather is fine and today is long",
    "call +49 30 1234567 today", "the today the", "jo@x.org", "nothing",
]


def test_disclosure_matches_count(spark):
    terms = Counter(w.lower() for t in CORPUS for w in re.findall(r"(?<!\S)\W*([^\W\d_]{3,})\W*(?!\S)", t))
    beside, mentions = Counter(), Counter()
    for t in CORPUS:
        for m in re.finditer(r"jo@x\.org|\+49 30 1234567", t):
            mentions[m[0]] += 1
            for w in re.findall(r"(?<!\S)\W*([^\W\d_]{3,})\W*(?!\S)", t[:m.start()]) + re.findall(r"(?<!\S)\W*([^\W\d_]{3,})\W*(?!\S)", t[m.end():]):
                beside[m[0], w.lower()] += 1
    total = sum(terms.values()) + sum(mentions.values())
    action = {}
    for (e, w), n in beside.items():
        share = 1 - math.log2(terms[w] / min(n, terms[w])) / -math.log2(mentions[e] / total)
        if n >= 2 and share >= GENERALISE:
            action[e, w] = "remove" if share >= REMOVE else "general"
    assert action["jo@x.org", "quillon"] == "remove" and ("jo@x.org", "today") not in action
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans.split(",") for r in report(docs).collect()}
    for i, t in enumerate(CORPUS):
        want = set()
        for (e, w), a in action.items():
            if e in t:
                want |= {f"{a}:{m.start()}:{m.end()}" for m in re.finditer(rf"\b{w}\b", t, re.I)}
        assert {s for s in got[i] if s.split(":")[0] in ("remove", "general")} == want
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[0] == "mister  wrote from [EMAIL] today" and clean[6] == "nothing" and clean[3] == "call [PHONE] today"


def test_empty_and_native(spark, plan_of):
    empty = spark.createDataFrame([], "doc_id bigint, text string, extra int")
    assert report(empty).count() == 0 and sanitise(empty).columns == ["doc_id", "text", "extra"]
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    plan = plan_of(report(docs))
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind", ["email", "phone"])
def test_sanitise_keeps_columns(spark, kind):
    docs = spark.createDataFrame([(1, "a@b.co +1 555 123 4567", "s", 9), (None, None, "t", None)], "doc_id bigint, text string, base string, start int")
    rows = {r.doc_id: r for r in sanitise(docs).collect()}
    assert rows[1].text == "[EMAIL] [PHONE]" and rows[1].start == 9 and rows[None].text is None


@pytest.mark.parametrize("texts", [["alice x@y.com"] * 2, ["alice x@y.com x@y.com x@y.com"], ["x@y.com"], ["x@y.com x@y.com", "bob"]])
def test_few_words(spark, texts):
    """More mentions than words, or as many: no term can say more about an entity than the entity itself."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = sum(t.count("alice") + t.count("bob") for t in texts)
    mentions = sum(t.count("x@y.com") for t in texts)
    for row in report(docs).collect():
        text = texts[row.doc_id]
        beside = sum(t.count("alice") * t.count("x@y.com") for t in texts)
        n = sum(t.count("alice") for t in texts)
        share = 1 - math.log2(n / min(beside, n)) / math.log2((words + mentions) / mentions) if beside else 0
        want = "remove" if share >= REMOVE else "general" if share >= GENERALISE else None
        got = [s.split(":")[0] for s in row.spans.split(",") if s.split(":")[0] in ("remove", "general")]
        assert got == ([want] * text.count("alice") if "x@y" in text and beside >= 2 and want else [])


def test_many_mentions_in_one_text(spark):
    """Entities of one text are one class: their number does not multiply the terms."""
    text = " ".join(f"u{i}@x.org w{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 2}{'uvwxyz'[i // 100 % 6]}" for i in range(4000))
    docs = spark.createDataFrame([(0, text), (1, "waaakku elsewhere")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in report(docs).collect()}
    assert rows[0].n_email == 4000 and "remove" not in rows[1].spans
    found = [s.split(":")[0] for s in rows[0].spans.split(",")]
    # Each word stands in this text alone, but for one that the other text has as well.
    assert found.count("remove") + found.count("general") >= 3900
