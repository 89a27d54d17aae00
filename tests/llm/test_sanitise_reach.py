"""Disclosing terms are weighed and marked over the whole text, not only near the mention."""

from __future__ import annotations

from pagelens.llm.sanitise import report, sanitise

FAR = "the weather is fine and long " * 20
CORPUS = [
    f"jo@x.org wrote {FAR}then Quillon left {FAR}and Quillon, came", f"Quillon spoke {FAR}to jo@x.org and +1 555 123 4567 +1 555 123 4567",
    "see mail:jo@x.org", *[FAR] * 20,
]


def test_far_occurrences(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "Quillon" not in clean[0] + clean[1] and clean[5] == FAR
    spans = {r.doc_id: r.spans.split(",") for r in report(docs).collect()}
    for i in (0, 1):
        at = [k for k in range(len(CORPUS[i])) if CORPUS[i].startswith("Quillon", k)]
        assert {f"remove:{k}:{k + 7}" for k in at} <= set(spans[i])
