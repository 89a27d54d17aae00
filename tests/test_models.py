"""Injected models, the default embedder, evaluation."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from pagelens.functions.media import image_part
from pagelens.operators.embedding import hashed_words
from pagelens.operators.evaluation import answer_relevancy, faithfulness, judge_by_words, ordered_contexts, samples, scores, shown
from pagelens.operators.inference import caption, generate, generate_vision, recognise_text
from pagelens.plans.answer import answer
from pagelens.plans.ingest import all_records


def test_generate(spark):
    def moody(prompt):
        if "fail" in prompt:
            raise ValueError("bad prompt")
        return None if "none" in prompt else prompt.upper()

    df = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, "none"), (4, None)], "qid int, prompt string")
    rows = {r.qid: r for r in generate(df, moody).collect()}
    assert (rows[1].answer, rows[1].ok, rows[1].error, rows[1].response_chars) == ("HELLO", True, None, 5)
    assert (rows[2].answer, rows[2].ok, rows[2].error, rows[2].response_chars) == (None, False, "ValueError: bad prompt", 0)
    assert (rows[3].answer, rows[3].ok) == (None, True)
    assert rows[4].ok is False and rows[4].prompt_chars == 0 and rows[1].elapsed_s >= 0


def test_vision_caption_ocr(spark):
    df = spark.createDataFrame([(1, "see", bytearray(b"abc")), (2, "see", bytearray(b"bad"))], "id int, prompt string, content binary")

    def captioner(content, *, mime):
        if content == b"bad":
            raise OSError("broken")
        return f"  {mime} {len(content)}\n"

    def ocr(content):
        return None if content == b"bad" else " " + "x" * 3000

    rows = df.select("id", caption(F.col("content"), F.lit("image/png"), captioner).alias("c"), recognise_text(F.col("content"), ocr).alias("o"))
    got = {r.id: r for r in rows.collect()}
    assert got[1].c == "image/png 3" and got[2].c == "" and len(got[1].o) == 2000 and got[2].o is None
    asked = df.select("id", "prompt", F.array(image_part(F.col("content"), F.lit("image/png")), image_part(F.col("content"), F.lit("image/gif"))).alias("images"))
    said = generate_vision(asked, lambda p, parts: f"{p} {[x['mime_type'] for x in parts]}").first()
    assert said.answer == "see ['image/png', 'image/gif']" and said.ok


def test_embedder(spark):
    texts = ["one two two", "", None, "ONE Two two", "a\tb\nc"]
    vectors = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_words()(F.col("t"))).collect()]
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64
    assert slot("one") != slot("two")
    assert math.isclose(vectors[0][slot("one")], 1 / math.sqrt(5), rel_tol=1e-6) and math.isclose(vectors[0][slot("two")], 2 / math.sqrt(5), rel_tol=1e-6)
    assert vectors[0] == vectors[3] and sum(vectors[1]) == sum(vectors[2]) == 0
    assert all(math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-5) for v in (vectors[0], vectors[4]))


def test_answer_end_to_end(spark):
    pages = spark.createDataFrame(
        [("a.pdf", 0, "1", "heads attend to words"), ("a.pdf", 1, "2", "tables of results"), ("b.pdf", 0, "1", "cooking pasta slowly")],
        "pdf_path string, page0 int, page_label string, text string")
    files = spark.createDataFrame([("a.pdf", "a" * 64), ("b.pdf", "b" * 64)], "pdf_path string, doc_hash string")
    records = all_records({"text": pages}, files)
    questions = spark.createDataFrame([(1, "heads attend"), (2, "cooking pasta")], "qid int, question string")
    got = {r.qid: r for r in answer(records, questions, lambda p: p.split("\n")[3], top_n=1).collect()}
    assert got[1].contexts == ["[pdf_text p1] heads attend to words\n(Source: a.pdf)"]
    assert got[1].prompt == " Question: heads attend\n\nContext:\n[pdf_text p1] heads attend to words\n(Source: a.pdf)   "
    assert got[2].answer == "[pdf_text p1] cooking pasta slowly" and got[2].ok


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, "q1", [1.0, 0.0]), (2, "q2", [0.0, 2.0]), (3, "q3", [0.0, 0.0])], "qid int, question string, qvec array<double>")
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "the cat sat on a mat"), (2, 1, None)], "qid int, pos int, text string")
    contexts = ordered_contexts(questions, hits)
    assert {r.qid: r.contexts for r in contexts.collect()} == {1: ["the cat sat on a mat", "second"], 2: [""], 3: []}
    answers = spark.createDataFrame([(1, "The cat sat. Dogs bark loudly!\n?"), (2, None)], "qid int, answer string")
    made = samples(questions, answers, contexts)
    assert {(r.qid, r.answer, len(r.contexts)) for r in made.collect()} == {(1, "The cat sat. Dogs bark loudly!\n?", 2), (2, None, 1), (3, None, 0)}
    claims = judge_by_words(made)
    assert [(r.qid, r.claim_id, r.supported) for r in claims.orderBy("claim_id").collect()] == [(1, 0, True), (1, 1, False)]
    assert {r.qid: r.faithfulness for r in faithfulness(questions, claims).collect()} == {1: 0.5, 2: None, 3: None}
    generated = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])], "qid int, gvec array<double>")
    assert {r.qid: r.answer_relevancy for r in answer_relevancy(questions, generated).collect()} == {1: 0.5, 2: 1.0, 3: None}
    assert {r.qid: r.ok for r in scores(questions, claims, generated).collect()} == {1: True, 2: False, 3: False}


def test_shown(spark):
    df = spark.createDataFrame([(0.5,), (None,), (float("nan"),), (1234.0,)], "v double")
    assert [r[0] for r in df.select(shown(F.col("v"))).collect()] == ["0.5000", "N/A", "N/A", "1234.0000"]
