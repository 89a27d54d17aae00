"""Evaluation of answers and checks of model output."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pagelens.catalog import roles as R
from pagelens.catalog.registry import query, table
from pagelens.functions.logs import quality_band
from pagelens.functions.responses import checked_response
from pagelens.functions.text import char_count
from pagelens.operators.evaluation import (
    answer_relevancy, faithfulness, judge_by_words, ordered_contexts, samples, score_measurements, scores, shown,
)
from pagelens.operators.inference import generate
from pagelens.operators.search import retrieve, with_records
from pagelens.operators.series import series_stats
from pagelens.plans.answer import evaluate


@query("context_list", f"""WITH {R.hits_sql(R.L2_SQL)}
SELECT qid, count(*) AS n, string_agg(coalesce(c.text, ''), '|' ORDER BY pos) AS contexts FROM hits h JOIN corpus c USING (id) GROUP BY qid""")
def context_list(spark, sf_dir):
    records, questions = R.records(spark, sf_dir), R.vector_questions(spark, sf_dir)
    hits = with_records(retrieve(records, questions), records, "text")
    return ordered_contexts(questions, hits).select(
        "qid", F.size("contexts").cast("bigint").alias("n"), F.array_join("contexts", "|").alias("contexts"))


# Context of a question: the documents whose number is the conversation's.
def _contexts(spark, sf_dir):
    questions = R.user_questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    hits = questions.select("qid", F.expr("qid div 1000").alias("conv_id")).join(docs, "conv_id").select(
        "qid", "text", F.lit(1).alias("pos"))
    return questions, ordered_contexts(questions, hits)


SAMPLES_SQL = f"""{R.QA_SQL}, samples AS (SELECT q.qid, question, answer, d.text AS context FROM questions q
  LEFT JOIN answers a ON a.qid = q.qid LEFT JOIN documents d ON d.doc_id = q.qid // 1000)"""


@query("qa_samples", f"WITH {SAMPLES_SQL} SELECT qid, question, answer, CAST(context IS NOT NULL AS INTEGER) AS n_contexts, context AS contexts FROM samples")
def qa_samples(spark, sf_dir):
    questions, contexts = _contexts(spark, sf_dir)
    return samples(questions, R.given_answers(spark, sf_dir), contexts).select(
        "qid", "question", "answer", F.size("contexts").alias("n_contexts"),
        F.get("contexts", F.lit(0)).alias("contexts"))


CLAIMS_SQL = f"""WITH {SAMPLES_SQL},
sentences AS (SELECT qid, context, unnest(list_filter(regexp_split_to_array(coalesce(answer, ''), '[.!?\\n]+'), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))) AS claim,
   generate_subscripts(list_filter(regexp_split_to_array(coalesce(answer, ''), '[.!?\\n]+'), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]')), 1) - 1 AS claim_id FROM samples),
worded AS (SELECT qid, claim_id, list_distinct(regexp_extract_all(lower(claim), '[\\p{{L}}\\p{{N}}]+')) AS w,
  list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[\\p{{L}}\\p{{N}}]+')) AS known FROM sentences),
claims AS (SELECT qid, claim_id, len(list_intersect(w, known)) / len(w) >= 0.5 AS supported FROM worded)"""


def _judged(spark, sf_dir):
    questions, contexts = _contexts(spark, sf_dir)
    return questions, judge_by_words(samples(questions, R.given_answers(spark, sf_dir), contexts))


@query("claim_support", CLAIMS_SQL + " SELECT qid, claim_id, supported FROM claims")
def claim_support(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("qid", F.col("claim_id").cast("bigint").alias("claim_id"), "supported")


# Claims given by verdict tables: a document's quality label is the verdict, 8 documents are one answer.
@query("faithfulness", """SELECT doc_id // 8 AS qid, round(avg(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END), 6) AS faithfulness
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def faithfulness_query(spark, sf_dir):
    questions = table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("qid")).distinct()
    claims = table(spark, sf_dir, "labels").select(
        F.expr("doc_id div 8").alias("qid"), F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("supported"))
    return faithfulness(questions, claims).select("qid", F.round("faithfulness", 6).alias("faithfulness"))


def _generated(spark, sf_dir):
    """Questions generated from an answer: the vectors of the next three numbers."""
    vectors = R.vector_questions(spark, sf_dir)
    ahead = vectors.select("qid", F.explode(F.sequence(F.col("qid") + 1, F.col("qid") + 3)).alias("gen_id"))
    return vectors, ahead.join(vectors.select(F.col("qid").alias("gen_id"), F.col("qvec").alias("gvec")), "gen_id")


RELEVANCY_SQL = """relevancy AS (SELECT x.vec_id AS qid, avg(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS answer_relevancy
  FROM embeddings x LEFT JOIN embeddings y ON y.vec_id BETWEEN x.vec_id + 1 AND x.vec_id + 3 GROUP BY 1)"""


@query("answer_relevancy", f"WITH {RELEVANCY_SQL} SELECT qid, round(answer_relevancy, 6) + 0.0 AS answer_relevancy FROM relevancy")
def answer_relevancy_query(spark, sf_dir):
    vectors, generated = _generated(spark, sf_dir)
    return answer_relevancy(vectors, generated).select("qid", F.round("answer_relevancy", 6).alias("answer_relevancy"))


SCORES_SQL = f"""WITH {RELEVANCY_SQL},
scored AS (SELECT qid, f AS faithfulness, answer_relevancy FROM relevancy LEFT JOIN
  (SELECT doc_id AS qid, avg(CAST(quality = 1 AS INTEGER)) AS f FROM labels GROUP BY 1) USING (qid))"""


def _scored(spark, sf_dir):
    vectors, generated = _generated(spark, sf_dir)
    claims = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("supported"))
    return scores(vectors, claims, generated)


@query("metric_display", SCORES_SQL + """ SELECT qid, coalesce(printf('%.4f', faithfulness), 'N/A') AS faithfulness,
  coalesce(printf('%.4f', CAST(answer_relevancy AS DOUBLE)), 'N/A') AS answer_relevancy, faithfulness IS NOT NULL AND answer_relevancy IS NOT NULL AS ok FROM scored""")
def metric_display(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "qid", shown(F.col("faithfulness")).alias("faithfulness"), shown(F.col("answer_relevancy")).alias("answer_relevancy"), "ok")


@query("eval_summary", SCORES_SQL + """,
tall AS (SELECT 'faithfulness' AS metric, faithfulness AS v FROM scored UNION ALL SELECT 'answer_relevancy', answer_relevancy FROM scored),
s AS (SELECT metric, count(v) AS n, avg(v) AS a, median(v) AS m, min(v) AS lo, max(v) AS hi, count(*) FILTER (v < 0.7) AS n_low FROM tall GROUP BY 1)
SELECT metric, n, round(a, 6) AS avg_value, round(m, 6) AS median_value, round(lo, 6) AS min_value, round(hi, 6) AS max_value, n_low,
  CASE WHEN a >= 0.9 THEN 'Excellent' WHEN a >= 0.7 THEN 'Good' WHEN a >= 0.5 THEN 'Fair' ELSE 'Poor' END AS band FROM s""")
def eval_summary(spark, sf_dir):
    stats = series_stats(score_measurements(_scored(spark, sf_dir)), flag=F.col("value") < 0.7)
    rounded = [F.round(c, 6).alias(c) for c in ("avg_value", "median_value", "min_value", "max_value")]
    return stats.select("metric", "n", *rounded, F.col("n_flagged").alias("n_low"), quality_band(F.col("avg_value")).alias("band"))


_REPLY = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("note", T.StringType(), True), T.StructField("size", T.IntegerType(), True)])


@query("response_validate", """SELECT event_id, event_id % 10 > 5 AS valid,
  CASE event_id % 10 WHEN 0 THEN concat('Sure: ', props) WHEN 1 THEN replace(props, '}', '') WHEN 2 THEN replace(props, '"k"', '"n"')
    WHEN 3 THEN concat(props, ' and ', props) WHEN 4 THEN concat(props, props) WHEN 5 THEN replace(props, '}', ', "size": "large"}')
    ELSE replace(props, ' ', '') END AS response FROM events""")
def response_validate(spark, sf_dir):
    case = F.col("event_id") % 10
    raw = (
        F.when(case == 0, F.concat(F.lit("Sure: "), "props")).when(case == 1, F.replace("props", F.lit("}"), F.lit("")))
        .when(case == 2, F.replace("props", F.lit('"k"'), F.lit('"n"')))
        .when(case == 3, F.concat("props", F.lit(" and "), "props")).when(case == 4, F.concat("props", "props"))
        .when(case == 5, F.replace("props", F.lit("}"), F.lit(', "size": "large"}'))).otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", checked_response(raw, _REPLY).alias("r")).select(
        "event_id", "r.valid", "r.response")


# A model that answers with JSON, sometimes with words around it: the schema is checked on its answers.
@query("generate_schema", """SELECT event_id, event_id % 4 <> 0 AS valid,
  CASE WHEN event_id % 4 = 0 THEN concat('Here: ', props) ELSE replace(props, ' ', '') END AS answer FROM events WHERE event_type = 'error'""")
def generate_schema(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "props").alias("prompt"))

    def model(prompt):
        number, props = prompt.split("|", 1)
        return props if int(number) % 4 else f"Here: {props}"

    return generate(asked, model, schema=_REPLY).select("event_id", "valid", "answer")


# The whole evaluation with stand-in models: every sentence is a claim, long ones count as supported; the judge
# refuses answers with the letter sequence "ou". Vectors are two counts of the text.
@query("evaluate_answers", f"""WITH {SAMPLES_SQL},
state AS (SELECT qid, question, answer, CASE WHEN answer IS NULL THEN 'no answer' WHEN contains(answer, 'ou') THEN 'ValueError: refused' END AS error FROM samples),
claims AS (SELECT qid, avg(CASE WHEN length(c) > 40 THEN 1.0 ELSE 0.0 END) AS f FROM (
  SELECT qid, unnest(string_split(answer, '.')) AS c FROM state WHERE error IS NULL) WHERE length(c) > 0 GROUP BY qid),
made AS (SELECT qid, question, unnest([answer[1:12], answer[-7:]]) AS g FROM state WHERE error IS NULL),
near AS (SELECT qid, avg((length(question) * length(g) + 1.0 + length(replace(question, 'e', '')) * length(replace(g, 'e', ''))) /
  (sqrt(length(question) ^ 2 + 1.0 + length(replace(question, 'e', '')) ^ 2) * sqrt(length(g) ^ 2 + 1.0 + length(replace(g, 'e', '')) ^ 2))) AS r FROM made GROUP BY qid)
SELECT qid, round(f, 6) AS faithfulness, round(r, 6) AS answer_relevancy, error IS NULL AND f IS NOT NULL AND r IS NOT NULL AS ok, error
FROM state LEFT JOIN claims USING (qid) LEFT JOIN near USING (qid)""")
def evaluate_answers(spark, sf_dir):
    questions = R.user_questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    hits = questions.select("qid", F.expr("qid div 1000").alias("conv_id")).join(docs, "conv_id").select("qid", "text", F.lit(1).alias("pos"))

    def judge(question, answer, contexts):
        if "ou" in answer:
            raise ValueError("refused")
        return [len(c) > 40 for c in answer.split(".") if c]

    def embed(text):
        return F.array(F.length(text).cast("double"), F.lit(1.0), F.length(F.replace(text, F.lit("e"), F.lit(""))).cast("double"))

    scored = evaluate(questions, R.given_answers(spark, sf_dir), hits, judge=judge, question_model=lambda a: [a[:12], a[-7:]], embed=embed)
    return scored.select("qid", F.round("faithfulness", 6).alias("faithfulness"), F.round("answer_relevancy", 6).alias("answer_relevancy"), "ok", "error")


@query("prompt_lengths", f"WITH {SAMPLES_SQL} SELECT qid, CAST(length(question) AS INTEGER) AS prompt_chars, CAST(coalesce(length(answer), 0) AS INTEGER) AS response_chars FROM samples")
def prompt_lengths(spark, sf_dir):
    asked = R.user_questions(spark, sf_dir).join(R.given_answers(spark, sf_dir), "qid", "left")
    return asked.select("qid", char_count(F.col("question")).alias("prompt_chars"), char_count(F.col("answer")).alias("response_chars"))
