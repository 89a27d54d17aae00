"""Answer quality: faithfulness and relevancy of answers given their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.functions.vectors import cosine_similarity

SUPPORT_SHARE = 0.5


def ordered_contexts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, contexts): hit texts in hit order, an empty array without hits. A question has at most
    ``top_n`` hits, so the array is small."""
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_h")).select(
        "qid", F.transform("_h", lambda h: F.coalesce(h["text"], F.lit(""))).alias("contexts"))
    return questions.select("qid").join(found, "qid", "left").select(
        "qid", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))


def samples(questions: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, question, answer, contexts); a question without answer keeps a null answer."""
    return (
        questions.select("qid", "question").join(answers.select("qid", "answer"), "qid", "left")
        .join(contexts, "qid", "left")
        .select("qid", "question", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def judge_by_words(samples_df: DataFrame, share: float = SUPPORT_SHARE) -> DataFrame:
    """Default judge: (qid, claim_id, supported). A claim is a sentence of the answer, supported when
    at least ``share`` of its words occur in the contexts. Row-local: nothing is shuffled."""
    # Answer words that the contexts know: compared with each claim instead of all context words.
    answer = F.coalesce("answer", F.lit(""))
    known = F.array_intersect(_words(answer), _words(F.array_join("contexts", " ")))
    sentences = F.filter(F.split(answer, r"[.!?\n]+"), lambda s: F.size(_words(s)) > 0)
    # Two steps: next to a generator, expressions are evaluated once per generated row.
    judged = samples_df.select("qid", known.alias("_known"), sentences.alias("_claims"))
    claims = judged.select("qid", "_known", F.posexplode("_claims").alias("claim_id", "_claim"))
    words = _words(F.col("_claim"))
    covered = F.size(F.array_intersect(words, F.col("_known"))) / F.size(words)
    return claims.select("qid", "claim_id", (covered >= share).alias("supported"))


def faithfulness(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """Supported claims over claims; null without claims. Pre-aggregated before the shuffle."""
    rated = claims.groupBy("qid").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))
    return questions.select("qid").join(rated, "qid", "left")


def answer_relevancy(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """Mean cosine of the question's vector and the vectors of questions generated from its answer."""
    pairs = generated.select("qid", "gvec").join(questions.select("qid", "qvec"), "qid")
    rated = pairs.groupBy("qid").agg(F.avg(cosine_similarity(F.col("qvec"), F.col("gvec"))).alias("answer_relevancy"))
    return questions.select("qid").join(rated, "qid", "left")


def scores(questions: DataFrame, claims: DataFrame, generated: DataFrame) -> DataFrame:
    """Both measures per question; ``ok`` tells whether both could be computed."""
    both = faithfulness(questions, claims).join(answer_relevancy(questions, generated), "qid")
    return both.withColumn("ok", F.col("faithfulness").isNotNull() & F.col("answer_relevancy").isNotNull())


def shown(score: Column) -> Column:
    """Four decimals, or N/A. A score that is not a number counts as missing."""
    return F.when(score.isNull() | F.isnan(score), "N/A").otherwise(F.format_string("%.4f", score))


def score_measurements(scored: DataFrame) -> DataFrame:
    """Long (metric, value) for ``series_stats``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("faithfulness", "answer_relevancy")])
    return scored.select(F.explode(pairs).alias("p")).select("p.metric", "p.value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))
