"""Toxicity by multiple-instance learning.

Only documents carry labels. Each sentence s has the score p(s) = sigmoid(bias + sum of the weights of its distinct
words and word beginnings), a document has the noisy-or of its sentences, 1 - prod(1 - p(s)), and the weights are fitted so that the
noisy-or explains the documents' labels. The fitted sentence scores then point at the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.session import materialize, spread

# The classifier is fitted on at most this many labelled documents, the first by a hash of their id.
TRAIN_DOCS = 8000
# Words considered: in at least so many training documents, and of those the ones whose presence tells most
# about the label.
LEAST_DOCS = 4
WORDS = 4000
# Beginnings of words that are features besides whole words, so that an unseen inflection is known by its stem.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
# Penalties that keep the weights of rare words small.
LASSO = 2e-5
RIDGE = 1e-5
_SPLIT = {ord(c): "\n" for c in ".!?;\n\r  。！？"}
_BLANK = {ord(c): " " for c in "\t\x0b\x0c\"'()[]{}<>,:|*_#=+/\\~`^&%$@-—–“”‘’«»¿¡"}


def sentences(text: str | None) -> list[str]:
    """The text cut behind sentence marks, punctuation blanked, lower case; positions are kept: joined by one
    character they have the text's length."""
    plain = (text or "").translate(_SPLIT | _BLANK)
    low = plain.lower()
    if len(low) != len(plain):  # a few characters have longer lower-case forms
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in plain)
    return low.split("\n")


def features(words: list[str]) -> set[str]:
    """The distinct words, and their beginnings marked by a star."""
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def fit(
    labels: np.ndarray, sentences_of: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, words: list[str], steps: int = 300,
) -> tuple[dict[str, float], float]:
    """Weights and bias of the sentence score, by gradient descent on the noisy-or likelihood.

    ``labels`` and ``sentences_of`` (how many sentences) go by document, ``sizes`` (how many known features) by
    sentence; ``numbers`` are the features of all sentences in turn, places in ``words``.
    """
    y = labels.astype(float)
    doc = np.repeat(np.arange(len(y)), sentences_of)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    # Start where every document has the base rate, spread over its sentences.
    per = max(1.0, len(doc) / max(len(y), 1))
    theta = np.zeros(len(words) + 1)
    theta[-1] = np.log(np.expm1(-np.log1p(-rate) / per))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        s = np.bincount(row, theta[numbers], len(doc)) + theta[-1]
        p = 1 / (1 + np.exp(-s))
        total = np.bincount(doc, np.logaddexp(0, s), len(y))  # -log of the chance that no sentence is toxic
        pull = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        g_s = pull[doc] * p
        g = np.append(np.bincount(numbers, g_s[row], len(words)), g_s.sum()) / max(len(y), 1)
        g[:-1] += LASSO * np.sign(theta[:-1]) + RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return {w: float(x) for w, x in zip(words, theta, strict=False) if abs(x) > 1e-2}, float(theta[-1])


def _count_features(batches):
    """(feature, n0, n1): documents of either label that have it, pre-aggregated in the task."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: set[str] = set()
            for s in sentences(text):
                own.update(features(s.split()))
            for f in own:
                seen.setdefault(f, [0, 0])[label] += 1
    counts = [pa.array([n[k] for n in seen.values()], pa.int64()) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], ["feature", "n0", "n1"])


def _encoder(shared):
    def run(batches):
        number = shared.value
        for batch in batches:
            sizes, numbers = [], []
            for text in batch.column(1).to_pylist():
                found = [sorted(number[f] for f in features(words) if f in number) for s in sentences(text) if (words := s.split())]
                found = found or [[]]
                sizes.append([len(x) for x in found])
                numbers.append([n for x in found for n in x])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, kind), pa.array(numbers, kind)], ["y", "sizes", "numbers"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, float], float]:
    """Fit on labelled documents whose crc32(doc_id as text) mod 3 is not 1, at most ``train_docs`` of them.

    Rows of labels with a null id or label are left out, of repeated ones the largest label counts. Texts stay
    on the executors: tasks count features and number those of each sentence, and the driver gets the WORDS chosen
    features and the numbers.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .where(~_held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    )
    rows = materialize(spread(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")), "training")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = (float(n.get(k, 0)) for k in (0, 1))
    counts = rows.mapInArrow(_count_features, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.expr(f"n0 + n1 >= {LEAST_DOCS}"))
    lift = F.log((F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1)))
    told = F.abs(lift) * F.sqrt(F.least(F.expr("n0 + n1"), F.lit(50)))
    words = sorted(r["feature"] for r in counts.orderBy(told.desc(), "feature").limit(WORDS).select("feature").collect())
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    got = rows.mapInArrow(_encoder(shared), "y int, sizes array<int>, numbers array<int>").toArrow()

    def flat(column: str) -> np.ndarray:
        return got.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    order = [len(x) for x in got.column("sizes")]
    return fit(got.column("y").to_numpy(), np.array(order, np.int64), flat("sizes"), flat("numbers"), words)


def _held_out(name: str):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score (0 to 1) and ``offending``: array of (start, end, score) of the sentences that are
    toxic rather than not, by score. Null and empty texts score like a sentence without words. Whole texts, row by row."""
    names = list(keep)
    read = names if text in names else [*names, text]
    at_text = read.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        known = frozenset(weights)
        stems = [(n, {w[:-1]: w for w in weights if len(w) == n + 1 and w[-1] == "*"}) for n in STEMS]
        base = float(np.logaddexp(0, bias))
        for batch in batches:
            scores, found = [], []
            for value in batch.column(at_text).to_pylist():
                total, spans, at = 0.0, [], 0
                for s in sentences(value):
                    words = s.split()
                    hit = known.intersection(words)
                    for n, stem in stems:
                        if stem and (some := stem.keys() & {w[:n] for w in words if len(w) > n}):
                            hit = hit.union([stem[x] for x in some])
                    if hit:
                        x = bias + sum(weights[w] for w in sorted(hit))
                        total += float(np.logaddexp(0, x))
                        if x >= 0:
                            spans.append({"start": at, "end": at + len(s), "score": 1 / (1 + np.exp(-x))})
                    else:
                        total += base if words else 0.0
                    at += len(s) + 1
                scores.append(-float(np.expm1(-(total or base))))
                found.append(sorted(spans, key=lambda s: (-s["score"], s["start"])))
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(scores, pa.float64()), pa.array(found, kinds)], [*names, "score", "offending"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*read).mapInArrow(
        run, f"{kept}, score double, offending array<struct<start:int,end:int,score:double>>")


def report(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    scored = score(docs, learn(docs, labels, train_docs))
    return scored.select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offending"))


def keep_clean(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents that score below THRESHOLD, the same columns, in one pass over their rows."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_rest"), "text")
    marked = score(rows, learn(docs, labels, train_docs), keep=("_rest", "text"))
    return marked.where(F.col("score") < THRESHOLD).select("_rest.*", "text").select(*docs.columns)
