"""Top-k nearest records per question and collection, and the merge over collections.

Input: corpus (collection, id, embedding) and questions (qid, qvec). Output: (qid, collection, id,
score, rank); lower scores are nearer and equal scores are ordered by id.

* Few questions (their matrix passes a size check): the matrix is broadcast and the corpus is read
  once, without a shuffle. Each task keeps its best k per question; a window merges the tasks.
* Many questions: blocks of questions meet slices of records (``operators/grid.py``). A task keeps a block and streams its slice
  through, so k hits leave it for a question and slice, however many records there are.
* More than may be broadcast: corpus and questions are grouped by nearest pivot (``operators/cells.py``), and only cells that
  can hold one of a question's k nearest are compared. The result is still exact. Cells are cut into slices and questions into
  blocks, so neither a popular cell nor a large batch of questions ends in one task. Where cells leave little out, as a sample of
  the questions shows, blocks meet slices here too.
* ``recall=r`` visits as many of the nearest cells as hold a share r of the neighbours of sampled questions;
  ``probes=n`` visits n: approximate search.
* ``nearest_stored`` searches cells that were stored at ingest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pagelens.model import COLLECTIONS
from pagelens.operators.cells import GROUP_BYTES, Cells, arrow_schema, hit_rows, hit_schema, id_array, matrix
from pagelens.operators.grid import search_grid
from pagelens.operators.topk import NearestSoFar
from pagelens.session import materialize

DEFAULT_K = 4
DEFAULT_TOP_N = 6
BROADCAST_BYTES = 64 << 20
HIT_BYTES = 256  # generous size of one hit in memory
MERGE_ROWS = 10_000_000
MANY_QUESTIONS = 4096
LEFT_OUT = 0.5  # share of the records that cells must spare a question to be worth their cost


def k_or_default(k: int | None) -> int:
    return k or DEFAULT_K


def _rank(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid", "collection").orderBy("score", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(
    corpus: DataFrame, questions: DataFrame, k: int | None = None, metric: str = "l2sq", *,
    recall: float | None = None, probes: int | None = None, broadcast_bytes: int | None = None,
    pivots: int | None = None, group_bytes: int = GROUP_BYTES, written: bool = False,
) -> DataFrame:
    """The ``k`` nearest records per question and collection. ``qid`` and, per collection, ``id`` are
    keys. Records without a vector, or with one that has a missing or infinite element, are not found.
    Questions above a given ``broadcast_bytes`` are always asked by cells. ``written`` promises that the corpus is read from where it
    was written, vectors and all, so that it is not written again."""
    return _nearest(corpus, questions, k, metric, recall, probes, broadcast_bytes, pivots, group_bytes, written)[0]


def nearest_stored(
    cells: Cells, questions: DataFrame, k: int | None = None, *, recall: float | None = None, probes: int | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``nearest`` over cells that are there already, e.g. ``StoredCells(spark, path).load()``."""
    k = k_or_default(k)
    questions = materialize(questions.select("qid", "qvec").where(F.col("qvec").isNotNull()), "questions")
    if recall is not None:
        probes = cells.probes_for(questions, k, recall)
    return _rank(cells.search(questions, k, probes, group_bytes), k)


def _nearest(
    corpus: DataFrame, questions: DataFrame, k: int | None, metric: str = "l2sq", recall: float | None = None,
    probes: int | None = None, broadcast_bytes: int | None = None, pivots: int | None = None, group_bytes: int = GROUP_BYTES,
    written: bool = False,
) -> tuple[DataFrame, int | None]:
    """Hits, and the number of questions where it had to be counted for the size check."""
    k = k_or_default(k)
    given = corpus.select("collection", "id", "embedding")
    corpus = given.where(F.col("embedding").isNotNull())
    questions = questions.select("qid", "qvec").where(F.col("qvec").isNotNull())
    probe = questions.first()
    schema = hit_schema(corpus, questions)
    if probe is None:
        return _rank(corpus.sparkSession.createDataFrame([], schema), k), 0
    dimensions = len(probe["qvec"])
    by_cells = broadcast_bytes is not None or pivots is not None
    if probes is None and recall is None:
        fits = (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes) // (8 * dimensions)
        # At most one row more than a scan answers reaches the driver.
        most = min(fits, MANY_QUESTIONS)
        taken = questions.limit(most + 1).toArrow()
        if taken.num_rows <= most:
            return _rank(_scan(corpus, taken, k, metric, schema, dimensions), k), taken.num_rows
        questions = materialize(questions, "questions")
        asked = questions.count()
        if asked <= fits:
            # Written first: the grid reads the records more than once, and what makes their vectors runs once, not for the filter as well.
            if not written:
                corpus = materialize(given, "corpus").where(F.col("embedding").isNotNull())
            return _rank(search_grid(corpus, questions, k, metric, dimensions), k), asked
    cells = Cells.build(corpus, metric, dimensions, pivots)
    if cells is None:
        return _rank(corpus.sparkSession.createDataFrame([], schema), k), None
    if probes is None and recall is None and not by_cells and cells.left_out(questions, k) < LEFT_OUT:
        return _rank(search_grid(cells.placed, questions, k, metric, dimensions), k), asked
    return nearest_stored(cells, questions, k, recall=recall, probes=probes, group_bytes=group_bytes), None


def _scan(
    corpus: DataFrame, questions: pa.Table, k: int, metric: str, schema: T.StructType, dimensions: int,
) -> DataFrame:
    spark = corpus.sparkSession
    qids = questions.column("qid").combine_chunks()
    shared = spark.sparkContext.broadcast(matrix(questions.column("qvec"), dimensions))
    arrow = arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, NearestSoFar] = {}
        for batch in batches:
            collections, ids = batch.column("collection"), id_array(batch.column("id"))
            vectors = matrix(batch.column("embedding"), dimensions)
            names = np.asarray(collections.to_numpy(zero_copy_only=False))
            for name in collections.unique().to_pylist():
                chosen = names == name
                if name not in best:
                    best[name] = NearestSoFar(shared.value, k, metric)
                best[name].add(ids[chosen], vectors[chosen])
        for name, found in best.items():
            if len(found.row):
                yield hit_rows(qids, name, found, arrow)

    # A task emits k rows per question however much it reads. Only where that would be too many rows to merge are
    # partitions read together; a few questions leave the scan, and an embedder ahead of it, as parallel as it comes.
    tasks = max(2 * spark.sparkContext.defaultParallelism, MERGE_ROWS // (k * max(1, questions.num_rows)))
    return corpus.coalesce(tasks).mapInArrow(search, schema)


def merge_collections(
    hits: DataFrame, top_n: int = DEFAULT_TOP_N, collections: Sequence[str] = COLLECTIONS,
) -> DataFrame:
    """Hits of all collections by score, first ``top_n`` per question, numbered from 1 in ``pos``.
    Equal scores keep the order of ``collections``, then the order inside the collection."""
    ordinal = F.coalesce(*[F.when(F.col("collection") == c, i) for i, c in enumerate(collections)], F.lit(len(collections)))
    w = Window.partitionBy("qid").orderBy("score", ordinal, "rank")
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_n)


def retrieve(
    corpus: DataFrame, questions: DataFrame, *, k_each: int | None = None, top_n: int = DEFAULT_TOP_N,
    collections: Sequence[str] = COLLECTIONS, **search,
) -> DataFrame:
    """The ``top_n`` nearest records of each question over ``collections``, ``k_each`` from each.

    Where the counted questions bound the hits, they carry a broadcast hint: joining them to the records
    then scans the records instead of shuffling all their text. Without that bound they carry none.
    """
    chosen = corpus.where(F.col("collection").isin(*collections))
    found, asked = _nearest(chosen, questions, k_each, **search)
    hits = merge_collections(found, top_n, collections)
    bounded = asked is not None and asked * top_n * HIT_BYTES <= BROADCAST_BYTES
    return F.broadcast(hits) if bounded else hits


def with_records(hits: DataFrame, records: DataFrame, *columns: Column | str) -> DataFrame:
    """Fetch text and metadata of the final hits. Search itself moves ids and scores only."""
    wanted = [c for c in (columns or records.columns) if c not in ("collection", "id", "embedding")]
    return records.select("collection", "id", *wanted).join(hits, ["collection", "id"]).select(
        *hits.columns, *wanted)
