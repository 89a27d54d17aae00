"""Cells of a corpus around pivots: what a large search visits, made for one search or stored beside the records.

Every record lies in the cell of its nearest pivot. With each cell's radius the triangle inequality shows which cells can hold
one of a question's k nearest, and only those are visited, so the search is exact. The three metrics share one geometry:

* ``l2sq``: vectors as they are.
* ``cosine``: vectors of length one.
* ``ip``: inner products obey no triangle inequality, so the greatest of them is turned into the nearest neighbour: a record
  v gets one more element sqrt(M^2 - |v|^2), M the greatest length of all, a question gets 0. Then
  |q - v|^2 = |q|^2 + M^2 - 2 q.v, whose order is that of the inner products.

Approximate search visits only the nearest cells. How many is found by asking a sample of the questions exactly first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagelens.model import layout
from pagelens.operators.topk import NearestSoFar, unit
from pagelens.session import materialize

MIN_PIVOTS = 128
MAX_PIVOTS = 8192  # distances of an Arrow batch to all pivots stay below 300 MB
GROUP_BYTES = 32 << 20  # vectors that a task compares at once
TASK_BYTES = 32 << 20  # vectors of one slice of records or one block of questions in a task
TASKS_PER_CORE = 8
MIN_TILE = 512  # fewer vectors at once cost more time than they save memory
ROUTED = 2048  # questions whose distances to all pivots are held at once
SAMPLE = 256  # questions that are asked exactly to find the number of probes


def matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    """Arrow list column without null lists to a float matrix; a vector of another length is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths()
    if len(column) and pc.min_max(lengths).as_py() != {"min": dimensions, "max": dimensions}:
        raise ValueError(f"every vector must have {dimensions} elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), dimensions)


def id_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return values.astype("U") if values.dtype == object else values


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def hit_rows(qids: pa.Array, collection: str, best: NearestSoFar, schema: pa.Schema) -> pa.RecordBatch:
    names = pa.array([collection] * len(best.row), pa.string())
    return pa.RecordBatch.from_arrays(
        [qids.take(pa.array(best.row)).cast(schema.field("qid").type), names,
         pa.array(best.id).cast(schema.field("id").type), pa.array(best.score)], schema=schema)


def hit_schema(corpus: DataFrame, questions: DataFrame) -> T.StructType:
    return layout(qid=questions.schema["qid"].dataType, collection=T.StringType(),
                  id=corpus.schema["id"].dataType, score=T.DoubleType())


@dataclass(frozen=True)
class Space:
    """The geometry of a metric around its pivots. ``longest`` is M for ``ip``, else 0."""

    metric: str
    dimensions: int
    longest: float
    centres: np.ndarray

    def points(self, vectors: np.ndarray, records: bool) -> np.ndarray:
        if self.metric == "cosine":
            return unit(vectors)
        if self.metric != "ip":
            return vectors
        more = np.zeros(len(vectors))
        if records:
            squared = (vectors * vectors).sum(axis=1)
            more = np.sqrt(np.maximum(self.longest ** 2 - squared, 0.0))
            more[~np.isfinite(squared)] = np.nan
        return np.hstack([vectors, more[:, None]])

    def gaps(self, vectors: np.ndarray, records: bool) -> np.ndarray:
        """Distances to all pivots."""
        v, c = self.points(vectors, records), self.centres
        squared = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (v @ c.T)
        return np.sqrt(np.maximum(squared, 0.0))

    def visited(self, gaps: np.ndarray, cells: pd.DataFrame, k: int, probes: int | None = None) -> np.ndarray:
        """Mask (questions x cells) of the cells of one collection to visit: the nearest ``probes``, or all that can hold one
        of the k nearest."""
        to_pivot = gaps[:, cells["cell"].to_numpy()]
        if probes is not None:
            return _nearest_places(to_pivot, probes)
        radius, n = cells["radius"].to_numpy()[None, :], cells["n"].to_numpy()
        farthest = to_pivot + radius
        if farthest.shape[1] > k and n.min() < k:  # no cell is empty: k of them hold k records
            order = np.argpartition(farthest, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(order, np.take_along_axis(farthest, order, axis=1).argsort(axis=1), axis=1)
        elif n.min() < k:
            order = farthest.argsort(axis=1)
        else:
            order = farthest.argmin(axis=1)[:, None]
        filled = np.cumsum(n[order], axis=1) >= k
        at = np.where(filled.any(axis=1), filled.argmax(axis=1), order.shape[1] - 1)
        rows = np.arange(len(farthest))
        bound = farthest[rows, order[rows, at]]
        # Rounding: a distance is the root of a difference of squares, of the size of the longest vector for ``ip``.
        slack = 1e-7 * self.longest if self.metric == "ip" else 1e-9
        return to_pivot - radius <= bound[:, None] * (1 + 1e-9) + slack


def _places(to_pivot: np.ndarray) -> np.ndarray:
    """For each question the place of every cell in the order of distance."""
    return to_pivot.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def _nearest_places(to_pivot: np.ndarray, n: int) -> np.ndarray:
    """Mask of the first ``n`` places of each question."""
    if n >= to_pivot.shape[1]:
        return np.ones(to_pivot.shape, dtype=bool)
    last = np.partition(to_pivot, n - 1, axis=1)[:, n - 1:n]
    nearer, tied = to_pivot < last, to_pivot == last
    return nearer | tied & (tied.cumsum(axis=1) <= n - nearer.sum(axis=1, keepdims=True))


def pick_space(corpus: DataFrame, metric: str, dimensions: int, pivots: int | None) -> Space | None:
    """Pivots by a repeatable choice, about the square root of the corpus, so that cells and their number grow alike. Exact
    results do not hang on the choice, only the cost does. None if no record has a usable vector."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    if metric == "cosine":
        usable = usable & F.exists("embedding", lambda x: x != 0)
    squared = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    counted = corpus.where(usable).agg(F.count(F.lit(1)).alias("n"), F.max(squared).alias("longest")).first()
    if not counted["n"]:
        return None
    if pivots is None:
        pivots = min(max(MIN_PIVOTS, math.isqrt(counted["n"])), MAX_PIVOTS)
    chosen = corpus.where(usable).orderBy(F.md5(F.col("id").cast("string")), "id").select("embedding").limit(pivots)
    longest = math.sqrt(counted["longest"]) * (1 + 1e-12) if metric == "ip" else 0.0
    bare = Space(metric, dimensions, longest, np.empty((0, 0)))
    return Space(metric, dimensions, longest, bare.points(matrix(chosen.toArrow().column("embedding"), dimensions), True))


def place(corpus: DataFrame, space: Space) -> DataFrame:
    """The rows with a usable vector, with their ``cell`` and ``reach``, the distance to its pivot."""
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    arrow = arrow_schema(schema)
    shared = corpus.sparkSession.sparkContext.broadcast(_plain(space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(*shared.value)
        for batch in batches:
            if batch.num_rows:
                gaps = space.gaps(matrix(batch.column("embedding"), space.dimensions), True)
                usable = np.isfinite(gaps).all(axis=1)
                gaps, batch = gaps[usable], batch.filter(pa.array(usable))
                cell = gaps.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype("int32")), pa.array(gaps[np.arange(len(cell)), cell])], schema=arrow)

    return corpus.mapInArrow(run, schema)


def _plain(space: Space) -> tuple:
    """Broadcasts are read where this package may not be installed: plain types only. Pivots are at most MAX_PIVOTS vectors."""
    return space.metric, space.dimensions, space.longest, space.centres


def cell_stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("collection", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"))


@dataclass(frozen=True)
class Cells:
    """Records (collection, id, embedding, cell, reach) around the pivots of ``space``, and (collection, cell, n, radius)."""

    placed: DataFrame
    space: Space
    stats: pd.DataFrame

    @staticmethod
    def build(corpus: DataFrame, metric: str, dimensions: int, pivots: int | None = None) -> Cells | None:
        """For one search. The corpus is written once, so that what makes its vectors runs once."""
        stored = materialize(corpus.select("collection", "id", "embedding"), "corpus")
        space = pick_space(stored, metric, dimensions, pivots)
        if space is None:
            return None
        placed = materialize(place(stored, space), "cells")
        # One row per collection and cell: at most pivots x collections rows reach the driver.
        return Cells(placed, space, cell_stats(placed).orderBy("collection", "cell").toPandas())

    def probes_for(self, questions: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> int:
        """How many of the nearest cells hold at least ``recall`` of the true neighbours, counted on ``sample`` questions (the first by
        a hash of qid) that are asked exactly. At most sample x k x collections rows reach the driver."""
        asked = questions.orderBy(F.md5(F.col("qid").cast("string")), "qid").limit(sample).toArrow()
        spark = self.placed.sparkSession
        chosen = materialize(spark.createDataFrame(asked, questions.schema), "sample")
        exact = self.search(chosen, k).join(self.placed.select("collection", "id", "cell"), ["collection", "id"])
        true = exact.select("qid", "collection", "cell").toPandas()
        qids = asked.column("qid").to_pylist()
        gaps = self.space.gaps(matrix(asked.column("qvec"), self.space.dimensions), False)
        needed = []
        for collection, cells in self.stats.groupby("collection"):
            places = _places(gaps[:, cells["cell"].to_numpy()])
            row = {q: i for i, q in enumerate(qids)}
            column = {c: i for i, c in enumerate(cells["cell"])}
            mine = true[true["collection"] == collection]
            needed += [places[row[q], column[c]] + 1 for q, c in zip(mine["qid"], mine["cell"], strict=True)]
        if not needed:
            return 1
        return int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])

    def left_out(self, questions: DataFrame, k: int, sample: int = SAMPLE) -> float:
        """Share of the records that an exact search need not compare with a question, over ``sample`` questions (the first by a hash of
        qid). It chooses the way of a search only, never what is found."""
        asked = questions.orderBy(F.md5(F.col("qid").cast("string")), "qid").limit(sample).toArrow()
        vectors = matrix(asked.column("qvec"), self.space.dimensions)
        held = self._held()
        compared = sum(float((mask @ held[c][1]).sum()) for c, _, mask in _masks(self.space, held, vectors, k, None))
        return 1.0 - compared / max(1.0, len(vectors) * float(self.stats["n"].sum()))

    def visits(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(qid, qvec, collection, cell): the cells each question has to visit."""
        schema = layout(qid=questions.schema["qid"].dataType, qvec=T.ArrayType(T.DoubleType()), collection=T.StringType(),
                        cell=T.IntegerType())
        arrow = arrow_schema(schema)
        shared = questions.sparkSession.sparkContext.broadcast((_plain(self.space), self._held()))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, held = Space(*shared.value[0]), shared.value[1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for collection, number, mask in _masks(space, held, matrix(batch.column("qvec"), space.dimensions), k, probes):
                    row, col = np.nonzero(mask)
                    for a in range(0, len(row), 4096):
                        some = row[a:a + 4096]
                        picked = batch.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays(
                            [picked.column("qid"), picked.column("qvec").cast(pa.list_(pa.float64())),
                             pa.array([collection] * len(some), pa.string()), pa.array(number[col[a:a + 4096]].astype("int32"))],
                            schema=arrow)

        return questions.select("qid", "qvec").mapInArrow(route, schema)

    def _held(self) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {c: (g["cell"].to_numpy(), g["n"].to_numpy(), g["radius"].to_numpy()) for c, g in self.stats.groupby("collection")}

    def _block_visits(self, blocks: DataFrame, k: int, probes: int | None) -> DataFrame:
        """(block, collection, cell): the cells that any question of a block visits, from (block, qvec). However many questions,
        a task gives a row for each of its blocks and cells at most."""
        schema = layout(block=T.IntegerType(), collection=T.StringType(), cell=T.IntegerType())
        arrow = arrow_schema(schema)
        shared = blocks.sparkSession.sparkContext.broadcast((_plain(self.space), self._held()))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, held = Space(*shared.value[0]), shared.value[1]
            visited: dict[tuple[int, str], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = batch.column("block").to_numpy()
                for collection, _, mask in _masks(space, held, matrix(batch.column("qvec"), space.dimensions), k, probes):
                    for b in np.unique(block):
                        any_of = mask[block == b].any(axis=0)
                        visited[b, collection] = visited.get((b, collection), False) | any_of
            for (b, collection), any_of in visited.items():
                number = held[collection][0][any_of].astype("int32")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(number), b, dtype="int32")), pa.array([collection] * len(number), pa.string()), pa.array(number)],
                    schema=arrow)

        return blocks.select("block", "qvec").mapInArrow(route, schema).distinct()

    def _grid(self, n_questions: int, cores: int) -> tuple[int, int]:
        """Numbers of question blocks and of records in a slice: blocks x slices is some tasks for each core, the least is sent
        for them, and neither side of a task is larger than TASK_BYTES."""
        most = max(1, TASK_BYTES // (8 * self.space.dimensions))
        n_records = max(1, int(self.stats["n"].sum()))
        blocks = max(1, math.ceil(n_questions / most), round(math.sqrt(TASKS_PER_CORE * cores * n_questions / n_records)))
        slices = max(math.ceil(n_records / most), math.ceil(TASKS_PER_CORE * cores / blocks))
        return min(blocks, max(1, n_questions)), math.ceil(n_records / slices)

    def search(
        self, questions: DataFrame, k: int, probes: int | None = None, group_bytes: int = GROUP_BYTES,
    ) -> DataFrame:
        """(qid, collection, id, score): at least the k nearest of each question and collection, unranked.

        Questions are dealt into blocks, records by their cell into slices, and a task compares a block with a slice: each
        question with the cells it visits. A record goes out once for each block that visits its cell, and a question
        once for each slice with such a cell, so what is sent does not grow with the visits of single questions.
        """
        space, spark = self.space, self.placed.sparkSession
        tile = max(MIN_TILE, group_bytes // (8 * space.dimensions))
        questions = questions.select("qid", "qvec")
        n_blocks, slice_rows = self._grid(questions.count(), spark.sparkContext.defaultParallelism)
        dealt = questions.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int"))
        wanted = materialize(self._block_visits(dealt, k, probes), "visits")
        # Small cells share a slice, a large one has several. At most pivots x collections rows.
        n = self.stats["n"].to_numpy()
        slices = np.maximum(np.ceil(n / slice_rows).astype("int64"), 1)
        small = np.where(slices > 1, 0, n)
        bin_of = (np.cumsum(small) - small) // slice_rows
        first = np.where(slices > 1, int(bin_of.max(initial=0)) + 1 + np.cumsum(np.where(slices > 1, slices, 0)) - slices, bin_of)
        sliced_cells = spark.createDataFrame(
            self.stats[["collection", "cell"]].assign(first=first.astype("int64"), slices=slices), "collection string, cell int, first bigint, slices bigint")
        # On stored cells this is the filter by which Spark prunes their folders.
        visits = wanted.groupBy("collection", "cell").agg(F.collect_set("block").alias("blocks"))
        plan = F.broadcast(visits.join(F.broadcast(sliced_cells), ["collection", "cell"]))
        met = plan.select(F.explode("blocks").alias("block"), "first", "slices").select(
            "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slices") - 1)).alias("slice")).distinct()
        asked = dealt.join(F.broadcast(met), "block")
        sliced = (
            self.placed.select("collection", "cell", "id", "embedding").join(plan, ["collection", "cell"])
            .withColumn("slice", F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices")))
            .select("collection", "cell", "slice", F.explode("blocks").alias("block"), "id", "embedding")
        )
        schema = hit_schema(self.placed, questions)
        arrow = arrow_schema(schema)
        shared = spark.sparkContext.broadcast((_plain(space), self._held()))

        def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return arrow.empty_table()
            space, cells = Space(*shared.value[0]), shared.value[1]
            qvec = matrix(asked.column("qvec"), space.dimensions)
            collections = np.asarray(held.column("collection").to_numpy(), dtype=object)
            ids, vectors = id_array(held.column("id")), matrix(held.column("embedding"), space.dimensions)
            cell = held.column("cell").to_numpy()
            found = []
            present = {c: cells[c] for c in held.column("collection").unique().to_pylist()}
            for collection, number, mask in _masks(space, present, qvec, k, probes):
                mine = np.flatnonzero(collections == collection)
                mine = mine[np.argsort(cell[mine], kind="stable")]
                best = NearestSoFar(qvec, k, space.metric, tile)
                column = np.searchsorted(number, cell[mine])
                # An exact search may compare more than it has to: cells that most questions visit are taken together.
                share = mask.mean(axis=0) if probes is None else mask.all(axis=0) * 1.0
                dense = share[column] > (0.5 if probes is None else 0.99)
                best.add(ids[mine[dense]], vectors[mine[dense]])
                mine, column = mine[~dense], column[~dense]
                for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(column)) + 1) if len(mine) else []:
                    best.add(ids[mine[part]], vectors[mine[part]], np.flatnonzero(mask[:, column[part[0]]]))
                if len(best.row):
                    found.append(hit_rows(asked.column("qid").combine_chunks(), collection, best, arrow))
            return pa.Table.from_batches(found, schema=arrow)

        # The tasks are few bytes but long work: their number is given, so that they are not put together by size.
        keys, tasks = ["slice", "block"], max(1, n_blocks * int((first + slices).max(initial=1)))
        return asked.repartition(tasks, *keys).groupBy(*keys).cogroup(sliced.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(compare, schema)


def _masks(
    space: Space, held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], vectors: np.ndarray, k: int, probes: int | None,
) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each collection: its cells, ascending, and the mask (questions x cells) of those that a question visits."""
    masks = {c: np.empty((len(vectors), len(h[0])), dtype=bool) for c, h in held.items()}
    for a in range(0, len(vectors), ROUTED):
        gaps = space.gaps(vectors[a:a + ROUTED], False)
        finite = np.isfinite(gaps).all(axis=1)[:, None]
        for collection, (number, n, radius) in held.items():
            cells = pd.DataFrame({"cell": number, "n": n, "radius": radius})
            masks[collection][a:a + ROUTED] = space.visited(gaps, cells, k, probes) & finite
    for collection, mask in masks.items():
        yield collection, held[collection][0], mask


class StoredCells:
    """Cells kept as files below ``path``: records in one folder for each batch, collection and cell, the pivots and each batch's
    counts beside them. They are made once, at ingest, and a search reads only the folders of cells that it visits.

    A batch has a name. Its counts are written after its records, and only batches with counts are searched, so one
    that broke off is not seen; written again it replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, corpus: DataFrame, metric: str = "l2sq", pivots: int | None = None, batch: str = "0") -> None:
        """Choose pivots from the corpus and store it as the first batch. For ``ip`` later records may not be longer than the longest
        of this one."""
        stored = materialize(_usable(corpus), "corpus")
        first = stored.first()
        if first is None:
            raise ValueError("pivots cannot be chosen from a corpus without vectors")
        space = pick_space(stored, metric, len(first["embedding"]), pivots)
        if space is None:
            raise ValueError("pivots cannot be chosen from a corpus without usable vectors")
        rows = [(i, c, space.metric, space.dimensions, space.longest) for i, c in enumerate(space.centres.tolist())]
        self.spark.createDataFrame(rows, "pivot int, centre array<double>, metric string, dimensions int, longest double").coalesce(
            1).write.mode("overwrite").parquet(f"{self.path}/pivots")
        self._write(stored, space, batch)

    def append(self, corpus: DataFrame, batch: str) -> None:
        """Store more records in the cells there are."""
        self._write(_usable(corpus), self.space(), batch)

    def _write(self, corpus: DataFrame, space: Space, batch: str) -> None:
        if space.metric == "ip":
            squared = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
            fits = F.sqrt(squared) <= space.longest
            corpus = corpus.where(F.when(fits, True).otherwise(F.raise_error(F.lit(
                "a record is longer than the longest one at creation; create the cells anew"))))
        # One folder is one task's work, but for large cells, which adaptive execution splits.
        placed = place(corpus, space).withColumn("batch", F.lit(batch)).hint("rebalance", "collection", "cell")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch", "collection", "cell").parquet(f"{self.path}/records")
        mine = self._records(corpus).where(F.col("batch") == batch)
        cell_stats(mine).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/counts")

    def _records(self, corpus: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        if corpus is not None:  # of an empty batch there are no files to tell the columns from
            reader = reader.schema(T.StructType([
                T.StructField("id", corpus.schema["id"].dataType), T.StructField("embedding", corpus.schema["embedding"].dataType),
                T.StructField("reach", T.DoubleType()), T.StructField("batch", T.StringType()),
                T.StructField("collection", T.StringType()), T.StructField("cell", T.IntegerType())]))
        found = reader.parquet(f"{self.path}/records")
        return found.withColumn("batch", F.col("batch").cast("string")).withColumn("collection", F.col("collection").cast("string"))

    def space(self) -> Space:
        rows = self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").toPandas()  # at most MAX_PIVOTS
        return Space(rows["metric"][0], int(rows["dimensions"][0]), float(rows["longest"][0]), np.array(rows["centre"].tolist()))

    def load(self) -> Cells:
        counts = self.spark.read.schema("collection string, cell int, n bigint, radius double, batch string").parquet(f"{self.path}/counts")
        stats = counts.groupBy("collection", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy(
            "collection", "cell").toPandas()
        complete = [r["batch"] for r in counts.select("batch").distinct().collect()]  # names of batches
        return Cells(self._records().where(F.col("batch").isin(complete)), self.space(), stats)


def _usable(corpus: DataFrame) -> DataFrame:
    return corpus.select("collection", "id", "embedding").where(F.col("embedding").isNotNull() & F.col("collection").isNotNull())
