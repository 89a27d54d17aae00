"""Exact top-k search over vector-approximation files.

Every component is an integer; a vector's approximation is one byte per component, the number of its cell in an
equal-width grid between the component's smallest and largest value. For a query the edges of a cell bound the inner product
from above and below.

First only approximations meet the queries, block by block: a vector is kept where its upper bound reaches the kth best lower
bound of its block, then that of all blocks. Exact vectors are read for what is left, in the order of the upper bound: the
first few of each query give a kth exact score, and only those whose bound reaches that score are read after them. Then
the kth result is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.session import materialize

K = 10
SCALE = 1024
CELLS = 256
# Exact vectors that are read for each query before the bound is tightened, times k.
FIRST = 4
# Vectors and queries of one block: a task holds one block of each.
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * x) in whole numbers. Null vectors and those that hold a null or non-finite
    component are left out, as are null ids. A component beyond a long after scaling is an error."""
    def whole(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        # Spark may look at a vector before the filter below has taken it out: only finite components are errors.
        return F.when(F.abs(scaled) < 2.0 ** 63, F.floor(scaled)).when(
            F.abs(x.cast("double")) < float("inf"), F.raise_error(F.lit("a component is beyond a long after scaling")).cast("bigint"))

    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & usable & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, whole).alias("v"))


def approximation(vectors: DataFrame, cells: int = CELLS) -> tuple[DataFrame, dict[int, tuple[list[int], list[int]]]]:
    """The approximation file (the columns of ``vectors``, dim, code), code one small number per component, and the grid: lower edges
    and cell widths for each dimensionality. The grid comes from one pre-aggregated pass over all vectors."""
    sized = vectors.withColumn("dim", F.size("v"))
    # One row per dimensionality and component reaches the driver.
    found = sized.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(
        F.min("x").alias("low"), F.max("x").alias("high")).collect()
    grid: dict[int, tuple[list[int], list[int]]] = {}
    for row in sorted(found, key=lambda r: (r["dim"], r["i"])):
        low, width = grid.setdefault(row["dim"], ([], []))
        low.append(row["low"])
        width.append(max(1, -(-(row["high"] - row["low"] + 1) // cells)))
    edges = vectors.sparkSession.createDataFrame(
        [(d, low, width) for d, (low, width) in grid.items()], "dim int, low array<bigint>, width array<bigint>")
    # A cell may start below the smallest long by no more than it is wide, so the difference is taken in decimals.
    code = F.zip_with(
        F.zip_with("v", "low", lambda x, a: x.cast("decimal(20,0)") - a.cast("decimal(20,0)")), "width",
        lambda x, w: F.floor(x / w.cast("decimal(20,0)")).cast("short"))
    return sized.join(F.broadcast(edges), "dim").select(*vectors.columns, "dim", code.alias("code")), grid


def bounds(codes: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each query (rows) with each vector of these codes."""
    bottom = low + codes * width
    top = bottom + (width - 1)
    more, less = np.maximum(queries, 0), np.minimum(queries, 0)
    # A positive component's greatest product is with the upper edge of the cell, a negative one's with the lower.
    upper, lower = more @ top.T + less @ bottom.T, more @ bottom.T + less @ top.T
    # Rounding of floats never hides a candidate: it grows with the products, not with their sum.
    slack = 1 + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(bottom), np.abs(top)).T)
    return lower - slack, upper + slack


def candidates(rows: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray, query_rows: np.ndarray,
               queries: np.ndarray, k: int) -> list[tuple[int, int, float, float]]:
    """(query, vector, least, most) of one block: those that the block's own bounds leave."""
    out = []
    step = max(1, (1 << 21) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        lower, upper = bounds(codes, low, width, queries[at:at + step])
        own = query_rows[at:at + step, None] == rows[None, :]
        lower[own] = upper[own] = -np.inf
        kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
        q, v = np.nonzero((upper >= kth[:, None]) & ~own)
        out += zip(query_rows[at + q].tolist(), rows[v].tolist(), lower[q, v].tolist(), upper[q, v].tolist(), strict=True)
    return out


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().astype(float).reshape(table.num_rows, -1)


def _search(k: int, grid: dict[int, tuple[list[int], list[int]]]):
    def run(key, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and asked.num_rows:
            low, width = (np.array(x, float) for x in grid[key[2].as_py()])
            found = candidates(vectors.column("row").to_numpy(), _matrix(vectors, "code"), low, width,
                               asked.column("row").to_numpy(), _matrix(asked, "v"), k)
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.float64()) for c in columns[2:])],
                        names=["query", "row", "least", "most"])

    return run


def _score(a: str, b: str):
    """The exact inner product. A score that no long holds is an error."""
    products = F.zip_with(a, b, lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)"))
    exact = F.aggregate(products, F.lit(0).cast("decimal(38,0)"), lambda total, x: (total + x).cast("decimal(38,0)"))
    return F.when(exact.between(-2 ** 63, 2 ** 63 - 1), exact.cast("bigint")).otherwise(
        F.raise_error(F.lit("a score is beyond a long")).cast("bigint"))


def read_order(vectors: DataFrame, asked: DataFrame, grid: dict[int, tuple[list[int], list[int]]], k: int) -> DataFrame:
    """(query, row, most, place): what the bounds leave of each query, in the order of the upper bound, from 1."""
    vector_blocks, query_blocks = (max(1, -(-df.count() // n)) for df, n in ((vectors, VECTOR_BLOCK), (asked, QUERY_BLOCK)))

    def block(n: int):
        return F.pmod(F.xxhash64("row", F.lit(11)), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Approximations alone are dealt to the queries' blocks.
    left = vectors.where("dim > 0").select("row", "dim", "code").withColumn("vb", block(vector_blocks)).withColumn("qb", each(query_blocks))
    right = asked.where("dim > 0").select("row", "dim", "v").withColumn("qb", block(query_blocks)).withColumn("vb", each(vector_blocks))
    pair = ("qb", "vb", "dim")
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(
        _search(k, grid), "query bigint, row bigint, least double, most double")
    # The kth best lower bound of all blocks: each block has reported its own k best.
    by_least = Window.partitionBy("query").orderBy(F.desc("least"), "row")
    kth = F.nth_value("least", k).over(by_least.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left_over = found.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    by_most = Window.partitionBy("query").orderBy(F.desc("most"), "row")
    return left_over.select("query", "row", "most", F.row_number().over(by_most).alias("place"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query row with all
    rows but itself, ties to the smaller id. Fewer vectors give fewer rows; only vectors of the query's
    dimension are compared. A repeated row is a candidate of its own, and a query of its own: its id then has several
    rankings. Scores must fit a long.

    ``vectors`` is (id, v), ``queries`` a condition on them: a column or SQL text. Vectors are cut into blocks by a hash of their row;
    every pair of blocks is a group of bounded size.
    """
    file, grid = approximation(vectors.withColumn("row", F.monotonically_increasing_id()))
    stored = materialize(file, "approximation")
    asked = materialize(stored.where(queries).select("id", "row", "dim", "v"), "queries")
    order = materialize(read_order(stored, asked, grid, k), "read-order")
    query = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"))

    def exact(some: DataFrame) -> DataFrame:
        return some.join(query, "query").join(stored.select("row", F.col("id").alias("vec_id"), "v"), "row").select(
            "query", "query_id", "row", "vec_id", _score("v", "q").alias("score"))

    first = materialize(exact(order.where(F.col("place") <= FIRST * k)), "first-read")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    certain = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    later = order.where(F.col("place") > FIRST * k).join(certain, "query").where(F.col("most") >= F.col("kth"))
    found = first.unionByName(exact(later.select("query", "row")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(integer_vectors(embeddings), "id % 100 = 0")
