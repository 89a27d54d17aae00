"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the popcounts of its two-bit segments, a point of a small integer grid.
The Manhattan distance of two points never exceeds the Hamming distance of the fingerprints, so a range join
in the grid within the Hamming limit loses no link. The segments are dealt to ``limit + zeros`` blocks: of two
points within the limit at least ``zeros`` blocks lie in the same grid cell, so each point is entered under every
choice of ``zeros`` blocks, and only points that share such a cell meet. Of those that meet, the ones within the limit by the
Manhattan distance of all segments are verified by the Hamming distance itself.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm.components import components
from pagelens.session import materialize

WORDS = 4
LIMIT = 4
ZEROS = 2
SEGMENT_BITS = 2
# Members of a grid cell that one task compares with each other; larger cells are cut into such blocks and
# every pair of blocks is a task's group of its own.
CELL_ROWS = 2048
# Cells up to this size are compared all at once and give every link; larger ones give a spanning forest.
SMALL_CELL = 32


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text; 0 for null and for texts without words."""
    from xxhash import xxh64_intdigest

    # bytes.lower() folds A-Z alone, bytes.split() cuts at \\x20 and \\x09-\\x0D alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - WORDS + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a very long text is counted in pieces
        bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long) of every row."""
    names = list(keep)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(np.array(fps, np.uint64).view(np.int64))], [*names, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text)).mapInArrow(run, f"{schema}, fp bigint")


def _blocks(limit: int, zeros: int) -> list[list[int]]:
    segments = list(range(0, 64, SEGMENT_BITS))
    n = limit + zeros
    return [segments[len(segments) * i // n:len(segments) * (i + 1) // n] for i in range(n)]


def grid_cells(points: DataFrame, limit: int = LIMIT, zeros: int = ZEROS) -> DataFrame:
    """(cell, fp): every choice of ``zeros`` blocks with the popcounts of their segments, hashed to a long.
    Two cells with one hash only cost comparisons."""

    def popcount(segment: int):
        mask = (1 << SEGMENT_BITS) - 1
        return F.bit_count(F.shiftrightunsigned("fp", segment).bitwiseAND(F.lit(mask))).cast("string")

    blocks = [F.concat(*(popcount(s) for s in block)) for block in _blocks(limit, zeros)]
    named = points.select("fp", *(b.alias(f"_b{i}") for i, b in enumerate(blocks)))
    choices = [
        F.xxhash64(F.lit(k), *(F.col(f"_b{i}") for i in choice))
        for k, choice in enumerate(combinations(range(len(blocks)), zeros))
    ]
    return named.select(F.explode(F.array(*choices)).alias("cell"), "fp")


def embedded(fps: np.ndarray) -> np.ndarray:
    """The point of each fingerprint, its two-bit segments' popcounts in unary (0: 00, 1: 01, 2: 11), so that the bits in which two
    points differ are their Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    one, two = fps & low, (fps >> np.uint64(1)) & low
    return (one | two) | (one & two) << np.uint64(1)


def _near(points: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs (a, b) of rows are within the limit: by the lower bound first, then exactly."""
    out = np.bitwise_count(points[a] ^ points[b]) <= limit
    left = np.flatnonzero(out)
    out[left] = np.bitwise_count(fps[a[left]] ^ fps[b[left]]) <= limit
    return out


def _forest(own: np.ndarray, other: np.ndarray | None, limit: int) -> list[tuple[int, int]]:
    """Links of a large cell block (or between two blocks) without those that close a circle."""
    every = own if other is None else np.concatenate([own, other])
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    shift, right = (0, own) if other is None else (len(own), other)
    points, right_points = embedded(every), embedded(right)
    step = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(own), step):
        maybe = np.bitwise_count(points[i:min(i + step, len(own)), None] ^ right_points[None, :]) <= limit
        rows, columns = np.nonzero(maybe)
        exact = np.bitwise_count(own[rows + i] ^ right[columns]) <= limit
        for a, b in zip(rows[exact], columns[exact], strict=True):
            a, b = int(a) + i, int(b) + shift
            if a < b and (x := root(a)) != (y := root(b)):
                parent[y] = x
                out.append((every[a], every[b]))
    return out


def _compare(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The links inside each run of equal rows of ``keys``."""
    starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), sizes)
    large = (sizes > SMALL_CELL) | (np.add.reduceat(side, starts) > 0)
    a, b = [], []
    small = np.flatnonzero(~large[group])
    g, f = group[small], fps[small]
    points = embedded(f)
    for lag in range(1, int(sizes[~large].max(initial=1))):  # all small cells at once
        met = np.flatnonzero(g[lag:] == g[:-lag])
        near = met[_near(points, f, met, met + lag, limit)]
        a.append(f[near])
        b.append(f[near + lag])
    for k in np.flatnonzero(large):
        rows = slice(starts[k], starts[k] + sizes[k])
        own, s = fps[rows], side[rows]
        if pairs := _forest(own[s == 0], own[s == 1] if s.any() else None, limit):
            x, y = zip(*pairs, strict=True)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _joiner(limit: int):
    """Compare the rows of each cell, which come sorted and together."""

    def run(batches):
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = (np.stack(columns[:3], axis=1).astype(np.int64), columns[3].astype(np.int64), columns[4].view(np.uint64))
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            # The last cell may go on in the next batch; it is at most two blocks.
            change = np.flatnonzero(np.any(held[0][1:] != held[0][:-1], axis=1))
            if len(change):
                cut = change[-1] + 1
                yield _pairs(*_compare(*(x[:cut] for x in held), limit))
                held = tuple(x[cut:] for x in held)
        if held is not None and len(held[1]):
            yield _pairs(*_compare(*held, limit))

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])


def links(points: DataFrame, limit: int = LIMIT, zeros: int = ZEROS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever differs in at most ``limit`` bits.

    Not all such pairs: each compared block of a cell gives a spanning forest, so a group of thousands of near
    copies gives thousands of edges. Cells above CELL_ROWS are cut into blocks by a hash and each pair of
    blocks is compared apart, so no cell is one task's work.
    """
    cells = materialize(grid_cells(points, limit, zeros), "cells")
    sizes = cells.groupBy("cell").count().where(F.col("count") > 1).select(
        "cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("n"))
    blocked = cells.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
    dealt = blocked.select(
        "cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"),
    ).select(
        "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )
    # A block meets itself (i = j) with one side, and another block with two.
    together = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return together.mapInArrow(_joiner(limit), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, zeros: int = ZEROS,
) -> DataFrame:
    """``keep`` columns, ``fp``, ``group`` and ``component_id`` of every row: the group is named by its smallest
    fingerprint, component_id is the smallest doc_id reachable over links, its own included.

    Null and wordless texts have fingerprint zero and link like any other. A null doc_id takes part but names
    a component only where all ids are null; repeated rows stay. Equal fingerprints are one point, so exact copies
    never meet each other. Only fingerprints are shuffled, never texts.
    """
    marked = materialize(fingerprints(docs, text, tuple(dict.fromkeys([*keep, "doc_id"]))), "fingerprints")
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    grouped = components(links(points.select("fp"), limit, zeros))
    named = points.join(grouped, points["fp"] == grouped["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group"))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_point = materialize(named.join(names, "group").select("fp", "group", "component_id"), "components")
    return marked.join(by_point, "fp").select(*keep, "fp", "group", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, the same columns: that of the smallest doc_id (null last), of
    repeated ids that of the smallest text hash."""
    # Id and text hash as one struct, in which null ids equal each other: join and thinning share one partitioning,
    # so texts are shuffled once.
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},hash:bigint>"  # as it is read back
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("hash")).cast(kind))
    found = near_duplicates(keyed, keep=("doc_id", "_key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key.hash")
    chosen = materialize(found.groupBy("group").agg(F.min_by("_key", order).alias("_key")).select("_key").distinct(), "kept")
    # Rows with one id and one text are the same document.
    return keyed.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
