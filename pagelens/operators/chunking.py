"""Split page text into overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_SIZE = 1200
CHUNK_OVERLAP = 150

# Separators from coarse to fine; the empty one splits between any two characters.
SEPARATORS = ("\n\n", "\n", " ", "")

# Chunks that leave a worker at a time.
ROWS_OUT = 512
SPANS = "array<struct<start: int, end: int, chunk: string>>"


def _pieces(text: str, lo: int, hi: int, separator: str) -> Iterator[tuple[int, int]]:
    """Cut ``text[lo:hi]`` before every separator, so a separator opens the piece that follows it."""
    begin, at = lo, text.find(separator, lo, hi)
    while at >= 0:
        if at > begin:
            yield begin, at
        begin, at = at, text.find(separator, at + len(separator), hi)
    if hi > begin:
        yield begin, hi


class _Packer:
    """Joins neighbouring pieces greedily; a chunk opens with the last pieces of the one before it. Holds no more pieces than a
    chunk has."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.held: deque[tuple[int, int]] = deque()

    def add(self, begin: int, end: int) -> Iterator[tuple[int, int]]:
        held = self.held
        if held and end - held[0][0] > self.size:
            done = held[-1][1]
            yield held[0][0], done
            while held and (done - held[0][0] > self.overlap or end - held[0][0] > self.size):
                held.popleft()
        held.append((begin, end))

    def finish(self) -> Iterator[tuple[int, int]]:
        if self.held:
            yield self.held[0][0], self.held[-1][1]
            self.held.clear()


def _windows(lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while hi - lo > size:
        yield lo, lo + size
        lo += size - overlap
    yield lo, hi


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    if not SEPARATORS[level]:
        yield from _windows(lo, hi, size, overlap)
        return
    packer = _Packer(size, overlap)
    for begin, end in _pieces(text, lo, hi, SEPARATORS[level]):
        if end - begin < size:
            yield from packer.add(begin, end)
            continue
        yield from packer.finish()
        yield from _spans(text, begin, end, level + 1, size, overlap)
    yield from packer.finish()


def page_chunks(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(start, end, chunk) of one page, one after another; stripped, empty ones left out."""
    for begin, end in _spans(text, 0, len(text), 0, size, overlap) if text else ():
        whole = text[begin:end]
        chunk = whole.strip()
        if chunk:
            start = begin + len(whole) - len(whole.lstrip())
            yield start, start + len(chunk), chunk


def split_page(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[dict]:
    """Chunks of one page with their character offsets."""
    return [{"start": a, "end": b, "chunk": c} for a, b, c in page_chunks(text, size, overlap)]


def _checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")


def chunk_table(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """The recursive splitter as a table function for SQL: ``spark.udtf.register(name, chunk_table())``, then
    ``FROM pages, LATERAL name(text)`` gives (chunk_no, start, end, chunk). Null and blank texts give no rows. (Spark takes no
    Arrow table functions in lateral joins, so rows are made one by one; ``chunk_rows`` moves them in batches.)"""
    _checked(size, overlap)

    class Chunks:
        def eval(self, text: str | None) -> Iterator[tuple[int, int, int, str]]:
            for n, (start, end, chunk) in enumerate(page_chunks(text, size, overlap)):
                yield n, start, end, chunk

    return F.udtf(Chunks, returnType="chunk_no int, start int, end int, chunk string", useArrow=False)


def chunk_rows(pages: DataFrame, *keep: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """One row per chunk: the ``keep`` columns of its page, chunk_no, start, end and chunk. Rows leave the worker ROWS_OUT at a time while
    the page is still being cut, so a page's chunks are never one value. Null and blank texts give no rows."""
    _checked(size, overlap)
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = ((row, n, *c) for row, t in enumerate(batch.column(len(keep)).to_pylist()) for n, c in enumerate(page_chunks(t, size, overlap)))
            while some := list(islice(numbered, ROWS_OUT)):
                row, n, start, end, chunk = zip(*some, strict=True)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in batch.columns[:len(keep)]), pa.array(n, pa.int32()), pa.array(start, pa.int32()),
                     pa.array(end, pa.int32()), pa.array(chunk, pa.string())], [*keep, "chunk_no", "start", "end", "chunk"])

    return pages.select(*(f"`{c}`" for c in keep), F.col(text)).mapInArrow(
        run, ", ".join([*fields, "chunk_no int", "start int", "end int", "chunk string"]))


def recursive_chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Column function text -> array of chunks: one Arrow batch in, one out, no shuffle."""
    _checked(size, overlap)

    @F.pandas_udf(SPANS)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([split_page(t, size, overlap) for t in texts])

    # Not to be moved or repeated: a filter on the chunks must not run the splitter a second time.
    return split.asNondeterministic()


def window_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the one before,
    as an array of chunks. Built-in expressions only; empty text has no chunk.

    ``substring`` walks from the start of its text, so cutting every window out of the whole text would
    be quadratic. The text is cut into blocks of 64 windows first, and the windows out of their block.
    """
    step = size - overlap
    span = 64 * step

    def starts(length: Column, by: int) -> Column:
        return F.sequence(F.lit(0), length - 1, F.lit(by))

    blocks = F.transform(
        starts(F.length(text), span),
        lambda b: F.struct(b.alias("at"), F.substring(text, b + 1, F.lit(span + overlap)).alias("block"),
                           F.least(F.lit(span), F.length(text) - b).alias("reach")))
    windows = F.transform(
        blocks,
        lambda b: F.transform(
            starts(b["reach"], step),
            lambda s: F.struct(
                (b["at"] + s).alias("start"), (b["at"] + F.least(s + size, F.length(b["block"]))).alias("end"),
                F.substring(b["block"], s + 1, F.lit(size)).alias("chunk"))))
    return F.when(F.length(text) > 0, F.flatten(windows)).otherwise(F.array().cast(SPANS))


def explode_chunks(pages: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk: the page's columns, position on the page, offsets and chunk text.
    The page text itself is not repeated."""
    kept = [c for c in pages.columns if c != "text"]
    return (
        pages.select(*kept, F.posexplode(chunks).alias("chunk_no", "_c"))
        .select(*kept, "chunk_no", "_c.start", "_c.end", F.col("_c.chunk").alias("text"))
    )
