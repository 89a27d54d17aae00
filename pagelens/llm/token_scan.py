"""Document lengths of flat token streams that have no index.

A stream is a run of token ids in which one id ends each document. It is cut into blocks of equal length
with no regard to documents. One vectorised search per block finds its end-of-document ids and gives
a short summary: the tokens before the first, between them, and after the last. A prefix scan over the summaries (a running
count of ends and the running place of the last end) tells each block which document it opens with and how
much of it lies in earlier blocks, so documents across any number of blocks are stitched together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagelens.llm.tokens import worker_encoder
from pagelens.session import materialize

# Fixed value: the id that ends a document in the vocabulary word_bpe_49k.
END = 49_407
BLOCK_TOKENS = 1 << 16
# Blocks of one stream whose summaries a task scans; longer streams are scanned stretch by stretch.
STRETCH_BLOCKS = 4096


def write_streams(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenise every document into flat streams of unsigned 16-bit ids, one per task, each document followed by
    END. Returns (blocks: stream, block, tokens) and (manifest: stream, nth, doc_id), both stored by Spark.

    The blocks know nothing of documents; the manifest only names them and holds no lengths.
    """

    def run(batches):
        from pyspark import TaskContext

        stream, block, nth, held = TaskContext.get().partitionId(), 0, 0, b""
        encode = worker_encoder(vocabulary)

        def table(blocks: list[bytes], first: int, ids: pa.Array | None) -> pa.RecordBatch:
            n, m = len(blocks), 0 if ids is None else len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([stream] * (n + m), pa.int32()),
                pa.array([*range(first, first + n), *range(nth, nth + m)], pa.int64()),
                pa.array([*blocks, *[None] * m], pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.nulls(0, pa.int64()) if ids is None else ids]),
            ], ["stream", "place", "tokens", "doc_id"])

        size, end = 2 * BLOCK_TOKENS, np.array([END], "<u2").tobytes()
        for batch in batches:
            parts = [held]
            for value in batch.column(1).to_pylist():
                parts.append(_narrow(encode(value)) + end)
            held = b"".join(parts)
            whole = len(held) // size
            yield table([held[i * size:(i + 1) * size] for i in range(whole)], block, batch.column(0).cast(pa.int64()))
            held, block, nth = held[whole * size:], block + whole, nth + batch.num_rows
        if held:
            yield table([held], block, None)

    written = materialize(
        docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(
            run, "stream int, place bigint, tokens binary, doc_id bigint"), "streams")
    blocks = written.where("tokens is not null").select("stream", F.col("place").alias("block"), "tokens")
    manifest = written.where("tokens is null").select("stream", F.col("place").alias("nth"), "doc_id")
    return blocks, manifest


def read_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS, width: str = "<u2") -> DataFrame:
    """Flat files below ``path`` as blocks: one stream per file, named by its path. ``width`` is the numpy type of an id; a file
    that is no whole number of ids is an error.

    Spark lists the files; their ranges of ``block_bytes`` are dealt over all tasks, and a task reads its own ranges and nothing else,
    so one file of any size is read by many tasks.
    """
    unit = np.dtype(width).itemsize
    if block_bytes % unit:
        raise ValueError(f"a block must be a multiple of {unit} bytes")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    whole = F.when(F.col("length") % unit == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(f" is no whole number of {unit}-byte ids"))).cast("bigint"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / block_bytes)))
    ranges = files.select("path", "length", blocks.alias("block")).repartition(
        spark.sparkContext.defaultParallelism * 4, F.xxhash64("path", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = _system(name)
                with system.open_input_file(at) as file:
                    begin = block * block_bytes
                    data = file.read_at(min(block_bytes, length - begin), begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["stream", "block", "tokens"])

    return ranges.mapInArrow(run, "stream string, block bigint, tokens binary")


def _system(name: str):
    """File system and path of a listed file; Spark names local ones ``file:/...``."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    parts = urlparse(name)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(name)


def _narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones; a vocabulary with greater ids is an error."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > np.iinfo(np.uint16).max:
        raise OverflowError("the vocabulary has ids beyond 16 bits")
    return wide.astype("<u2").tobytes()


def _summaries(end: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, first, last, inner = [], [], [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer(), width)
                at = np.flatnonzero(ids == end)
                total.append(len(ids))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(first, pa.int64()),
                pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64())),
            ], ["stream", "block", "total", "first", "last", "inner"])

    return run


def document_lengths(blocks: DataFrame, end: int = END, width: str = "<u2") -> DataFrame:
    """(stream, nth, n_tokens, ended) for every document of the streams (stream, block, tokens).

    ``nth`` counts from 0 in each stream, ``n_tokens`` leaves the end id out. Tokens after the last end id are a
    document with ``ended`` false; a stream without tokens has no documents. ``width``: the numpy type of an id.
    Blocks of a stream count from 0 without gaps and have any lengths that are whole ids.
    """
    kind = blocks.schema["stream"].dataType.simpleString()
    summary = materialize(
        blocks.select("stream", F.col("block").cast("bigint").alias("block"), "tokens").where(F.length("tokens") > 0)
        .mapInArrow(_summaries(end, width),
                    f"stream {kind}, block bigint, total bigint, first bigint, last bigint, inner array<bigint>"),
        "summaries").withColumn("stretch", F.floor(F.col("block") / STRETCH_BLOCKS))
    ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    narrow = summary.select("stream", "stretch", "block", "total", "first", "last", ends.cast("bigint").alias("ends"))

    # Two-level prefix scan: stretches first, then the blocks inside each stretch.
    inside = Window.partitionBy("stream", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = narrow.withColumn("_at", F.coalesce(F.sum("total").over(inside), F.lit(0))).withColumn(
        "_n", F.coalesce(F.sum("ends").over(inside), F.lit(0))).withColumn(
        "_last", F.max(F.expr("_at + last")).over(inside))
    across = Window.partitionBy("stream").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = local.groupBy("stream", "stretch").agg(
        F.sum("total").alias("total"), F.sum("ends").alias("ends"), F.max(F.expr("_at + last")).alias("_end"))
    offsets = stretches.withColumn("_start", F.coalesce(F.sum("total").over(across), F.lit(0))).select(
        "stream", "stretch", "_start", F.coalesce(F.sum("ends").over(across), F.lit(0)).alias("_before"),
        F.max(F.expr("_start + _end")).over(across).alias("_previous"))
    placed = local.join(offsets, ["stream", "stretch"]).select(
        "stream", "block", "first", "last", "total",
        (F.col("_before") + F.col("_n")).alias("nth"),
        # Tokens of the open document that lie in earlier blocks.
        (F.col("_start") + F.col("_at") - F.coalesce(F.col("_start") + F.col("_last"), F.col("_previous"), F.lit(-1)) - 1
         ).alias("carried"),
    )
    lengths = placed.join(summary.select("stream", "block", "inner"), ["stream", "block"])
    closed = lengths.where("first is not null").select(
        "stream", "nth", F.posexplode(F.concat(F.array(F.col("carried") + F.col("first")), "inner")).alias("i", "n_tokens"),
    ).select("stream", (F.col("nth") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("ended"))
    # The last block of a stream may leave a document open.
    tail = placed.groupBy("stream").agg(
        F.max_by(F.struct(
            (F.col("nth") + 0).alias("nth"), "carried", "first", "last", "total"), "block").alias("b"),
        F.max("block").alias("block"))
    left = tail.join(narrow.select("stream", "block", "ends"), ["stream", "block"]).select(
        "stream", (F.col("b.nth") + F.col("ends")).alias("nth"),
        F.coalesce(F.col("b.total") - F.col("b.last") - 1, F.col("b.carried") + F.col("b.total")).alias("n_tokens"),
        F.lit(False).alias("ended")).where("n_tokens > 0")
    return closed.unionByName(left)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, stream, nth, n_tokens of every document: tokenised into flat streams, counted by the scan alone.
    Null and empty texts have no tokens; repeated rows are documents of their own."""
    blocks, manifest = write_streams(docs, vocabulary=vocabulary)
    return manifest.join(document_lengths(blocks), ["stream", "nth"]).select("doc_id", "stream", "nth", "n_tokens")
