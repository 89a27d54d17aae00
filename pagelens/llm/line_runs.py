"""Repeated lines, by levelled sorted runs of line hashes.

A run is an immutable table of line keys (128 bits of hash), bucketed and sorted by the key, with the number of
documents that held the key and the largest id among them. A new batch of documents is reduced to its own keys, merge-anti-joined
with every run (a key that a run has settled already adds nothing) and what is left becomes a run of its own. Two runs
of a level are merge-joined into one of the next, so n batches leave at most 1 + log2 n runs and a key is rewritten at
most log2 n times. Batch and runs are bucketed alike: a run is merged where it lies and is never shuffled again.

The lines that go are known when all batches are in: those of a key found in LEAST documents or more, but for the
document of the largest id.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.session import materialize, scratch_path

LEAST = 5
POINTS = 40
BATCHES = 6
# A key with this share of a batch's rows or more is hot there: at most HOT keys of a batch can be.
HOT = 1000


def _two_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _long_keys(text: bytes, points: int) -> dict[bytes, list[int]]:
    """The keys of a text's lines that have ``points`` code points or more, and the numbers of their lines."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= points:
            key = line.strip().lower()  # of bytes: blanks \x20 \x09-\x0D and A-Z alone
            if len(key) >= points and (len(key) >= 4 * points or len(key.decode("utf-8", "surrogateescape")) >= points):
                out.setdefault(key, []).append(i)
    return out


def line_keys(docs: DataFrame, text: str = "text", points: int = POINTS) -> DataFrame:
    """(doc_id, mark, h1, h2, at): one row for each row of ``docs`` and each of its keys of ``points`` code points or more. h1 and h2 are the
    key's hash, ``at`` the numbers of its lines, ``mark`` a hash of the whole text. Null and empty texts have none."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, h1, h2, at = [], [], [], []
            for row, whole in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for key, lines in _long_keys(whole or b"", points).items():
                    a, b = _two_longs(xxh3_128_digest(key))
                    rows.append(row)
                    h1.append(a)
                    h2.append(b)
                    at.append(lines)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(at, pa.list_(pa.int32()))], ["doc_id", "mark", "h1", "h2", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _mark(text).alias("mark"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, mark bigint, h1 bigint, h2 bigint, at array<int>")


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class LineRuns:
    """Runs of line keys for batches that come one after another, each document in one batch only.

    ``buckets`` is the number of buckets of all runs, by default that of shuffle partitions. The runs are tables of files below the
    scratch folder; ``close`` forgets their names.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []  # one run at most
        self._name = f"line_runs_{uuid.uuid4().hex}"
        self._made: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """What a batch of rows (doc_id, h1, h2) adds to the runs: (h1, h2, n, top, hot).

        A run has settled a key if it counts ``least`` documents and knows an id at least as large. Hot keys are added in any
        case, so that their share of the rows stays known.
        """
        total = keys.count()
        entries = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).withColumn(
            "hot", F.col("n") * HOT >= total)
        for run in self.runs():
            settled = run.where(F.col("n") >= self.least).select("h1", "h2", F.col("top").alias("known")).hint("merge")
            implied = (entries["h1"] == settled["h1"]) & (entries["h2"] == settled["h2"]) & ~F.col("hot") & (
                F.col("top").isNull() | (F.col("known") >= F.col("top")))
            entries = entries.join(settled, implied, "left_anti")
        return entries

    def add(self, keys: DataFrame) -> None:
        name, level = self._write(self.fresh(keys)), 0
        while level < len(self.levels) and self.levels[level]:
            name = self._merge(self.levels[level], name)
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = name

    def compact(self) -> None:
        """Merge all runs into one, the smaller levels first."""
        names = [name for name in self.levels if name]
        while len(names) > 1:
            names[:2] = [self._merge(names[1], names[0])]
        self.levels = [None] * max(0, len(self.levels) - 1) + names

    def _merge(self, older: str, newer: str) -> str:
        a = self.spark.table(older)
        b = self.spark.table(newer).select(*(F.col(c).alias(f"{c}_b") for c in a.columns)).hint("merge")
        both = a.join(b, (F.col("h1") == F.col("h1_b")) & (F.col("h2") == F.col("h2_b")), "full_outer")
        return self._write(both.select(
            F.coalesce("h1", "h1_b").alias("h1"), F.coalesce("h2", "h2_b").alias("h2"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("top", "top_b").alias("top"),
            (F.coalesce("hot", F.lit(False)) | F.coalesce("hot_b", F.lit(False))).alias("hot")))

    def _write(self, entries: DataFrame) -> str:
        name = f"{self._name}_{len(self._made)}"
        entries.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option(
            "path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        self._made.append(name)
        return name

    def frequent(self) -> DataFrame:
        """(h1, h2, top, hot) of the keys found in ``least`` documents or more; ``top`` is the largest id that holds it."""
        self.compact()
        found = self.runs() or [self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint, top bigint, hot boolean")]
        return found[0].where(F.col("n") >= self.least).select("h1", "h2", "top", "hot")

    def close(self) -> None:
        for name in self._made:
            self.spark.sql(f"drop table if exists {name}")
        self._made, self.levels = [], []


def _batches(docs: DataFrame, batches: int):
    """A number from 0 for each row, the largest ids in batch 0, nulls in the last."""
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)
    later = sum((F.when(F.col("doc_id").cast("double") <= cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0))
    return F.when(F.col("doc_id").isNull(), len(set(cuts))).otherwise(later), len(set(cuts)) + 1


def dropped_lines(docs: DataFrame, text: str = "text", least: int = LEAST, points: int = POINTS, batches: int = BATCHES) -> DataFrame:
    """(_key: (doc_id, mark), dropped: numbers of lines) of the rows that lose lines."""
    spark = docs.sparkSession
    number, parts = _batches(docs, batches)
    path = scratch_path(spark, "line-keys")
    found = line_keys(docs, text, points).withColumn("batch", number)
    found.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(found.schema).parquet(path)
    runs = LineRuns(spark, least)
    try:
        for i in range(parts):
            runs.add(keys.where(F.col("batch") == i))
        frequent = materialize(runs.frequent(), "frequent-lines")
    finally:
        runs.close()
    rows = keys.select(F.struct("doc_id", "mark").alias("_key"), "h1", "h2", "at")
    # A key with a thousandth of all rows has a thousandth of some batch's, so hot keys are at most batches * HOT.
    hot = F.broadcast(frequent.where("hot").select("h1", "h2", "top"))
    marked = rows.join(hot, ["h1", "h2"], "left_anti").join(frequent.where("not hot").select("h1", "h2", "top"), ["h1", "h2"])
    every = marked.select("_key", "at", "top").unionByName(rows.join(hot, ["h1", "h2"]).select("_key", "at", "top"))
    doc_id = F.col("_key.doc_id")
    lost = every.where((doc_id < F.col("top")) | (doc_id.isNull() & F.col("top").isNotNull()))
    return lost.groupBy("_key").agg(F.flatten(F.collect_set("at")).alias("dropped"))


def _kept(text: bytes, dropped: list[int] | None) -> bytes:
    if not dropped:
        return text
    gone = set(dropped)
    return b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in gone)


def without_repeated_lines(
    docs: DataFrame, text: str = "text", least: int = LEAST, points: int = POINTS, batches: int = BATCHES,
) -> DataFrame:
    """All rows and columns with their repeated lines dropped, and ``n_lines`` (before) and ``n_dropped``.

    A key is a line without blanks at its ends, A-Z lower-cased. Keys of ``points`` code points or more that ``least`` rows or more hold
    lose their lines, but for the rows of the largest doc_id among them. Every row is a document; a null id is smaller
    than any other. A null text stays null and counts as one empty line. Rows of one id and one text are treated alike.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    at = [f.name for f in kept].index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            gone = batch.column(len(kept)).to_pylist()
            clean = [None if t is None else _kept(t, d) for t, d in zip(texts, gone, strict=True)]
            columns = batch.columns[:len(kept)]
            columns[at] = pa.array(clean, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64()),
                 pa.array([len(d or ()) for d in gone], pa.int64())], [*(f.name for f in kept), "n_lines", "n_dropped"])

    joined = _with_dropped(docs.select(*(f"`{f.name}`" for f in kept)), text, least, points, batches)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInArrow(run, f"{schema}, n_lines bigint, n_dropped bigint")


def _with_dropped(docs: DataFrame, text: str, least: int, points: int, batches: int) -> DataFrame:
    lost = dropped_lines(docs, text, least, points, batches)
    kind = lost.schema["_key"].dataType.simpleString()
    keyed = docs.withColumn("_key", F.struct("doc_id", _mark(text).alias("mark")).cast(kind))
    return keyed.join(lost, "_key", "left").drop("_key")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the kept lines; null texts as empty) of every row."""

    def run(batches):
        from hashlib import sha256

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            gone = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                 pa.array([len(d or ()) for d in gone], pa.int64()),
                 pa.array([sha256(_kept(t, d)).hexdigest() for t, d in zip(texts, gone, strict=True)], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = _with_dropped(docs.select("doc_id", "text"), "text", LEAST, POINTS, BATCHES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")
