"""Best-fit-decreasing packing of whole token sequences.

Best fit decreasing looks only at lengths, and lengths are small integers, so the exact run of the algorithm is made
on the histogram of lengths (at most ``capacity`` counts): items of one length that go into bins of one kind are one
step. A segment tree over the remaining capacities finds the tightest open kind in logarithmic time. The resulting
plan is bounded by the capacity, not by the corpus, and tells for every (length, rank) its sequence and
offset; ranks are drawn by Spark.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.llm.tokens import worker_encoder
from pagelens.operators.numbering import running_number
from pagelens.session import materialize

CAPACITY = 4096
END = 1
# Items of one length that one task ranks.
RANK_ROWS = 262_144


class CapacityTree:
    """The remaining capacities that have open bins, as a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)

    def add(self, remaining: int, kinds: int) -> None:
        node = self.size + remaining
        while node:
            self.count[node] += kinds
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= need that has an open bin."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over {length: items}. Returns steps (length, first rank, items, first bin, items per
    bin, offset): item ``r`` of the step goes to bin ``first + r // per`` at ``offset + (r % per) * length``.

    A step that ends a length splits at most one kind of bins in three; a bin holds at most
    sqrt(2 * capacity) different lengths. So steps number at most a few times capacity ** 1.5, whatever
    the corpus holds.
    """
    tree = CapacityTree(capacity)
    open_kinds: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining -> (first bin, bins)
    bins, steps = 0, []

    def put_back(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_kinds[remaining].append((first, n))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                per = capacity // length
                n = -(-left // per)
                first, bins, remaining = bins, bins + n, capacity
            else:
                first, n = open_kinds[remaining].pop()
                tree.add(remaining, -1)
                per = remaining // length
            # An item goes to the tightest bin, which is the one just used for as long as it has room.
            full, rest = divmod(min(left, n * per), per)
            took = full * per + rest
            steps.append((length, rank, took, first, per, capacity - remaining))
            put_back(remaining - per * length, first, full)
            if rest:
                put_back(remaining - rest * length, first + full, 1)
            put_back(remaining, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + took, left - took
    return steps


def tokenised(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """The pieces of every row: ``keep`` columns, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids followed by one END id; only a longer one is cut, into pieces of ``capacity``
    ids. Null and empty texts are the END id alone; repeated rows are documents of their own.
    """
    names = list(keep)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encode = worker_encoder(vocabulary)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []

            def flush(batch=batch, rows=rows, piece=piece, start=start, length=length, crc=crc, ids=ids):
                columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:len(names)]]
                columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                            pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, [f.strip("`") for f in fields])

            for row, value in enumerate(batch.column(len(names)).to_pylist()):
                whole = encode(value) + end
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at:at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                if with_ids and len(ids) >= 512:
                    yield flush()
                    for column in (rows, piece, start, length, crc, ids):
                        column.clear()
            yield flush()

    kept = [(f"`{c}`", docs.schema[c].dataType.simpleString()) for c in names]
    made = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    made += [("ids", "array<int>")] if with_ids else []
    fields = [c for c, _ in kept + made]
    schema = ", ".join(f"{c} {t}" for c, t in kept + made)
    return docs.select(*names, F.col(text)).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    The histogram (at most ``capacity`` rows) is the only thing that reaches the driver. Ranks within a length
    are two-level: hashed buckets of about RANK_ROWS rows, so a length that a third of all rows have is
    spread over many tasks. Rows that are equal in every column may be ranked either way.
    """
    stored = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    steps = plan_bins(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // RANK_ROWS))
    bucket = F.pmod(F.xxhash64("_row"), F.lit(buckets))
    ranked = running_number(stored, ["length"], ["_row"], bucket, "_rank")
    table = np.array(steps, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shift = max(counts.values(), default=0) + 1
    if shift * (capacity + 1) > 2 ** 62:
        raise ValueError("too many items for one packing run")
    shared = pieces.sparkSession.sparkContext.broadcast((table, table[:, 0] * shift + table[:, 1]))
    columns = pieces.columns

    def run(batches):
        plan, keys = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            step = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - step[:, 1]
            placed = [step[:, 3] + nth // step[:, 4], step[:, 5] + nth % step[:, 4] * length]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns), *map(pa.array, placed)],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "_rank").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    return place(tokenised(docs, text, ("doc_id",), capacity, vocabulary), capacity)
