"""The trie of conversation prefixes, from sorted conversations and range minima.

A conversation is a path of turns. Sorted by their paths, the members of a prefix of d turns lie side by side: they are the
widest interval around one of them in which neighbours share d turns or more. The lengths of the common prefixes of neighbours
(LCPs) go into a sparse table of range minima, and every candidate prefix finds its interval by two binary searches on
that table, one to each side, independently of all others: there is no stack and no order of work.

Spark sorts the paths over all tasks; a task treats its stretch of the order in blocks of bounded size. A prefix whose
interval ends inside a block is complete there. One that touches an edge of its block is a piece of what may go on in
others: such pieces, at most two paths of a block, are put together by a hash of the prefix, so a first turn that a third of all
conversations share is one row for each block. Prefixes numbered in the sorted order come before all that extend them,
so what a subtree holds is a difference of two running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.session import materialize

# Conversations and turns that a task holds at once.
BLOCK_ROWS = 65_536
BLOCK_TURNS = 1 << 20
# Ids in one row of a list that several blocks make up.
LIST_IDS = 512
# Every FAMILY consecutive ids begin like the first of them, with less than STARTS turns of it.
FAMILY = 5
STARTS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()


class RangeMinimum:
    """Sparse table: level k holds the minimum of every 2 ** k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minimum of each range [start, end), none of them empty."""
        level = np.frexp(end - start)[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[start[at]], table[end[at] - (1 << int(k))])
        return out

    def right(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The end of the widest run to the right of each row in which all values are at least ``least``; the row's own value
        does not count."""
        n, at = len(self.levels[0]), row + 1
        for k in reversed(range(len(self.levels))):
            inside = at + (1 << k) <= n
            fits = inside & (self.levels[k][np.where(inside, at, 0)] >= least)
            at = at + (fits.astype(np.int64) << k)
        return at

    def left(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first row of the widest run to the left, each row's own value counted."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            start = at - (1 << k) + 1
            inside = start >= 0
            fits = inside & (self.levels[k][np.where(inside, start, 0)] >= least)
            at = at - (fits.astype(np.int64) << k)
        return at


def common_prefixes(turns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many turns each path has in common with the one before it; -1 for the first. ``turns`` are hashes as rows of two
    longs, path i is ``turns[starts[i]:starts[i + 1]]``."""
    sizes = np.diff(starts)
    least = np.minimum(sizes[1:], sizes[:-1])
    offsets = np.concatenate([[0], np.cumsum(least)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], least)
    same = (turns[np.repeat(starts[:-2], least) + place] == turns[np.repeat(starts[1:-1], least) + place]).all(axis=1)
    out = least.copy()
    differ = np.flatnonzero(~same)
    np.minimum.at(out, np.searchsorted(offsets, differ, "right") - 1, place[differ])
    return np.concatenate([[-1], out])


def _span(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ..., counts[i] of them, one after another."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])


_PIECE = {
    "kind": pa.int32(), "block": pa.int64(), "place": pa.int64(), "stop": pa.int64(), "parent": pa.int64(), "key": pa.binary(),
    "parent_key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "parent_open": pa.bool_(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "last_bytes": pa.int64(),
    "ends": pa.string(),
}
_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
_PIECE_SCHEMA = ", ".join(f"{n} {_TYPES[t]}" for n, t in _PIECE.items())
CLOSED, OPEN, LISTED = range(3)


def _prefix_keys(path: bytes) -> list[bytes]:
    """A hash of every prefix of a path, the empty one first."""
    state, out = hashlib.md5(), []
    out.append(state.digest())
    for at in range(0, len(path), 16):
        state.update(path[at:at + 16])
        out.append(state.copy().digest())
    return out


def block_nodes(block: int, paths: list[bytes], sizes: list[np.ndarray], convs: np.ndarray) -> pa.RecordBatch:
    """The prefixes of one block of sorted conversations: complete ones, pieces that touch an edge, and lists of the
    conversations that end at such pieces."""
    lengths = np.array([len(p) // 16 for p in paths], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    turns = np.frombuffer(b"".join(paths), np.int64).reshape(-1, 2)
    weights = np.concatenate([*sizes, np.zeros(1, np.int64)])
    n = len(paths)
    lcp = common_prefixes(turns, starts)
    minima = RangeMinimum(lcp)

    # A path's prefixes that the path before it lacks: each interval is found from its first member.
    fresh = lengths - lcp
    first = np.concatenate([[0], np.cumsum(fresh)])
    row = np.repeat(np.arange(n), fresh)
    depth = _span(lcp + 1, fresh)
    begin, end = minima.left(row, depth), minima.right(row, depth)
    count = end - begin
    least = RangeMinimum(convs).between(begin, end)
    # The parent is one turn shorter; its first member may be an earlier path.
    above = minima.left(row, depth - 1)
    parent = np.where(depth > 0, first[above] + depth - 2 - lcp[above], -1)
    stop = first[end]  # numbers from its own up to here are the subtree

    edge = (begin == 0) | (end == n)
    last_bytes = np.where(depth > 0, weights[starts[row] + depth - 1], 0)
    inner = ~edge

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[stop] - sums[:-1]

    children = np.bincount(parent[inner], minlength=len(row))
    leaves = below(inner & (children == 0))
    saved = below(np.where(inner, (count - 1) * last_bytes, 0))

    # Equal paths are neighbours, their ids ascending, and stand first in the interval of the whole path.
    same = np.concatenate([[False], (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])])
    heads = np.flatnonzero(~same)
    tails = np.concatenate([heads[1:], [n]])
    whole = first[heads] + fresh[heads] - 1  # the number of the prefix that is the whole path
    ends: list[str | None] = [None] * len(row)
    keys: list[bytes | None] = [None] * len(row)
    parent_keys: list[bytes | None] = [None] * len(row)
    for at in (0, n - 1):
        path_keys = _prefix_keys(paths[at])
        for i in np.flatnonzero((begin <= at) & (at < end) & edge):
            keys[i] = path_keys[depth[i]]
            parent_keys[i] = path_keys[depth[i] - 1] if depth[i] else None
    lists = []
    for head, tail, i in zip(heads, tails, whole, strict=True):
        ids = list(map(str, convs[head:tail].tolist()))
        if edge[i]:
            lists += [(keys[i], head + at, ",".join(ids[at:at + LIST_IDS])) for at in range(0, len(ids), LIST_IDS)]
        else:
            ends[i] = hashlib.sha256(",".join(ids).encode()).hexdigest()

    m = len(lists)
    columns = {
        "kind": np.concatenate([np.where(edge, OPEN, CLOSED), np.full(m, LISTED)]),
        "place": np.concatenate([np.arange(len(row)), np.array([at for _, at, _ in lists], np.int64)]),
        "stop": stop, "parent": parent, "conv_id": least, "depth": depth, "parent_conv_id": least[parent],
        "parent_open": edge[parent], "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "last_bytes": last_bytes,
        "block": np.full(len(row) + m, block), "key": [*keys, *(k for k, _, _ in lists)], "parent_key": parent_keys,
        "ends": [*ends, *(t for _, _, t in lists)],
    }
    total = len(row) + m

    def array(name: str) -> pa.Array:
        made = pa.array(columns[name], _PIECE[name])
        return made if len(made) == total else pa.concat_arrays([made, pa.nulls(m, _PIECE[name])])

    return pa.RecordBatch.from_arrays([array(c) for c in _PIECE], list(_PIECE))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32  # partitions of a sort are numbered in its order
    paths: list[bytes] = []
    sizes: list[np.ndarray] = []
    convs: list[np.ndarray] = []
    turns = 0
    for batch in batches:
        paths += batch.column(0).to_pylist()
        sizes.append(batch.column(1).flatten().to_numpy())
        turns += len(sizes[-1])
        convs.append(batch.column(2).to_numpy())
        if len(paths) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
            yield block_nodes(block, paths, sizes, np.concatenate(convs))
            block, paths, sizes, convs, turns = block + 1, [], [], [], 0
    if paths:
        yield block_nodes(block, paths, sizes, np.concatenate(convs))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key from its list's parts in order, however long: only the state of the hash is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _hashes(out)
    if state:
        yield _hashes([(key, state.hexdigest())])


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["key", "ends_sha256"])


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (hash, bytes)) of (conv_id, turn, role, text). Turns are ordered by number, null first, equal
    numbers by the hash of role and text. Null role and text are empty. Rows without conv_id belong to no conversation.

    A turn is 16 bytes of hash and a size here, so a conversation of a million turns is a value of some 50 MB."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
            F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("hash"),
            F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    return named.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list("t")), lambda t: F.struct(t["hash"].alias("hash"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 5 instead (none if that is absent),
    h = crc32(c) % 9. Remainders are those of SQL, with the sign of c."""
    stored = materialize(paths, "conversations")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    base = stored.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, STARTS - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % STARTS).cast("int")
    start = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return stored.withColumn("family", family).withColumn("h", h).join(base, "family", "left").select(
        "conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _subtrees(skeleton: DataFrame) -> DataFrame:
    """(key, below_leaves, below_saved): sums over the skeleton's prefixes that extend each one, itself included. Its first piece is its
    place in the order; what lies between that and its end is its subtree. Running sums go by block, then over blocks."""
    begins = skeleton.select("key", F.col("first.block").alias("block"), F.col("first.place").alias("place"), F.lit(1).alias("side"),
                             "depth", "leaf", "saved")
    stops = skeleton.select("key", F.col("last.block").alias("block"), F.col("last.stop").alias("place"), F.lit(0).alias("side"),
                            "depth", F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved"))
    events = begins.unionByName(stops)
    blocks = events.groupBy("block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    offsets = blocks.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "saved")))
    inside = Window.partitionBy("block").orderBy("place", "side", "depth", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = events.select(
        "key", "block", "side", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in ("leaf", "saved"))).join(offsets, "block")
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    return placed.groupBy("key").agg(*(
        F.sum(sign * (F.col(c) + F.col(f"{c}_before"))).alias(f"below_{c}") for c in ("leaf", "saved")))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns: array of (hash, bytes)); conv_id must be unique and not null.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations
    without turns are members of the root alone; without conversations there are no nodes.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), ""))
    ordered = conversations.select(
        path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"), "conv_id"
    ).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = materialize(ordered.mapInArrow(_pieces, _PIECE_SCHEMA), "trie-pieces")

    opened = pieces.where(F.col("kind") == OPEN)
    merged = materialize(opened.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("last_bytes").alias("last_bytes"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.min(F.struct("block", "place")).alias("first"), F.max(F.struct("block", "stop")).alias("last")), "trie-edges")
    under = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    hashes = pieces.where(F.col("kind") == LISTED).select("key", "ends", "block", "place").repartition("key").sortWithinPartitions(
        "key", "block", "place").select("key", "ends").mapInArrow(_listed, "key binary, ends_sha256 string")
    skeleton = materialize(
        merged.join(under, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
        .withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("last_bytes")).join(hashes, "key", "left"), "trie-skeleton")
    parents = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spanning = skeleton.join(_subtrees(skeleton), "key").join(parents, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("below_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("below_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    # Only prefixes right below an edge piece need to hear from other blocks who its smallest member is.
    named = opened.select("block", F.col("place").alias("parent"), "key").join(
        skeleton.select("key", F.col("conv_id").alias("named")), "key").drop("key")
    closed = pieces.where(F.col("kind") == CLOSED)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    below_edge = closed.where("parent_open").join(named, ["block", "parent"]).withColumn("parent_conv_id", F.col("named"))
    return closed.where("not parent_open").select(*columns, ends).unionByName(below_edge.select(*columns, ends)).unionByName(spanning)


def report(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(paths_of(conversations.select("conv_id", "turn", "role", "text"))))
