"""Benchmark decontamination by spaced seeds.

Two aligned stretches of WINDOW words that differ by substitutions in at most a fifth of them agree on
every position of at least one of a few fixed masks: mask c samples the positions that are c modulo (allowed
substitutions + 1), and the substitutions cannot touch all residue classes. So a hash join of benchmark and corpus
on the masked words misses no such stretch. Each hit is then verified word by word around its position, and
overlapping verified windows of one alignment are one overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelens.session import materialize

WINDOW = 13
SIMILAR = 0.8
# Benchmark words whose seeds are broadcast at a time (about 64 MB of hashes); a larger benchmark goes in more passes.
PASS_WORDS = 1_000_000
# Items with fewer words are too short to tell a leak from ordinary language; they overlap nothing.
LEAST_WORDS = 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; whatever is neither letter nor digit separates them."""
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def seed_masks(window: int, similar: float = SIMILAR) -> list[list[int]]:
    """Sampled positions of each mask for windows of this length."""
    allowed = window - required(window, similar)
    return [m for c in range(allowed + 1) if (m := list(range(c, window, allowed + 1)))]


def required(window: int, similar: float = SIMILAR) -> int:
    return -int(-(window * similar) // 1)


def _leading(keys: np.ndarray) -> np.ndarray:
    """Which leading bits the hashes have: a first test of a hash by one look. About 16 bits of table for each hash,
    2 ** 22 bytes at most, so all masks of a pass take 16 times their hashes or 4 MB each, whichever is less."""
    bits = min(22, max(4, (16 * len(keys)).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[keys >> np.uint64(64 - bits)] = True
    return seen


class SeedTable:
    """All seeds of a benchmark: for each window length and mask the sorted hashes and where they stand."""

    def __init__(self, items: list[list[str]], window: int = WINDOW, similar: float = SIMILAR):
        self.similar = similar
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for words in items for w in words}))}
        # All items in one array of word numbers, zeros between them.
        self.flat = np.zeros(sum(len(w) + window for w in items) + window, np.int64)
        self.item = np.full(len(self.flat), -1, np.int64)
        at = 0
        places: dict[int, list[int]] = {}
        for k, words in enumerate(items):
            if not words:
                continue
            self.flat[at:at + len(words)] = [self.number[w] for w in words]
            self.item[at:at + len(words)] = k
            long = min(window, len(words))
            places.setdefault(long, []).extend(range(at, at + len(words) - long + 1))
            at += len(words) + window
        self.seeds = []
        for long, starts in sorted(places.items()):
            begin = np.array(starts, np.int64)
            for mask in seed_masks(long, similar):
                hashes = self.hash(self.flat, begin, mask)
                order = np.argsort(hashes, kind="stable")
                keys = hashes[order]
                self.seeds.append((long, mask, keys, begin[order], _leading(keys)))

    def parts(self) -> tuple:
        """What the table consists of, in plain types: a broadcast may be read where this class is not installed."""
        return self.similar, self.number, self.flat, self.item, [seed[:4] for seed in self.seeds]

    @classmethod
    def of_parts(cls, parts: tuple) -> SeedTable:
        table = cls([], similar=parts[0])
        _, table.number, table.flat, table.item, seeds = parts
        table.seeds = [(long, mask, keys, begin, _leading(keys)) for long, mask, keys, begin in seeds]
        return table

    @staticmethod
    def hash(flat: np.ndarray, begin: np.ndarray, mask: list[int]) -> np.ndarray:
        h = np.zeros(len(begin), np.uint64)
        for p in mask:
            h = (h ^ flat[begin + p].astype(np.uint64)) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h * _MULTIPLIER

    def windows(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Verified windows in the documents ``flat[starts[i]:ends[i]]``: (place in flat, place in the benchmark, length)."""
        own = np.repeat(np.arange(len(starts)), ends - starts)
        place = np.arange(len(flat))
        left = ends[own] - place if len(own) else np.empty(0, np.int64)
        found = []
        for long, mask, keys, where, seen in self.seeds:
            begin = place[left >= long]
            for p in mask:  # a sampled word outside the benchmark's vocabulary cannot match
                begin = begin[flat[begin + p] > 0]
            h = self.hash(flat, begin, mask)
            maybe = seen[h >> np.uint64(65 - len(seen).bit_length())]
            begin, h = begin[maybe], h[maybe]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            begin, lo, n = begin[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # Hits in blocks, each verified at once: bounded memory however often a seed occurs.
            stops = np.cumsum(n)
            cuts = np.searchsorted(stops, np.arange(1 << 18, (stops[-1] if len(stops) else 0) + (1 << 18), 1 << 18), "left") + 1
            before = 0
            for cut in cuts:
                part = slice(before, min(cut, len(n)))
                before = part.stop
                if part.start >= part.stop:
                    continue
                count = n[part]
                a = np.repeat(begin[part], count)
                within = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
                b = where[np.repeat(lo[part], count) + within]
                agree = np.zeros(len(a), np.int64)
                for p in range(long):
                    agree += flat[a + p] == self.flat[b + p]
                good = agree >= required(long, self.similar)
                found.append(np.stack([a[good], b[good], np.full(good.sum(), long)]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((3, 0), np.int64)


def long_enough(words: list[str]) -> list[str]:
    return words if len(words) >= LEAST_WORDS else []


def _finder(shared, names: list[str]):
    def overlaps(table: SeedTable, ids: list, texts: list[str | None]):
        get = table.number.get
        lists = [[get(w, 0) for w in words_of(t)] for t in texts]
        lengths = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((x for row in lists for x in row), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        a, b, long = table.windows(flat, starts, ends)
        doc = np.searchsorted(ends, a, "right")
        order = np.lexsort((a, b - a, table.item[b], doc)) if len(a) else []
        out, last = [], None
        for k in order:  # verified windows only: a handful
            key = (int(doc[k]), int(table.item[b[k]]), int(b[k] - a[k]))
            begin, end = int(a[k]), int(a[k] + long[k])
            if last and last[0] == key and begin <= last[2]:
                last[2] = max(last[2], end)
            else:
                last = [key, begin, end]
                out.append(last)
        for (row, item, shift), begin, end in out:
            same = int((flat[begin:end] == table.flat[begin + shift:end + shift]).sum())
            yield row, ids[item], begin - int(starts[row]), end - int(starts[row]), same

    def run(batches):
        ids, parts = shared.value
        table = SeedTable.of_parts(parts)
        for batch in batches:
            # A few million characters at a time.
            texts, first, size = batch.column(len(names)).to_pylist(), 0, 0
            rows = []
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 4_000_000 or i == len(texts) - 1:
                    rows += [(first + r, *rest) for r, *rest in overlaps(table, ids, texts[first:i + 1])]
                    first, size = i + 1, 0
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kept = [c.take(pa.array(columns[0], pa.int64())) for c in batch.columns[:len(names)]]
            made = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "item_id", "start_word", "end_word", "same_words"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every overlap of a document with a benchmark item: ``keep`` columns, item_id, start_word, end_word (in words of
    the document, end exclusive) and same_words.

    An overlap is a union of aligned windows of WINDOW words (of the whole item, if it is shorter), of which SIMILAR
    agree each. Null, empty and wordless texts overlap nothing, nor do items of fewer than LEAST_WORDS words. Repeated rows give repeated overlaps;
    repeated items are compared once per distinct (item_id, text). Only benchmark words are broadcast, at most
    PASS_WORDS at a time after counting; a larger benchmark takes several passes over the corpus, which give
    the same rows.
    """
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    sized = items.withColumn("_words", F.size(F.split("text", r"[^\p{L}\p{N}]+")))
    total = sized.agg(F.sum("_words")).first()[0] or 0
    passes = -(-total // PASS_WORDS) or 1
    if passes > 1:
        sized = materialize(sized, "benchmark")
    names, found = list(keep), None
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    for k in range(passes):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(
            ([r["item_id"] for r in part], SeedTable([long_enough(words_of(r["text"])) for r in part]).parts()))
        one = docs.select(*names, F.col(text)).mapInArrow(
            _finder(shared, names), f"{kept}, item_id bigint, start_word int, end_word int, same_words int")
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any overlap, the same columns. Rows are told apart by id and text, so a repeated id
    with another text is judged on its own."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", text))
    hits = materialize(
        overlaps(keyed, benchmark, text, ("doc_id", "_key")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hit")).distinct(),
        "contaminated")
    same = (keyed["_key"] == hits["_hit"]) & keyed["doc_id"].eqNullSafe(hits["_id"])
    return keyed.join(hits, same, "left_anti").select(*docs.columns)
