"""Numpy part of nearest-neighbour search: the best k candidates of each question, kept while
corpus vectors stream through a task. Memory is questions x k plus one tile."""

from __future__ import annotations

import numpy as np

TILE = 2048
ROWS = 512  # questions that a tile is compared with at once: the products stay in the cache
FIRST = 256  # records of the first tile, which has no bound yet; later tiles grow with what was seen
PAIRS = 65_536
NEVER = -1e30  # no score is as low
ROUNDING = 1e-9
SINGLE, DOUBLE = float(np.finfo("float32").eps), float(np.finfo("float64").eps)
LONGEST = 1e15  # squares of longer vectors leave single precision
METRICS = ("l2sq", "cosine", "ip")


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / lengths


def _tile_scores(questions: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """All scores of a tile by one matrix product; correct up to rounding."""
    products = questions @ vectors.T
    if metric != "l2sq":
        return 1.0 - products
    return (questions * questions).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :] - 2.0 * products


def _pair_scores(questions: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Final scores of selected pairs, summed element by element."""
    if metric == "l2sq":
        gaps = questions - vectors
        return (gaps * gaps).sum(axis=1)
    return 1.0 - (questions * vectors).sum(axis=1)


def _without_surplus_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal vectors score alike for every question, so of each only the k smallest ids can be hits.
    Exact, and keeps a corpus full of copies from making every row a candidate."""
    packed = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    distinct, group = np.unique(packed, return_inverse=True)
    if len(distinct) == len(packed):
        return ids, vectors
    order = np.lexsort((ids, group))
    group = group[order]
    kept = order[np.arange(len(group)) - np.searchsorted(group, group, side="left") < k]
    return ids[kept], vectors[kept]


def _true_places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask that is nearly all false: eight places are passed over at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view("uint64") != 0)
    places = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[flat[places]], whole + np.flatnonzero(flat[whole:])])


class NearestSoFar:
    """Running top-k by (score, id) for every question row. Equal scores are settled by id, so the
    outcome does not depend on the order in which tiles arrive. A tile is screened in single precision with a bound on its
    rounding, and what passes is scored again; only the questions that it reaches are touched."""

    def __init__(self, questions: np.ndarray, k: int, metric: str, tile: int = TILE) -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.metric = metric
        self.questions = unit(questions) if metric == "cosine" else questions
        self.k, self.tile, self.seen = k, max(1, min(tile, TILE)), 0
        self.limit = np.full(len(questions), np.inf)
        # A question without a usable vector has no hits. Its bound is settled, or its whole tile would stay unbounded.
        unusable = ~np.isfinite(self.questions).all(axis=1)
        if unusable.any():
            self.questions = np.where(unusable[:, None], 0.0, self.questions)
            self.limit[unusable] = NEVER
        self.count = np.zeros(len(questions), dtype="int64")
        self._score = np.full((len(questions), k), np.inf)
        self._id: np.ndarray | None = None
        squared = (self.questions * self.questions).sum(axis=1)
        self._length = np.sqrt(squared)
        # A tile's scores without what all records share: |v|^2 - 2 q.v of |q|^2 + |v|^2 - 2 q.v, or -q.v of 1 - q.v.
        self._shared = squared if metric == "l2sq" else np.ones(len(questions))
        with np.errstate(over="ignore", invalid="ignore"):
            self._single = (-2.0 * self.questions if metric == "l2sq" else -self.questions).astype("float32")
        if metric == "l2sq":
            self._single = np.hstack([self._single, np.ones((len(questions), 1), dtype="float32")])
        self._products = np.empty(ROWS * self.tile, dtype="float32")

    @property
    def _filled(self) -> np.ndarray:
        return np.arange(self.k)[None, :] < self.count[:, None]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def score(self) -> np.ndarray:
        return self._score[self._filled]

    @property
    def id(self) -> np.ndarray | None:
        return None if self._id is None else self._id[self._filled]

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Records to compare with all questions, or with those of ``rows`` (ascending)."""
        vectors = vectors.astype("float64")
        if self.metric == "cosine":
            vectors = unit(vectors)
        usable = np.isfinite(vectors).all(axis=1)
        if not usable.all():
            ids, vectors = ids[usable], vectors[usable]
        if not len(vectors):
            return
        if len(vectors) > self.k:
            ids, vectors = _without_surplus_copies(ids, vectors, self.k)
        if rows is not None and len(rows) == len(self.limit):
            rows = None
        n = len(self.limit) if rows is None else len(rows)
        a = 0
        while a < len(vectors):
            end = a + min(self.tile, max(FIRST, self.seen))
            tile_ids, tile = ids[a:end], vectors[a:end]
            a = end
            if rows is None:
                self.seen += len(tile)
            squared = (tile * tile).sum(axis=1)
            longest = np.sqrt(squared.max())
            single = tile.astype("float32") if longest < LONGEST else None
            if single is not None and self.metric == "l2sq":
                single = np.hstack([single, squared.astype("float32")[:, None]])
            for b in range(0, n, ROWS):
                chosen = slice(b, min(b + ROWS, n)) if rows is None else rows[b:b + ROWS]
                self._add_tile(tile_ids, tile, single, longest, chosen)

    def _add_tile(
        self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray | None, longest: float, chosen: slice | np.ndarray,
    ) -> None:
        bound, length = self.limit[chosen], self._length[chosen]
        size = length + longest
        passed = None
        if single is not None and np.isfinite(bound).all() and length.max() < LONGEST:
            # Rounding of a sum of that many products, each at most as large as the lengths allow.
            slack = ROUNDING * (1.0 + np.abs(bound)) + (vectors.shape[1] + 8) * SINGLE * size * size
            most = np.nextafter((bound - self._shared[chosen] + slack).astype("float32"), np.float32(np.inf))
            products = self._products[:len(bound) * len(single)].reshape(len(bound), len(single))
            passed = np.matmul(self._single[chosen], single.T, out=products) <= most[:, None]
            if np.count_nonzero(passed) > 4 * self.k * len(bound):
                passed = None
        if passed is None:
            scores = _tile_scores(self.questions[chosen], vectors, self.metric)
            if len(ids) > self.k:
                bound = np.minimum(bound, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1])
            # The matrix product rounds differently: keep everything within its error, score it again exactly.
            slack = ROUNDING * (1.0 + np.abs(np.where(np.isfinite(bound), bound, 0.0))) + (vectors.shape[1] + 8) * DOUBLE * size * size
            passed = scores <= (bound + slack)[:, None]
        flat = _true_places(passed)
        row, at = flat // len(ids), flat % len(ids)
        row = row + chosen.start if isinstance(chosen, slice) else chosen[row]
        for a in range(0, len(row), PAIRS):
            r, v = row[a:a + PAIRS], at[a:a + PAIRS]
            score = _pair_scores(self.questions[r], vectors[v], self.metric)
            near = score <= self.limit[r]
            if near.any():
                self._merge(r[near], score[near], ids[v[near]])

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self._id is None:
            self._id = np.zeros(self._score.shape, dtype=ids.dtype)
        wide = np.promote_types(self._id.dtype, ids.dtype)
        if wide != self._id.dtype:
            self._id = self._id.astype(wide)
        touched = np.unique(row)
        filled = np.arange(self.k)[None, :] < self.count[touched][:, None]
        row = np.concatenate([np.repeat(touched, self.count[touched]), row])
        score = np.concatenate([self._score[touched][filled], score])
        ids = np.concatenate([self._id[touched][filled], ids])
        order = np.lexsort((score, row))
        if ((np.diff(score[order]) == 0) & (np.diff(row[order]) == 0)).any():  # ids are slow to compare: only where scores are equal
            order = np.lexsort((ids, score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = place < self.k
        row, place = row[kept], place[kept]
        self._score[row, place], self._id[row, place] = score[kept], ids[kept]
        self.count[touched] = np.bincount(np.searchsorted(touched, row), minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        self.limit[full] = self._score[full, self.k - 1]
