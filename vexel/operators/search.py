"""Exact nearest-neighbour and radius search, for one query and for a table of queries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import vexel.functions.distance as _distance
from vexel.functions.distance import distance, exact, literal, same_size
from vexel.plans.filters import Node, to_column
from vexel.types import DEFAULT_RANGE_RESULTS, DEFAULT_TOP_K, ZERO_NORM, InvalidArgument, Metric, check_top_k

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(_distance)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries that are sent to every task; a larger table of queries is joined in tiles.
SENT_QUERIES = 4096
DIGITS = 6
#: Distances that round alike differ by less than one unit of the last digit.
SLACK = 1.5 * 10.0**-DIGITS
#: Rows and queries that meet in one matrix product, and numbers in a bin of rows of a join in tiles.
BLOCK, CHUNK, TILE = 4096, 512, 1 << 23
#: Pairs of rows and queries that meet in one task of a join in tiles, about.
PAIRS = 1 << 31
#: Rows that are sent to a join's tasks as one value, at most.
PACK = 1 << 14


def live(df: DataFrame, as_of: int | None) -> DataFrame:
    """Rows that haven't expired at ``as_of`` (epoch seconds): expired from expires_at on."""
    if as_of is None or "expires_at" not in df.columns:
        return df
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def select_rows(df: DataFrame, filter: str | Node | None, as_of: int | None, coerce: bool = False) -> DataFrame:
    out = live(df, as_of)
    return out.filter(to_column(filter, df.schema, coerce)) if filter is not None else out


def measured(query: Sequence[float], metric: Metric | str, vector: str = "vector") -> Column:
    """The distance of a row's vector from the query, to DIGITS digits; an error for another dimension."""
    if not len(query):
        raise InvalidArgument("empty query vector")
    return F.when(same_size(F.col(vector), len(query)), F.round(distance(F.col(vector), literal(query), metric), DIGITS))


def _measured(df: DataFrame, query: Sequence[float], metric: Metric | str, vector: str) -> DataFrame:
    return df.withColumn("distance", measured(query, metric, vector))


def knn(df: DataFrame, query: Sequence[float], k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows with their ``distance``, nearest first, ties by id; filter and expiry apply before the choice."""
    rows = _measured(select_rows(df, filter, as_of), query, metric, vector)
    return rows.orderBy("distance", id).limit(check_top_k(k))


def range_search(df: DataFrame, query: Sequence[float], radius: float, metric: Metric | str = Metric.L2, max_results: int = DEFAULT_RANGE_RESULTS, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The rows within ``radius``, nearest first, ties by id, at most ``max_results`` (0 stands for 1000)."""
    if not radius > 0:
        raise InvalidArgument("radius must be positive")
    rows = _measured(select_rows(df, filter, as_of), query, metric, vector)
    return rows.filter(F.col("distance") <= radius).orderBy("distance", id).limit(max_results or DEFAULT_RANGE_RESULTS)


def _values(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors as rows of a matrix, in the precision that they have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != n * len(column) or (np.diff(column.offsets.to_numpy()) != n).any():
        raise ValueError(f"vectors of dimension {n} expected")
    return flat.reshape(-1, n)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return _values(column, n).astype(np.float64)


class Rough:
    """Scores of pairs by matrix products, larger for nearer ones, and what a distance means as a score whatever the products lose to rounding.

    With ``lost`` (l2 only), how far each row of x may be from what it stands for, a score is that of the nearest it may be.
    """

    def __init__(self, x: np.ndarray, square: np.ndarray, q: np.ndarray, qsquare: np.ndarray, metric: str, kind: type, lost: np.ndarray | None = None):
        self.metric, self.kind, self.lost = metric, kind, lost is not None
        n, p = x.shape
        self.x, self.q = np.zeros((n, p + 1 + self.lost), kind), np.zeros((len(q), p + 1 + self.lost), kind)
        self.qq, size, asked = qsquare, np.sqrt(square), np.sqrt(qsquare)
        long, zero = 0.0, asked < ZERO_NORM
        with np.errstate(over="ignore"):
            for i in range(0, n, BLOCK):
                at, part = slice(i, i + BLOCK), x[i : i + BLOCK].astype(np.float64)
                if metric == "cosine":
                    none = size[at] < ZERO_NORM
                    self.x[at, :p], self.x[at, p] = np.where(none[:, None], 0, part / np.maximum(size[at], ZERO_NORM)[:, None]), np.where(none, -1, 0)
                else:
                    self.x[at, :p] = part
                    if metric == "l2":
                        self.x[at, p] = -square[at] / 2 if lost is None else (lost[at] ** 2 - square[at]) / 2
                        if lost is not None:
                            self.x[at, p + 1] = lost[at]
                long = max(long, float(np.sqrt((self.x[at].astype(np.float64) ** 2).sum(axis=1).max())))
            self.q[:, :p] = np.where(zero[:, None], 0, q / np.maximum(asked, ZERO_NORM)[:, None]) if metric == "cosine" else q
            self.q[:, p] = ~zero if metric == "cosine" else 1
        self.zero = zero & (metric == "cosine")
        self.own = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        self.p, self.long = p, long * 2 * (p + 8) * float(np.finfo(kind).eps)
        self.finite = bool(np.isfinite(long) and np.isfinite(self.q).all())

    def scores(self, begin: int, end: int, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        q = self.q[at]
        if self.lost:
            q[:, self.p + 1] = np.where(np.isfinite(limit), limit + SLACK, 0)
        return q @ self.x[begin:end].T

    def _loss(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        own = np.sqrt(self.own[at] ** 2 + limit * limit) if self.lost else self.own[at]
        return self.long * own + 64 * np.finfo(np.float64).eps * (self.qq[at] + 1 + (limit * limit if self.metric == "l2" else np.abs(limit)))

    def _far(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.qq[at] - 2 * score, 0)) if self.metric == "l2" else -score if self.metric == "inner_product" else np.where(self.zero[at], 2.0, 1 - score)

    def most(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The greatest distance that a pair of such a score can have."""
        return self._far(score.astype(np.float64) - self._loss(at, np.zeros(len(at))), at)

    def between(self, score: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance that a pair of such a score can have."""
        far = self.most(score, at)
        return self._far(score.astype(np.float64) + self._loss(at, far), at), far

    def least(self, limit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least score of a pair whose distance is at most ``limit`` when both are rounded."""
        known = np.isfinite(limit)
        far = np.where(known, limit, 0) + SLACK
        low = (self.qq[at] - far * far) / 2 if self.metric == "l2" else -far if self.metric == "inner_product" else 1 - far
        return np.nextafter(np.where(known & ~self.zero[at], low - self._loss(at, far), -np.inf).astype(self.kind), self.kind(-np.inf))


def _set(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a matrix; eight at a time are looked at."""
    if mask.shape[1] % 8:
        return np.flatnonzero(mask)
    eight = np.flatnonzero(mask.view(np.uint64) != 0)
    row, col = np.nonzero(mask.reshape(-1, 8)[eight])
    return eight[row] * 8 + col


def _first(k: int, row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the k first of each row by the keys, row after row."""
    order = np.lexsort((*keys[::-1], row))
    own = row[order]
    return order[np.arange(len(order)) - np.searchsorted(own, own) < k]


def _last(k: int, row: np.ndarray, d: np.ndarray, rows: int) -> np.ndarray:
    """For each row the k-th least d, in single precision and not below it; infinity where there are fewer or one isn't a number."""
    count, out = np.bincount(row, minlength=rows), np.full(rows, np.inf)
    with np.errstate(over="ignore"):
        bits = np.nextafter(np.where(np.isnan(d), np.inf, d).astype(np.float32), np.float32(np.inf)).view(np.int32)
    # The bits of numbers below 0 have to be turned to be in order; one sort does for all rows.
    key = np.sort(row.astype(np.int64) << 32 | (bits ^ (bits >> 31 & 0x7FFFFFFF)).astype(np.int64) + (1 << 31))
    full = np.flatnonzero(count >= k)
    bits = ((key[(np.cumsum(count) - count)[full] + k - 1] & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)
    out[full] = (bits ^ (bits >> 31 & 0x7FFFFFFF)).view(np.float32)
    return out


def _round(d: np.ndarray) -> np.ndarray:
    return np.floor(d * 10**DIGITS + 0.5) / 10**DIGITS


def _exactly(measure: Callable[[np.ndarray, np.ndarray], np.ndarray], place: np.ndarray, row: np.ndarray, pairs: int) -> np.ndarray:
    parts = [_round(measure(place[i : i + pairs], row[i : i + pairs])) for i in range(0, len(row), pairs)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _possible(wait: list[tuple[np.ndarray, ...]], k: int, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs that can still be among the k nearest; ``limit``, how far these can be, is brought down to what they show."""
    held = tuple(map(np.concatenate, zip(*wait, strict=True)))
    np.fmin(limit, _last(k, held[0], held[3], len(limit)), out=limit)
    kept = ~(held[2] > limit[held[0]] + SLACK)
    return tuple(x[kept] for x in held)


def _settled(held: tuple[np.ndarray, ...], k: int, ids: np.ndarray, every: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: int) -> tuple[np.ndarray, ...]:
    """The k nearest of the pairs, all measured."""
    row, place, _, most, known = held
    todo, d = np.flatnonzero(~known), most.copy()
    d[todo] = _exactly(measure, place[todo], every[row[todo]], pairs)
    best = _first(k, row, d, ids[place])
    return row[best], place[best], d[best], d[best], np.ones(len(best), bool)


def closest(ids: np.ndarray, asked: int, k: int, levels: list[Rough], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], cuts: Sequence[tuple[int, int, int]], turns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place of a row, rounded distance) of the k nearest rows of each query, ties by id, query after query.

    Blocks of rows meet blocks of queries in matrix products, whose scores bound the distances. Only the pairs that can
    be among the k nearest in the end are measured, or that bounds can't tell apart before. A level that leaves many pairs is followed by the next one. ``cuts``: (begin, end, group) of rows; ``turns``:
    when a query meets a group, from 0, or -1 for never. Queries that begin with the same group go together, and its first rows bound
    how far the nearest are, which rules out most of the rest.
    """
    out, levels = [], [x for x in levels if x.finite]
    pairs = max(1, (1 << 22) // max(1, levels[0].p if levels else 64))
    own = None if turns is None else np.where(turns < 0, turns.shape[1], turns).argmin(axis=1)
    line = np.arange(asked) if own is None else np.argsort(own, kind="stable")
    for begin in range(0, asked, CHUNK):
        every = line[begin : begin + CHUNK]
        limit = np.full(len(every), np.inf)
        # (query, place, least and greatest distance, whether it has been measured)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
        wait, waiting, turn, step = [held], 0, 0, 1
        late = None if turns is None else np.where(turns[every] < 0, turns.shape[1], turns[every]).sum(axis=0)
        near = cuts if late is None else sorted(cuts, key=lambda c: late[c[2]])
        for a, b, g in near if levels and own is not None else ():
            sel, w = np.flatnonzero((own[every] == g) & (turns[every, g] >= 0)), min(b - a, BLOCK)
            if len(sel) and w > k:
                s = levels[-1].scores(a, a + w, every[sel], limit[sel])
                limit[sel] = levels[-1].most(np.partition(s, w - k, axis=1)[:, w - k], every[sel])
        blocks = [(i, min(i + BLOCK, b), g) for a, b, g in near for i in range(a, b, BLOCK)]
        for a, b, g in blocks:
            sel = np.arange(len(every)) if turns is None else np.flatnonzero(turns[every, g] >= 0)
            if not len(sel):
                continue
            new = sel[np.isinf(limit[sel])]
            if levels and len(new) and b - a > k:
                w = min(b - a, max(1024, 8 * k))
                s = levels[-1].scores(a, a + w, every[new], limit[new])
                limit[new] = levels[-1].most(np.partition(s, w - k, axis=1)[:, w - k], every[new])
            level, score, hit, before = None, None, None, 0
            for level in list(levels):
                score, least = level.scores(a, b, every[sel], limit[sel]), level.least(limit[sel], every[sel])
                # Most queries have no such row here; to find the largest score takes less than to compare all.
                some = np.flatnonzero(~(score.max(axis=1) < least))
                if 2 * len(some) < len(sel):
                    score, least = score[some], least[some]
                else:
                    some = np.arange(len(sel))
                mask = score >= least[:, None]
                many = int(np.count_nonzero(mask))
                if before > 2 * many:
                    levels.remove(last)  # it rules out too little here to be worth a product
                if many <= len(sel) * (b - a) >> (8 if level.lost else 4):
                    break
                last, before = level, many
            hit = _set(mask) if levels else np.arange(len(sel) * (b - a))
            row, place = np.divmod(hit, b - a)
            row, place = sel[some[row]] if levels else sel[row], place + a
            if levels and not level.lost:
                least, most = level.between(score.ravel()[hit], every[row])
                new = (row, place, least, most, np.zeros(len(row), bool))
            else:
                d = _exactly(measure, place, every[row], pairs)
                new = (row, place, d, d, np.ones(len(row), bool))
            wait.append(new)
            waiting += len(row)
            turn += 1
            if turn >= step or waiting > 2 * k * len(every):
                held = _possible(wait, k, limit)
                if len(held[0]) > 4 * k * len(every):
                    held = _possible([_settled(held, k, ids, every, measure, pairs)], k, limit)
                wait, waiting, step = [held], 0, max(step, 2 * turn)
        held = _settled(_possible(wait, k, limit), k, ids, every, measure, pairs)
        out.append((every[held[0]], held[1], held[3]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, place, d = (np.concatenate(c) for c in zip(*out, strict=True))
    if turns is not None:
        order = np.argsort(row, kind="stable")
        row, place, d = row[order], place[order], d[order]
    return row, place, d


def levels_of(x: np.ndarray, square: np.ndarray, q: np.ndarray, qsquare: np.ndarray, metric: str) -> list[Rough]:
    """In single precision, and in double where that can't tell rows apart."""
    first = Rough(x, square, q, qsquare, metric, np.float32)
    if first.finite and first.long * max(1.0, float(np.sqrt(qsquare.max()))) < 1e-3 * max(1e-9, float(np.median(square) if metric == "l2" else 1.0)):
        return [first]
    return [first, Rough(x.astype(np.float64), square, q, qsquare, metric, np.float64)]


def exact_levels(x: np.ndarray, q: np.ndarray, metric: str) -> list[Rough]:
    """In single precision, from the middle of the rows where only differences count; and in double where that can't tell them apart."""
    if not len(x) or not len(q):
        return []
    with np.errstate(over="ignore", invalid="ignore"):
        mid = x.mean(axis=0, dtype=np.float64) if metric == "l2" else np.zeros(x.shape[1])
        square = np.concatenate([((x[i : i + BLOCK].astype(np.float64) - mid) ** 2).sum(axis=1) for i in range(0, len(x), BLOCK)])
        moved = q.astype(np.float64) - mid
        qq = (moved**2).sum(axis=1)
        x = x if not mid.any() else np.concatenate([(x[i : i + BLOCK].astype(np.float64) - mid).astype(x.dtype if x.dtype == np.float64 else np.float32) for i in range(0, len(x), BLOCK)])
        if not np.isfinite(square).all() or not np.isfinite(qq).all():
            return []
        # A row that was single has been rounded once more when it was moved.
        return levels_of(x, square, moved, qq, metric)


def few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those of which k copies have smaller ids."""
    whole = np.ascontiguousarray(x)
    # Rows that are alone with their hash have no copy; only the others are sorted.
    words = whole.view(f"u{whole.dtype.itemsize}")
    odd = np.random.default_rng(0).integers(1 << 63, size=words.shape[1], dtype=np.uint64) << 1 | 1
    hashes = np.zeros(len(whole), np.uint64)
    for i in range(0, len(whole), BLOCK):
        part = words[i : i + BLOCK] * odd
        hashes[i : i + BLOCK] = (part ^ part >> 32).sum(axis=1, dtype=np.uint64)
    _, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
    more = count[at] > k
    some = np.flatnonzero(more)
    if not len(some):
        return np.arange(len(whole))
    _, which = np.unique(whole[some].view(np.dtype((np.void, whole.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    return np.sort(np.concatenate([np.flatnonzero(~more), some[_first(k, which, ids[some])]]))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, rounded distance) of the k nearest rows of each query; by matrix products, then exactly for all that can be among them, ties included."""
    kept = few_copies(x, ids, k)
    if len(kept) < len(x):
        x, ids = x[kept], ids[kept]
    wide = lambda a: a.astype(np.float64)
    row, place, d = closest(ids, len(q), k, exact_levels(x, q, metric), lambda c, r: exact(wide(x[c]), wide(q[r]), metric), [(0, len(x), 0)])
    return row, ids[place], d


def _both(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[Rough, Rough] | None:
    """Scores of x asking for y and of y asking for x that are the same products; none where single precision or a zero row forbids it."""
    with np.errstate(over="ignore", invalid="ignore"):
        mid = (x.sum(axis=0, dtype=np.float64) + y.sum(axis=0, dtype=np.float64)) / (len(x) + len(y)) if metric == "l2" else 0.0
        x, y = x.astype(np.float64) - mid, y.astype(np.float64) - mid
        squares = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if not all(np.isfinite(s).all() and (metric != "cosine" or (np.sqrt(s) >= ZERO_NORM).all()) for s in squares):
            return None
        out = Rough(y, squares[1], x, squares[0], metric, np.float32), Rough(x, squares[0], y, squares[1], metric, np.float32)
        for r in out:
            if metric == "l2":
                # With the query's own square in it, a score is half the squared distance, negated, from either side.
                r.q, r.x = np.column_stack([r.q, (-r.qq / 2).astype(np.float32)]), np.column_stack([r.x, np.ones(len(r.x), np.float32)])
                r.own = np.sqrt((r.q.astype(np.float64) ** 2).sum(axis=1))
                r.long = float(np.sqrt((r.x.astype(np.float64) ** 2).sum(axis=1).max())) * 2 * (r.p + 9) * float(np.finfo(np.float32).eps)
                r.finite = bool(r.finite and np.isfinite(r.long) and np.isfinite(r.q).all())
                r.qq = np.zeros(len(r.qq))
            if not r.finite or not r.long * max(1.0, float(r.own.max())) < 1e-3 * max(1e-9, float(np.median(np.concatenate(squares))) if metric == "l2" else 1.0):
                return None
    return out


def _at_least(score: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A score that k of a row, or of a column, reach: the least of the largest of k parts."""
    g = score.shape[axis] // k
    if axis:
        return score[:, : g * k].reshape(len(score), k, g).max(axis=2).min(axis=1)
    return score[: g * k].reshape(k, g, -1).max(axis=1).min(axis=0)


class _Held:
    """Pairs of queries that wait to be compared, and how far the k nearest of each query can be."""

    def __init__(self, rough: Rough, every: np.ndarray, k: int, ids: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.rough, self.every, self.k, self.ids, self.measure = rough, every, k, ids, measure
        self.limit, self.pairs = np.full(len(every), np.inf), max(1, (1 << 22) // max(1, rough.p))
        self.wait: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))]
        self.waiting, self.turn, self.step = 0, 0, 1

    def add(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        self.wait.append((row, place, *self.rough.between(score, self.every[row]), np.zeros(len(row), bool)))
        self.waiting += len(row)

    def look(self, turn: bool = True) -> None:
        self.turn += turn
        if (turn and self.turn >= self.step) or self.waiting > 2 * self.k * len(self.every):
            held = _possible(self.wait, self.k, self.limit)
            if len(held[0]) > 4 * self.k * len(self.every):
                held = _possible([_settled(held, self.k, self.ids, self.every, self.measure, self.pairs)], self.k, self.limit)
            self.wait, self.waiting, self.step = [held], 0, max(self.step, 2 * self.turn)

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = _settled(_possible(self.wait, self.k, self.limit), self.k, self.ids, self.every, self.measure, self.pairs)
        return self.every[held[0]], held[1], held[3]


def mutual(x: np.ndarray, xids: np.ndarray, y: np.ndarray, yids: np.ndarray, k: int, metric: str) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """``_nearest`` of y for each row of x and of x for each row of y, from one product for each pair."""
    both = _both(x, y, metric) if len(few_copies(x, xids, k)) == len(x) and len(few_copies(y, yids, k)) == len(y) else None
    if both is None:
        return _nearest(y, yids, x, k, metric), _nearest(x, xids, y, k, metric)
    wide = lambda a: a.astype(np.float64)
    there = _Held(both[1], np.arange(len(y)), k, xids, lambda c, r: exact(wide(x[c]), wide(y[r]), metric))
    out = []
    for begin in range(0, len(x), CHUNK):
        every = np.arange(begin, min(begin + CHUNK, len(x)))
        here = _Held(both[0], every, k, yids, lambda c, r: exact(wide(y[c]), wide(x[r]), metric))
        for a in range(0, len(y), BLOCK):
            b = min(a + BLOCK, len(y))
            score, asked = both[0].scores(a, b, every, here.limit), np.arange(a, b)
            if not a and b - a >= k:
                here.limit = both[0].most(_at_least(score, k, 1), every)
            if not begin and len(every) >= k:
                there.limit[a:b] = both[1].most(_at_least(score, k, 0), asked)
            # Few rows of x have such a row of y here; to find the largest score takes less than to compare all.
            least = both[0].least(here.limit, every)
            some = np.flatnonzero(~(score.max(axis=1) < least))
            part = score[some]
            hit = _set(part >= least[some][:, None])
            row, place = np.divmod(hit, b - a)
            here.add(some[row], place + a, part.ravel()[hit])
            hit = _set(score >= both[1].least(there.limit[a:b], asked)[None])
            row, place = np.divmod(hit, b - a)
            there.add(place + a, row + begin, score.ravel()[hit])
            here.look()
            there.look(False)
        out.append(here.end())
        there.look()
    row, place, d = (np.concatenate(c) for c in zip(*out, strict=True))
    back, of, far = there.end()
    return (row, yids[place], d), (back, xids[of], far)


def spread(spark: SparkSession, parts: int) -> list[int]:
    """A key for each of ``parts`` partitions that Spark's hash sends there, so that no partition gets two keys while another has none."""
    found, begin = {}, 0
    while len(found) < parts:
        end = begin + 16 * parts + 1000
        found |= {r[1]: r[0] for r in spark.range(begin, end).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))).collect()}
        begin = end
    return [found[i] for i in range(parts)]


def _packed(part: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write(part)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: pa.ChunkedArray) -> pa.Table | None:
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks]
    return pa.concat_tables(parts) if parts else None


def packs(df: DataFrame, key: str, bins: int, width: int) -> DataFrame:
    """(bin, block): the rows of ``df`` by bin of the hash of their key, many to a block, so that sending one costs next to nothing whatever it has."""
    most = max(1, min(PACK, (1 << 20) // max(1, width)))

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        own, table = table.column("__bin").to_numpy(), table.drop_columns("__bin")
        order = np.argsort(own, kind="stable")
        begins = np.flatnonzero(np.diff(own[order], prepend=-1))
        for i, j in zip(begins, np.append(begins[1:], len(order)), strict=True):
            for a in range(i, j, most):
                block = _packed(table.take(pa.array(order[a : min(a + most, j)])))
                yield pa.RecordBatch.from_arrays([pa.array(own[order[a : a + 1]], pa.int32()), pa.array([block], pa.binary())], names=["bin", "block"])

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in stream:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 4 * most:
                yield from blocks(held)
                held, count = [], 0
        if held:
            yield from blocks(held)

    return df.withColumn("__bin", F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")).mapInArrow(pack, "bin int, block binary")


def tiled(rows: DataFrame, asked: DataFrame, n: int, k: int, want: int, near: Callable[[pa.Table, pa.Table], tuple[np.ndarray, ...]], tiles: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): every bin of rows meets every bin of queries in one task.

    Bins are of at most about TILE numbers and tasks of PAIRS pairs, so a task's memory and time don't grow with the tables. ``near`` gives (query row, id,
    order, distance) of the ``want`` first of each query; they are sent as one row a query and bin. Of all of them the first
    ``want`` by order and id count, and of these the k nearest.
    """
    there, many = rows.count(), asked.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    bins = tiles or max(1, -(-there * n // TILE))
    asks = tiles or max(-(-many * n // (TILE // 2)), -(-there * many // (bins * PAIRS)), min(-(-2 * cores // bins), many // 256), 1)
    # One partition a tile, since a tile is much work whatever its bytes.
    parts = bins * asks
    keys = F.array(*map(F.lit, spread(rows.sparkSession, parts)))
    left = rows.withColumn("__at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(asks - 1)), lambda i: keys[F.pmod(F.xxhash64("id"), F.lit(bins)).cast("int") * asks + i])))
    right = asked.withColumn("__at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: keys[i * asks + F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")])))

    def tile(x: pa.Table, q: pa.Table) -> pa.Table:
        row, own, order, d = near(x, q) if len(x) and len(q) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        offsets = pa.array(np.append(begins, len(row)), pa.int32())
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in (("ids", own), ("orders", order), ("distances", d))}
        return pa.table({"query_id": pa.array(q.column("query_id").to_numpy()[row[begins]] if len(q) else np.zeros(0, np.int64), pa.int64()), **lists})

    def merged(got: pa.Table) -> pa.Table:
        lists = [got.column(c).combine_chunks() for c in ("ids", "orders", "distances")]
        own, order, d = (x.flatten().to_numpy() for x in lists)
        qid = np.repeat(got.column("query_id").to_numpy(), np.diff(lists[0].offsets.to_numpy()))
        first = _first(want, qid, order, own)
        first = first[_first(k, qid[first], d[first], own[first])]
        qid = qid[first]
        rank = np.arange(len(qid)) - np.searchsorted(qid, qid) + 1
        return pa.table({"query_id": qid, "id": own[first], "distance": d[first], "rank": rank.astype(np.int32)})

    packed = left.repartition(parts, "__at").groupBy("__at").cogroup(right.repartition(parts, "__at").groupBy("__at")).applyInArrow(tile, "query_id long, ids array<long>, orders array<double>, distances array<double>")
    groups = max(cores, -(-many * bins * want // (1 << 21)))
    return packed.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("__group")).applyInArrow(merged, "query_id long, id long, distance double, rank int")


def knn_join(base: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, filter: str | Node | None = None, as_of: int | None = None, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", sent: int = SENT_QUERIES, tiles: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of ``base`` for every row of ``queries``.

    Up to ``sent`` queries go to every task, which then gives its own k best of each; more are joined in tiles of bounded
    bins of rows and queries. Either way only k rows per query and task are shuffled for the final rank.
    """
    check_top_k(k)
    metric = Metric.of(metric).value
    spark = base.sparkSession
    rows = select_rows(base, filter, as_of).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("query_vector"))
    schema = "query_id long, id long, distance double"
    few = asked.limit(sent + 1).toArrow()
    if not len(few):
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    n = len(few.column("query_vector")[0])
    if len(few) <= sent:
        held = spark.sparkContext.broadcast((few.column("query_id").to_numpy(), _matrix(few.column("query_vector"), n)))

        def near(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            for batch in stream:
                if batch.num_rows:
                    r, own, d = _nearest(_values(batch.column("vector"), n), batch.column("id").to_numpy(), q, k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(own), pa.array(d)], names=["query_id", "id", "distance"])

        found = rows.mapInArrow(near, schema)
    else:
        def tile(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, ...]:
            r, own, d = _nearest(_values(x.column("vector"), n), x.column("id").to_numpy(), _values(q.column("query_vector"), n), k, metric)
            return r, own, d, d

        return tiled(rows, asked, n, k, k, tile, tiles)
    return ranked(found, "query_id", k)


def knn_self_join(base: DataFrame, k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, id: str = "id", vector: str = "vector", sent: int = SENT_QUERIES, tiles: int | None = None) -> DataFrame:
    """``knn_join`` of a table with itself, with half its products: a product serves both rows of a pair.

    A task has two bins of rows, each of about half of TILE numbers at most, and about PAIRS pairs. A bin goes to as many
    tasks as there are bins; the k nearest of each row and bin are sent in blocks for the final rank.
    """
    check_top_k(k)
    metric = Metric.of(metric).value
    rows = base.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    there = rows.count()
    if there <= sent:
        return knn_join(rows, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), k, metric, sent=sent)
    n, cores = len(rows.select("vector").first()[0]), rows.sparkSession.sparkContext.defaultParallelism
    # For two tasks a core, as far as bins keep 256 rows.
    few = next(m for m in range(1, 4 * cores + 2) if m * (m + 1) >= 4 * cores)
    bins = tiles or max(-(-there * n // (TILE // 2)), int(np.ceil(there / np.sqrt(PAIRS))), min(few, there // 256), 1)
    parts = bins * (bins + 1) // 2
    keys = F.array(*map(F.lit, spread(rows.sparkSession, parts)))
    groups = -(-there * k // (1 << 21))
    low, high = F.least("bin", "other"), F.greatest("bin", "other")
    at = keys[low * bins - F.shiftright(low * (low - 1), 1) + high - low]
    # Blocks are dealt out before they are copied, since a small table is read by few tasks.
    blocks = packs(rows, "id", bins, n).repartition(cores).select("bin", "block", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("other")).withColumn("__at", at)

    def tile(got: pa.Table) -> pa.Table:
        own, other = (got.column(c).to_numpy() for c in ("bin", "other"))
        first, found = min(own[0], other[0]), []
        x, y = (_unpacked(got.column("block").filter(pa.array(own == b))) for b in (first, max(own[0], other[0])))
        if x is not None and y is not None:
            xs, xids = _values(x.column("vector"), n), x.column("id").to_numpy()
            if own[0] == other[0]:
                found = [(own[0], xids, _nearest(xs, xids, xs, k, metric))]
            else:
                yids = y.column("id").to_numpy()
                a, b = mutual(xs, xids, _values(y.column("vector"), n), yids, k, metric)
                found = [(first, xids, a), (max(own[0], other[0]), yids, b)]
        out = []
        for b, ids, (row, near, d) in found:
            qid = ids[row]
            group = (qid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
            part = pa.table({"query_id": qid, "id": near, "distance": d})
            out += [(int(b) * groups + int(g), _packed(part.filter(pa.array(group == g)))) for g in np.unique(group)]
        return pa.table({"__group": pa.array([g for g, _ in out], pa.int64()), "block": pa.array([b for _, b in out], pa.binary())})

    def merged(got: pa.Table) -> pa.Table:
        qid, own, d = (c.to_numpy() for c in _unpacked(got.column("block")).columns)
        first = _first(k, qid, d, own)
        qid = qid[first]
        rank = np.arange(len(qid)) - np.searchsorted(qid, qid) + 1
        return pa.table({"query_id": qid, "id": own[first], "distance": d[first], "rank": rank.astype(np.int32)})

    # One partition a tile, since a tile is much work whatever its bytes.
    packed = blocks.repartition(parts, "__at").groupBy("__at").applyInArrow(tile, "__group long, block binary")
    return packed.groupBy("__group").applyInArrow(merged, "query_id long, id long, distance double, rank int")


def ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join_columns(base: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, metric: Metric | str = Metric.L2, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The same from built-in functions only, as a nested-loop join with a group limit."""
    check_top_k(k)
    b = base.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))
    d: Column = F.round(distance(F.col("vector"), F.col("query_vector"), metric), DIGITS)
    return ranked(b.crossJoin(q).select("query_id", "id", d.alias("distance")), "query_id", k)
