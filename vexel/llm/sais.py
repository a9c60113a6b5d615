"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes are told apart into descending (L) and ascending (S) ones. Those S
suffixes that follow an L suffix are sorted by recursion on their names; from them
the L suffixes are induced in ascending order, and from these the S suffixes in
descending order. Both passes are driven by a priority queue of tuples (letter,
rank of the suffix behind it, position): a suffix that leaves the queue puts in the
one before it. The queue is kept in runs on disk beyond a given memory, and works
in blocks of letters, so that its cost is in array operations and not per tuple.
Common-prefix values are carried along: that of two neighbours is one more than
the least value between the suffixes behind them.
"""

from __future__ import annotations

import os
import shutil

import numpy as np

from vexel.llm.common import by_value, temp_dir

by_value(__name__, "vexel.llm.common")

BLOCK = 1 << 15
GROUP = 32
MEMORY = 1 << 21
#: The greatest common-prefix value that can be asked for.
LONGEST = 4_000_000_000


def _kind(cap: int) -> type:
    """The least type of whole numbers that holds common-prefix values up to ``cap`` and one more."""
    return np.uint8 if cap < 255 else np.uint16 if cap < 65_535 else np.int64


class TupleQueue:
    """A priority queue of (letter, rank, position) for letters that are taken in ascending ranges.

    Tuples of the group of ranges in use are held by range; those of later groups are held by group, in memory up
    to a number of tuples and in files beyond.
    """

    def __init__(self, folder: str, ranges: int, memory: int = MEMORY):
        self.folder, self.memory = folder, memory
        self.near: dict[int, list[np.ndarray]] = {}
        self.far: dict[int, list[np.ndarray]] = {}
        self.held, self.now, self.spills = 0, 0, 0
        self.ranges = ranges

    def put(self, where: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        near = where < (self.now + 1) * GROUP
        if near.any():
            self._split(self.near, where[near], rows[near])
        if not near.all():
            where, rows = where[~near], rows[~near]
            self.held += len(rows)
            self._split(self.far, where // GROUP, rows)
            if self.held > self.memory:
                self._spill()

    @staticmethod
    def _split(into: dict[int, list[np.ndarray]], where: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(where, kind="stable")
        where, rows = where[order], rows[order]
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            into.setdefault(int(where[a]), []).append(rows[a:b])

    def _spill(self) -> None:
        for group, parts in self.far.items():
            with open(os.path.join(self.folder, f"group-{group}"), "ab") as f:
                for p in parts:
                    f.write(np.ascontiguousarray(p).tobytes())
        self.far, self.held = {}, 0
        self.spills += 1

    def take(self, at: int, bounds: np.ndarray) -> np.ndarray:
        """All tuples of a range; ranges are taken in ascending order."""
        group = at // GROUP
        if group > self.now or at == 0:
            self.now = group
            parts = self.far.pop(group, [])
            self.held -= sum(map(len, parts))
            name = os.path.join(self.folder, f"group-{group}")
            if os.path.exists(name):
                parts.append(np.fromfile(name, dtype=np.int64).reshape(-1, 3))
                os.remove(name)
            if parts:
                rows = np.concatenate(parts)
                self._split(self.near, np.searchsorted(bounds, rows[:, 0]), rows)
        parts = self.near.pop(at, [])
        return np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)


class Minima:
    """Least values of stretches of a growing array: for each power of two, the minimum of so many values up to each place."""

    def __init__(self, n: int, folder: str, memory: int, kind: type = np.uint8):
        levels = max(1, int(n).bit_length())
        if levels * n * np.dtype(kind).itemsize > memory * 24:
            self.of = np.memmap(os.path.join(folder, "minima"), dtype=kind, mode="w+", shape=(levels, n))
        else:
            self.of = np.empty((levels, n), dtype=kind)

    def append(self, at: int, values: np.ndarray) -> None:
        end = at + len(values)
        self.of[0, at:end] = values
        for k in range(1, len(self.of)):
            half = 1 << (k - 1)
            low = max(at, 2 * half - 1)
            if low >= end:
                break
            self.of[k, low:end] = np.minimum(self.of[k - 1, low:end], self.of[k - 1, low - half : end - half])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over (a, b], a < b."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.of[k, b], self.of[k, a + (1 << k)])


def _ascending(t: np.ndarray) -> np.ndarray:
    """Is each suffix of the text smaller than the next; the last letter is the only smallest."""
    n = len(t)
    step = np.sign(np.diff(t))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    out[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return out


def _runs(t: np.ndarray) -> np.ndarray:
    """How many letters equal to it begin at each place."""
    n = len(t)
    last = np.concatenate((t[1:] != t[:-1], [True]))
    at = np.where(last, np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(n) + 1


def _ranges(t: np.ndarray, block: int) -> np.ndarray:
    """Upper bounds of letter ranges of about ``block`` suffixes; a letter that follows itself anywhere is alone in its range."""
    letters, count = np.unique(t, return_counts=True)
    alone = np.isin(letters, t[1:][t[1:] == t[:-1]]) | (count >= block)
    part = np.cumsum(np.where(alone, 0, count)) // block
    side = np.cumsum(alone)
    last = np.ones(len(letters), dtype=bool)
    last[:-1] = alone[:-1] | alone[1:] | (part[1:] != part[:-1]) | (side[1:] != side[:-1])
    return letters[last]


def _induce(t: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, target: np.ndarray, cap: int, folder: str, block: int, memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Seeds and targets together in ascending order, from the seeds in ascending order; of one letter the targets come first.

    A target follows from the suffix behind it, whose letter isn't larger than its own.
    """
    bounds = _ranges(t, block)
    total = len(seeds) + int(target.sum())
    order, done = np.empty(total, dtype=np.int64), 0
    lcp = np.zeros(total, dtype=_kind(cap)) if seed_lcp is not None else None
    minima = Minima(total, folder, memory, _kind(cap)) if seed_lcp is not None else None
    run = _runs(t) if seed_lcp is not None else None
    queue = TupleQueue(folder, len(bounds), memory)
    seed_cut = np.searchsorted(t[seeds], bounds, side="right")
    low = 0
    letters_in = np.searchsorted(np.unique(t), bounds, side="right")
    single = np.diff(np.concatenate(([0], letters_in))) == 1

    def before(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = pos - 1
        ok = np.flatnonzero(p >= 0)
        ok = ok[target[p[ok]]]
        return ok, p[ok]

    for g, high in enumerate(bounds):
        first = queue.take(g, bounds)
        own = np.arange(low, seed_cut[g])
        low = seed_cut[g]
        if single[g]:
            first = first[np.argsort(first[:, 1], kind="stable")]
            waves, size, cur = [first], len(first), first[:, 2]
            base = 0
            while len(cur):
                ok, p = before(cur)
                same = t[p] == high
                ok, p = ok[same], p[same]
                waves.append(np.column_stack((t[p], done + base + ok, p)))
                base, size, cur = size, size + len(p), p
            rows = np.concatenate(waves)
            pos, rank, n_targets = np.concatenate((rows[:, 2], seeds[own])), rows[:, 1], len(rows)
            kind = np.concatenate((np.zeros(n_targets, bool), np.ones(len(own), bool)))
            rank = np.concatenate((rank, own))
        else:
            rows, prior = first, None
            while True:
                pos = np.concatenate((rows[:, 2], seeds[own]))
                kind = np.concatenate((np.zeros(len(rows), bool), np.ones(len(own), bool)))
                rank = np.concatenate((rows[:, 1], own))
                o = np.lexsort((rank, kind, t[pos]))
                pos, kind, rank = pos[o], kind[o], rank[o]
                ok, p = before(pos)
                inner = t[p] <= high
                ok, p = ok[inner], p[inner]
                more = np.column_stack((t[p], done + ok, p))
                if prior is not None and len(prior) == len(more) and np.array_equal(prior, more):
                    break
                if prior is None and not len(more):
                    break
                prior, rows = more, np.concatenate((first, more))
        m = len(pos)
        if not m:
            continue
        order[done : done + m] = pos
        if lcp is not None:
            value = np.zeros(m, dtype=np.int64)
            same = np.concatenate(([False], t[pos[1:]] == t[pos[:-1]]))
            both = same & kind & np.concatenate(([False], kind[:-1]))
            value[both] = seed_lcp[rank[both]]
            edge = np.flatnonzero(same & kind & ~both)
            value[edge] = np.minimum(run[pos[edge]], run[pos[edge - 1]])
            mid = same & ~kind
            behind = np.where(mid, rank, -1)
            at = 0
            while at < m:
                late = behind[at:] >= done + at
                end = at + int(np.argmax(late)) if late.any() else m
                i = np.flatnonzero(mid[at:end]) + at
                if len(i):
                    value[i] = 1 + minima.least(rank[i - 1], rank[i])
                part = np.minimum(value[at:end], cap).astype(_kind(cap))
                lcp[done + at : done + end] = part
                minima.append(done + at, part)
                at = end
        ok, p = before(pos)
        later = t[p] > high
        ok, p = ok[later], p[later]
        queue.put(np.searchsorted(bounds, t[p]), np.column_stack((t[p], done + ok, p)))
        done += m
    return order[:done], None if lcp is None else lcp[:done]


def _direct_lcp(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix values of neighbours by comparing letters, up to ``cap``."""
    out = np.zeros(len(order), dtype=_kind(cap))
    live = np.arange(1, len(order))
    for k in range(cap):
        a, b = order[live] + k, order[live - 1] + k
        live = live[(np.maximum(a, b) < len(t))]
        a, b = order[live] + k, order[live - 1] + k
        live = live[t[a] == t[b]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _sorted(t: np.ndarray, cap: int, folder: str, block: int, memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint8)
    up = _ascending(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    flip = int(t.max()) - t

    def both(seeds: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray | None]:
        seed_lcp = _direct_lcp(t, seeds, cap) if cap else None
        down, down_lcp = _induce(t, seeds, seed_lcp, ~up, cap, folder, block, memory)
        is_down = ~up[down]
        falling = down[is_down][::-1]
        falling_lcp = None
        if cap:
            kept = down_lcp[is_down]
            same = np.concatenate(([False], t[down[is_down]][1:] == t[down[is_down]][:-1]))
            kept = np.where(same, kept, 0)
            falling_lcp = np.concatenate(([0], kept[1:][::-1])).astype(_kind(cap))
        rise, rise_lcp = _induce(flip, falling, falling_lcp, up & (np.arange(n) < n - 1), cap, folder, block, memory)
        order = np.concatenate(([n - 1], rise[::-1]))
        return order, None if not cap else np.concatenate(([0, 0], rise_lcp[1:][::-1])).astype(_kind(cap))[:n]

    # Name the stretches between these suffixes in their order, and sort the suffixes by their names.
    some, _ = both(lms[np.argsort(t[lms], kind="stable")], 0)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    some = some[is_lms[some]]
    end = np.append(lms[1:], n - 1)
    index = np.empty(n, dtype=np.int64)
    index[lms] = np.arange(len(lms))
    length = end[index[some]] - some
    new = np.ones(len(some), dtype=bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(live):
        a, b = some[live] + k, some[live - 1] + k
        ok = t[a] == t[b]
        live = live[ok]
        finished = length[live] == k
        new[live[finished]] = False
        live = live[~finished]
        k += 1
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(some):
        reduced = np.empty(len(lms), dtype=np.int64)
        reduced[index[some]] = name
        inner = os.path.join(folder, "r")
        os.makedirs(inner, exist_ok=True)
        order, _ = _sorted(reduced, 0, inner, block, memory)
        seeds = lms[order]
    else:
        seeds = some
    return both(seeds, cap)


def suffix_array(text: np.ndarray, cap: int = 50, block: int = BLOCK, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of a text of whole numbers >= 0 in order, and what each has in common with the one before, up to ``cap`` (at most LONGEST).

    ``memory`` is the number of tuples that a queue holds before it goes to disk. An empty text has no suffixes.
    """
    if not 0 <= cap <= LONGEST:
        raise ValueError(f"cap must be from 0 to {LONGEST}, not {cap}")
    if not len(text):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    folder = temp_dir()
    try:
        order, lcp = _sorted(np.append(np.asarray(text, dtype=np.int64) + 1, 0), cap, folder, block, memory)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    lcp = lcp.copy()
    if len(lcp) > 1:
        lcp[1] = 0
    return order[1:], lcp[1:]
