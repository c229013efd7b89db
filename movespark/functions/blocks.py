"""Pairs of tracks from two blocks, in NumPy: what would be a row for each pair and time is held for a slab of pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs of tracks whose state is held at once.
PAIRS = 1 << 18


class Block:
    """Points (t, x, y) of tracks 0..n-1, in the order of their times. Points of a track at one time are in layers 0, 1, ..."""

    def __init__(self, own: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray, n: int):
        order = np.lexsort((own, t))
        own, t, self.n = own[order], t[order], n
        self.x, self.y = x[order], y[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (t[1:] != t[:-1])
        layer = np.arange(len(t)) - np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
        if layer.any():
            order = np.lexsort((own, layer, t))
            own, t, self.x, self.y, layer = own[order], t[order], self.x[order], self.y[order], layer[order]
        self.own, self.t = own, t
        edge = np.ones(len(t), bool)
        edge[1:] = (t[1:] != t[:-1]) | (layer[1:] != layer[:-1])
        lo = np.flatnonzero(edge)
        #: (time, first row, row after the last) of each layer of each time
        self.rows: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(t)]):
            self.rows.setdefault(int(t[a]), []).append((a, b))


def steps(a: Block, b: Block | None) -> Iterator[tuple[int, int, Iterator[tuple]]]:
    """For slabs lo..hi of a's tracks an iterator over (time, places in the slab's matrix of pairs, rows of a, rows of b, distances).

    Without b the tracks of a meet one another, and only pairs above the diagonal count.
    """
    other = a if b is None else b
    times = sorted(a.rows.keys() & other.rows.keys())
    high = max(1, PAIRS // max(other.n, 1))

    def of(lo: int, hi: int):
        for t in times:
            for p, q in a.rows[t]:
                p, q = (p + np.searchsorted(a.own[p:q], (lo, hi))).tolist()
                if p == q:
                    continue
                for r, s in other.rows[t]:
                    own = other.own[r:s]
                    at = ((a.own[p:q] - lo) * other.n)[:, None] + own
                    d = np.sqrt((other.x[r:s] - a.x[p:q, None]) ** 2 + (other.y[r:s] - a.y[p:q, None]) ** 2)
                    i, j = np.broadcast_arrays(np.arange(p, q)[:, None], np.arange(r, s))
                    if b is None:
                        above = own > a.own[p:q, None]
                        yield t, at[above], i[above], j[above], d[above]
                    else:
                        yield t, at.ravel(), i.ravel(), j.ravel(), d.ravel()

    for lo in range(0, a.n, high):
        hi = min(a.n, lo + high)
        yield lo, hi, of(lo, hi)


def nearest(a: Block, b: Block | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Tracks of a and of b that share a time, how many they share, and the rows of a and b at the first of least distance, -1 without one."""
    wide = (a if b is None else b).n
    for lo, hi, met in steps(a, b):
        size = (hi - lo) * wide
        n, best, rows = np.zeros(size, np.int64), np.full(size, np.inf), np.full((2, size), -1, np.int64)
        for _t, at, i, j, d in met:
            n[at] += 1
            less = d < best[at]
            at = at[less]
            best[at], rows[0, at], rows[1, at] = d[less], i[less], j[less]
        some = np.flatnonzero(n)
        yield some // wide + lo, some % wide, n[some], np.where(rows[0, some] < 0, np.nan, best[some]), rows[0, some], rows[1, some]


def _inside(met, size: int, bins: Sequence[float], compat: bool) -> Iterator[tuple]:
    """(when each step begins, places, bin's number, seconds inside) for steps between successive common times; undefined seconds are NaN."""
    last, when = np.full(size, np.nan), np.full(size, np.iinfo(np.int64).min)
    for t, at, _i, _j, d1 in met:
        d0, since = last[at], when[at]
        last[at], when[at] = d1, t
        on = (since != np.iinfo(np.int64).min) & ~np.isnan(d1)
        if not on.all():
            at, d0, d1, since = at[on], d0[on], d1[on], since[on]
        if not len(at):
            continue
        took = (t - since) / 1e6
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, bound in enumerate(bins):
                was, is_ = d0 <= bound, d1 <= bound
                entry = (bound - d0) / (d1 - d0) if compat else (bound - d1) / (d0 - d1)
                share = np.where(was, np.where(is_, 1.0, (bound - d0) / (d1 - d0)), np.where(is_, entry, 0.0))
                yield since, at, k, took * share


def binned(a: Block, b: Block | None, bins: Sequence[float], compat: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Tracks of a and of b with a step in common, and for each bin the seconds inside, NaN if there are none defined."""
    wide = (a if b is None else b).n
    for lo, hi, met in steps(a, b):
        size = (hi - lo) * wide
        total, some, known = np.zeros((len(bins), size)), np.zeros(size, bool), np.zeros((len(bins), size), bool)
        for _since, at, k, inside in _inside(met, size, bins, compat):
            some[at] = True
            bad = np.isnan(inside)
            if bad.any():
                at, inside = at[~bad], inside[~bad]
            total[k, at] += inside
            known[k, at] = True
        on = np.flatnonzero(some)
        yield on // wide + lo, on % wide, np.where(known[:, on], total[:, on], np.nan)


def longest(a: Block, b: Block | None, bins: Sequence[float]) -> dict[int, np.ndarray]:
    """For each time at which a step begins the most seconds inside each bin, NaN if there are none defined."""
    wide, out = (a if b is None else b).n, {}
    for lo, hi, met in steps(a, b):
        for since, _at, k, inside in _inside(met, (hi - lo) * wide, bins, False):
            # most steps begin at one time; the others are met by time
            for t in [since[0]] if (since == since[0]).all() else np.unique(since):
                part = inside if since[0] == t and len(since) == np.count_nonzero(since == t) else inside[since == t]
                best = out.setdefault(int(t), np.full(len(bins), np.nan))
                best[k] = np.fmax(best[k], np.fmax.reduce(part))
    return out


def near(a: Sequence[np.ndarray], b: Sequence[np.ndarray], dist: float, time: float, width: float, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b, and distances, of the nearest point of each track of b to each point of a, within dist and time.

    Sides are arrays (group, x, y, time, track, seq, from, to, bucket). Points meet in their group, those of tracks whose spans overlap, in
    the first bucket of both, and if `ordered` where a's track is the lower. Pairs are made for a few points of a at a time.
    """
    if not len(a[0]) or not len(b[0]):
        return
    low, high = min(a[1].min(), b[1].min()), max(a[1].max(), b[1].max())
    # groups one after the other on a line, and x within them
    step = high - low + 4 * dist
    line = lambda s: s[0] * step + (s[1] - low)
    order = np.argsort(line(b), kind="stable")
    b = [v[order] for v in b]
    on, at = line(b), line(a)
    reach = dist * (1 + 1e-9) + 1e-15 * max(abs(on[-1]), abs(at.max()), 1.0)
    lo, hi = np.searchsorted(on, at - reach), np.searchsorted(on, at + reach, "right")
    total = np.cumsum(hi - lo)
    first, tracks = 0, int(max(a[4].max(), b[4].max())) + 1
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + 4 * PAIRS, "right")))
        n = hi[first:last] - lo[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = np.arange(len(i)) + np.repeat(lo[first:last] - (np.cumsum(n) - n), n)
        first = last
        d = np.sqrt((b[1][j] - a[1][i]) ** 2 + (b[2][j] - a[2][i]) ** 2)
        some = np.flatnonzero(d <= dist)
        i, j, d = i[some], j[some], d[some]
        on_ = (a[0][i] == b[0][j]) & (a[6][i] <= b[7][j]) & (b[6][j] <= a[7][i])
        if ordered:
            on_ &= a[4][i] < b[4][j]
        on_ &= np.floor(np.maximum(a[6][i], b[6][j]) / width) == a[8][i]
        i, j, d = i[on_], j[on_], d[on_]
        # tracks none of whose points is near in time give nothing, whichever is nearest
        pair, soon = i * tracks + b[4][j], np.abs(a[3][i] - b[3][j]) <= time
        some = np.flatnonzero(np.isin(pair, pair[soon]))
        i, j, d, pair = i[some], j[some], d[some], pair[some]
        sorted_ = np.lexsort((b[5][j], d, pair))
        i, j, d, pair = i[sorted_], j[sorted_], d[sorted_], pair[sorted_]
        best = np.ones(len(pair), bool)
        best[1:] = pair[1:] != pair[:-1]
        best &= np.abs(a[3][i] - b[3][j]) <= time
        if best.any():
            yield i[best], order[j[best]], d[best]
