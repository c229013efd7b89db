"""Sequential algorithms on one track or agent, in NumPy: what windows can't express."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd


def secs(t: pd.Series) -> np.ndarray:
    return t.to_numpy("datetime64[us]").astype(np.int64) / 1e6


def greedy_tracks(t: np.ndarray, x: np.ndarray, y: np.ndarray, time: float, dist: float) -> list[int]:
    tails: list[int] = []
    out = []
    for i in range(len(t)):
        for k, j in enumerate(tails):
            if t[i] - t[j] <= time and np.hypot(x[i] - x[j], y[i] - y[j]) <= dist:
                tails[k] = i
                out.append(k)
                break
        else:
            out.append(len(tails))
            tails.append(i)
    return out


def repair_chains(start: np.ndarray, end: np.ndarray, ends: np.ndarray, time: float, dist: float) -> list[int]:
    """New numbers: chains by their first track, then the tracks that are in none. A track follows one at most."""
    n, after, taken = len(start), {}, set()
    for i in range(n):
        for j in range(i + 1, n):
            near = np.hypot(ends[i, 2] - ends[j, 0], ends[i, 3] - ends[j, 1]) <= dist
            if j not in taken and near and abs(end[i] - start[j]) <= time:
                after[i] = j
                taken.add(j)
                break
    if not after:
        return list(range(n))
    new, k = [-1] * n, 0
    for i in sorted((i for i in after if i not in taken), key=lambda i: (start[i], i)):
        while i is not None:
            new[i] = k
            i = after.get(i)
        k += 1
    for i in range(n):
        if new[i] < 0:
            new[i], k = k, k + 1
    return new


def rdp(x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Positions that Ramer-Douglas-Peucker keeps, with an own stack instead of recursion."""
    n = len(x)
    if n < 2 or (n == 2 and x[0] == x[1] and y[0] == y[1]):
        return np.arange(n)
    keep, todo = np.zeros(n, bool), [(0, n - 1)]
    keep[[0, n - 1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py, length = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], np.hypot(dx, dy)
        # a closed piece has no line: distances from its end take that place
        far = np.abs(dx * py - dy * px) / length if length else np.hypot(px, py)
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def stops(speed: np.ndarray, t: np.ndarray, threshold: float, least: float, shortest: int = 2) -> list[tuple[int, int]]:
    """First and last positions of runs of points no faster than the threshold."""
    slow = np.concatenate([[False], np.nan_to_num(speed, nan=np.inf) <= threshold, [False]])
    edge = np.flatnonzero(slow[1:] != slow[:-1])
    return [(a, b - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a >= shortest and t[b - 1] - t[a] >= least]


def simplified_stops(x, y, t, speed, threshold: float, least: float, drift: float) -> np.ndarray:
    """Positions kept when a stop is reduced to its ends and to the points that begin a leg of drift.

    A leg is left at its first point that is `drift` or more away from where it began; the point after that begins the next.
    """
    drop: list[int] = []
    for first, last in stops(speed, t, threshold, least):
        origin, left = first, drift <= 0
        for p in range(first + 1, last):
            if left:
                origin, left = p, drift <= 0
            else:
                left = math.hypot(x[p] - x[origin], y[p] - y[origin]) >= drift
                drop.append(p)
    return np.delete(np.arange(len(x)), drop)


def characteristic(x, y, t, speed, course, slow: float, turn: float, shortest: float, longest: float, least: float) -> np.ndarray:
    """Positions of characteristic points: both ends, stops, and points of a walk from each of these to the next.

    A stop is marked at its first and last point, one of no more than `least` seconds at its last only. From a point i the walk
    goes to whichever of two comes first before the goal j: the last point within `longest` of i + 1 along the track, or the one
    as many places after i as there are points in i + 1..j whose course differs by less than `turn` from that at i + 1. The
    second is passed over if it is no more than `shortest` along the track from i + 1.
    """
    n = len(x)
    if n < 3:
        return np.arange(n)
    along = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    marked = stops(speed, t, slow, -np.inf, 1)
    begin = [0, *(b for _, b in marked)]
    goal = [*(a if t[b] - t[a] > least else b for a, b in marked), n - 1]
    keep = np.zeros(n, bool)
    keep[begin + goal] = True
    for i, j in zip(begin, goal):
        while i < j:
            far = min(i + int(np.searchsorted(along[i + 1 : j + 1], along[i + 1] + longest)), j)
            bent = i + int(np.count_nonzero(np.abs(course[i + 1 : j + 1] - course[i + 1]) < turn))
            i, old = bent if bent < far and along[max(bent, i + 1)] - along[i + 1] > shortest else far, i
            if i == old:
                break
            keep[i] = True
    return np.flatnonzero(keep)


class Paths:
    """Least-cost paths from a cell of a grid, eight neighbours, a diagonal step costing root two times as much.

    The search goes on from where it stopped when another end is asked for.
    """

    def __init__(self, cost: np.ndarray, start: tuple[int, int]):
        self.cost, self.start = cost, start
        self.best, self.back, self.heap = {start: 0.0}, {}, [(0.0, start)]
        self.done: set[tuple[int, int]] = set()

    def to(self, end: tuple[int, int]) -> list[tuple[int, int]]:
        cost, best, back, heap = self.cost, self.best, self.back, self.heap
        rows, cols = cost.shape
        while heap and end not in self.done:
            d, at = heapq.heappop(heap)
            if d > best[at]:
                continue
            self.done.add(at)
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    to = at[0] + dr, at[1] + dc
                    if (dr or dc) and 0 <= to[0] < rows and 0 <= to[1] < cols and np.isfinite(cost[to]) and cost[to] >= 0:
                        new = d + (cost[at] + cost[to]) / 2 * (2**0.5 if dr and dc else 1.0)
                        if new < best.get(to, np.inf):
                            best[to], back[to] = new, at
                            heapq.heappush(heap, (new, to))
        if end not in self.done:
            return []
        path = [end]
        while path[-1] != self.start:
            path.append(back[path[-1]])
        return path[::-1]


def cheapest_path(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Least-cost path between cells of a grid, as Paths finds it."""
    return Paths(cost, start).to(end)


def geodesic_azimuth(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Forward azimuths in degrees on WGS84 by Vincenty's inverse formula, on a sphere where that doesn't settle."""
    f = 1 / 298.257223563
    lon = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(np.asarray(v, float)))) for v in (lat1, lat2))
    lam = lon.copy()
    for _ in range(60):
        s, c = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(np.cos(u2) * s, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * c)
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * c
        with np.errstate(divide="ignore", invalid="ignore"):
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * s / sin_s, 0)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2, 0)
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = lon + (1 - k) * f * sin_a * (np.arctan2(sin_s, cos_s) + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
        if np.nanmax(np.abs(new - lam), initial=0) < 1e-12:
            lam = new
            break
        lam = np.where(np.abs(new) > np.pi, lon, new)
    s, c = np.sin(lam), np.cos(lam)
    return np.degrees(np.arctan2(np.cos(u2) * s, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * c))
