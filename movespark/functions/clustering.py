"""Clustering of one agent's points, with scores."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np

#: As many points are held with a matrix of all pairs.
DENSE = 1024


def seeds(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k centres, spread out; the first ones are those of a smaller k."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    d = np.full(len(x), np.inf)
    while len(centres) < k:
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
        p = d / d.sum() if d.sum() > 0 else None
        centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
    return centres


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, centres: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Labels and inertia of Lloyd's algorithm from spread-out seeds."""
    centres = seeds(x, k, seed) if centres is None else centres
    labels = None
    for _ in range(rounds):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        new = d.argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels, n = new, np.bincount(new, minlength=k)
        sums = np.stack([np.bincount(labels, v, k) for v in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return labels, float(((x - centres[labels]) ** 2).sum())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    ids = np.unique(labels)
    if len(ids) < 2:
        return float("inf")
    c = np.array([x[labels == i].mean(0) for i in ids])
    s = np.array([np.sqrt(((x[labels == i] - c[k]) ** 2).sum(1)).mean() for k, i in enumerate(ids)])
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    with np.errstate(divide="ignore"):
        return float(((s[:, None] + s[None]) / d).max(1).mean())


def silhouette(x: np.ndarray, labels: np.ndarray, block: int = 1024) -> float:
    """The mean silhouette; distances are made for a block of points at a time."""
    ids = np.unique(labels)
    if len(ids) < 2:
        return -1.0
    size, own, square = np.array([(labels == i).sum() for i in ids]), np.searchsorted(ids, labels), (x * x).sum(1)
    member = (own[:, None] == np.arange(len(ids))).astype(float)
    values = np.empty(len(x))
    for lo in range(0, len(x), block):
        part = slice(lo, lo + block)
        d = np.sqrt(np.maximum(square[part, None] + square[None] - 2 * x[part] @ x.T, 0))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = 0
        total, mine, at = d @ member, own[part], np.arange(len(d))
        a = total[at, mine] / np.maximum(size[mine] - 1, 1)
        other = total / size
        other[at, mine] = np.inf
        b = other.min(1)
        values[part] = np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(values.mean())


def knee(ks: Sequence[int], values: Sequence[float]) -> int:
    """The position farthest below the line between the curve's ends."""
    if len(ks) < 3:
        return 0
    x = (np.array(ks, float) - ks[0]) / (ks[-1] - ks[0])
    y = np.array(values, float)
    y = (y - y[-1]) / max(y[0] - y[-1], 1e-300)
    return int((1 - x - y).argmax())


def best_kmeans(x: np.ndarray, ks: Sequence[int], optimal: str, seed: int, scores: Sequence[str] = ("davies-bouldin", "silhouette")) -> tuple[np.ndarray, list[tuple]]:
    """Labels for the best number of clusters, and (k, inertia, davies-bouldin, silhouette) for each that points allow; scores not asked for are NaN."""
    usable = [k for k in ks if 1 < k <= len(x)]
    if not usable:
        return np.zeros(len(x), int), []
    first = seeds(x, max(usable), seed)
    tried = [kmeans(x, k, centres=first[:k]) for k in usable]
    score = lambda name, f, lab: f(x, lab) if name in scores else float("nan")
    rows = [(k, e, score("davies-bouldin", davies_bouldin, lab), score("silhouette", silhouette, lab)) for k, (lab, e) in zip(usable, tried)]
    at = {"davies-bouldin": lambda: int(np.argmin([r[2] for r in rows])), "silhouette": lambda: int(np.argmax([r[3] for r in rows])), "knee": lambda: knee(usable, [r[1] for r in rows])}[optimal]()
    return tried[at][0], rows


def _neighbours(x: np.ndarray, eps: float):
    """A function that tells the points within eps of one, from the cells of a grid around it."""
    side = eps if eps > 0 else 1.0
    cells = np.floor(x / side).astype(np.int64)
    held: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, cells.tolist())):
        held.setdefault(c, []).append(i)
    members = {c: np.array(v) for c, v in held.items()}
    steps = list(itertools.product((-1, 0, 1), repeat=x.shape[1]))

    def near(i: int) -> np.ndarray:
        c = cells[i].tolist()
        found = [members[k] for s in steps if (k := tuple(a + b for a, b in zip(c, s))) in members]
        at = np.sort(np.concatenate(found))
        return at[((x[at] - x[i]) ** 2).sum(1) <= eps * eps]

    return near


def _dense(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """As dbscan(), from the matrix of all pairs; -1 is noise."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    labels, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] < 0:
            front = np.array([i])
            labels[i] = k
            while len(front):
                # points that are no core join the first cluster that reaches them and lead no further
                reached = np.flatnonzero(near[front].any(0) & (labels < 0))
                labels[reached] = k
                front = reached[core[reached]]
            k += 1
    return labels


def dbscan(x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels from 0 in the order of the points; noise, if any, is 0 and clusters then begin at 1. Neighbours of many points are looked up, not kept."""
    if len(x) <= DENSE:
        labels = _dense(x, eps, min_samples)
        return labels + 1 if (labels < 0).any() else labels
    near = _neighbours(x, eps)
    core = np.array([len(near(i)) >= min_samples for i in range(len(x))], bool)
    labels, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] < 0 and core[i]:
            labels[i], front = k, [i]
            while front:
                for j in near(front.pop()):
                    if labels[j] < 0:
                        labels[j] = k
                        if core[j]:
                            front.append(int(j))
            k += 1
    return labels + 1 if (labels < 0).any() else labels
