"""Changing tracks by shapes, rasters and graphs."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geometry import Points, crossing, edge_array, edges_of
from ..functions.tracks import track, from_micros, micros, nxt
from .simplify import by_tracks, whole_tracks

KEY = ("agent_id", "track_no", "track_id")


def imprint(points: DataFrame, shape: Points, name: str = "imprinted", closed: bool = True) -> DataFrame:
    """Adds a point wherever a track crosses an edge of a shape, its time by the share of the step. Of points at one
    time of a track the original stays."""
    seg = points.withColumns({"__nx": nxt("x"), "__ny": nxt("y"), "__t": micros(F.col("time")), "__nt": F.lead(micros(F.col("time"))).over(track())})

    def share(e):
        return crossing(F.col("x"), F.col("y"), F.col("__nx"), F.col("__ny"), e["x1"], e["y1"], e["x2"], e["y2"])[0]

    hits = F.filter(F.transform(edge_array(edges_of(shape, closed)), share), lambda s: s.isNotNull())
    cut = seg.where("__nx is not null").select(*KEY, "x", "y", "__nx", "__ny", "__t", "__nt", F.explode(hits).alias("__s"))
    new = cut.select(
        *KEY, from_micros(F.round(F.col("__t") + F.col("__s") * (F.col("__nt") - F.col("__t")))).alias("time"),
        (F.col("x") + F.col("__s") * (F.col("__nx") - F.col("x"))).alias("x"), (F.col("y") + F.col("__s") * (F.col("__ny") - F.col("y"))).alias("y"),
        F.lit(True).alias(name),
    )
    both = points.withColumn(name, F.lit(False)).unionByName(new, allowMissingColumns=True)
    w = track().partitionBy("agent_id", "track_no").orderBy("time", name, "tie", "x", "y")
    fresh = both.withColumn("__p", F.lag("time").over(w)).where("__p is null or __p <> time").drop("__p")
    return fresh.withColumn("seq", (F.row_number().over(track().partitionBy("agent_id", "track_no").orderBy("time")) - 1).cast("int"))


def route_through_raster(points: DataFrame, cost: np.ndarray, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Replaces what a track does inside a raster by least-cost paths between the cells where it enters and leaves.

    The cost grid goes to the executors once. Times on a path are spread evenly.
    """
    grid = np.asarray(cost, float)
    sent = points.sparkSession.sparkContext.broadcast(grid)
    (rows, cols), grid_size = grid.shape, grid.size

    def route(x, y, c, r, inside, t, between):
        """x, y and times of a track with its runs inside replaced."""
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        parts, at = [], 0
        for i, j in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
            path = between(*map(int, (r[i], c[i], r[j], c[j]))) if j > i else ()
            if len(path) > 1:
                px, py = path[:, 1], path[:, 0]
                parts += [(x[at:i], y[at:i], t[at:i]),
                          (np.concatenate([x[i : i + 1], x0 + px[1:-1] * dx, x[j : j + 1]]), np.concatenate([y[i : i + 1], y0 + py[1:-1] * dy, y[j : j + 1]]), np.linspace(t[i], t[j], len(path)).round().astype(np.int64))]
                at = j + 1
        parts.append((x[at:], y[at:], t[at:]))
        return [np.concatenate(v) for v in zip(*parts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a path depends on its two cells alone: a task keeps searches by where they start, and paths
        search = functools.lru_cache(maxsize=max(1, (1 << 18) // grid_size))(lambda *start: kernels.Paths(sent.value, start))

        @functools.lru_cache(maxsize=1 << 13)
        def between(*ends: int) -> np.ndarray:
            return np.array(search(*ends[:2]).to(ends[2:])).reshape(-1, 2)

        for pdf, edges in whole_tracks(batches):
            x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
            c, r = np.rint((x - x0) / dx).astype(int), np.rint((y - y0) / dy).astype(int)
            inside = (c >= 0) & (c < cols) & (r >= 0) & (r < rows)
            t = pdf["time"].to_numpy("datetime64[us]").astype(np.int64)
            found = [route(*(v[lo:hi] for v in (x, y, c, r, inside, t)), between) for lo, hi in zip(edges, edges[1:])]
            n = [len(f[0]) for f in found]
            seq = np.concatenate([np.arange(k) for k in n])
            out = pdf[list(KEY)].iloc[edges[:-1]].loc[lambda f: f.index.repeat(n)].reset_index(drop=True)
            xs, ys, ts = (np.concatenate(v) for v in zip(*found))
            yield out.assign(seq=seq.astype(np.int32), time=pd.to_datetime(ts, unit="us"), x=xs, y=ys, tie=seq)

    base = points.select(*KEY, "seq", "time", "x", "y", "tie")
    return by_tracks(base).mapInPandas(run, base.schema)


def reduce_to_nodes(points: DataFrame, nodes: Sequence[tuple[int, float, float]], flow_col: str = "node", characteristic: str | None = None) -> DataFrame:
    """Puts points on the centres of their nodes (code, x, y); points of no node are dropped."""
    table = F.broadcast(points.sparkSession.createDataFrame([(int(c), float(x), float(y)) for c, x, y in nodes], "__c int, __x double, __y double"))
    out = points.where(F.col(characteristic)) if characteristic else points
    out = out.join(table, F.col(flow_col) == F.col("__c"))
    return out.withColumns({"x": F.col("__x"), "y": F.col("__y")}).drop("__c", "__x", "__y")
