"""Analyses by zones: time in polygons, flow maps, lateral distributions, nearest nodes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import Points, in_polygon
from ..functions.tracks import track, micros, nxt, step_back
from .classify import runs


def time_in_polygon(points: DataFrame, shape: Points, columns: Sequence[str] = ()) -> DataFrame:
    """A row for each stay of two or more points: first and last values, how long it is and how far it goes."""
    marked = points.withColumns({"__in": F.coalesce(in_polygon(F.col("x"), F.col("y"), shape), F.lit(False)), "__dr": step_back()})
    marked = runs(marked, "__in").where("__in")
    first = F.row_number().over(track().partitionBy("agent_id", "track_no", "__run").orderBy("seq")) == 1
    marked = marked.withColumn("__dr", F.when(first, F.lit(0.0)).otherwise(F.col("__dr")))
    ends = [f(c, "seq").alias(f"{c}_{k}") for k, f in enumerate((F.min_by, F.max_by)) for c in ("time", "x", "y", *columns)]
    out = marked.groupBy("agent_id", "track_no", "track_id", "__run").agg(F.count("*").alias("npoints"), *ends, F.sum("__dr").alias("distance_travelled"))
    return out.where("npoints >= 2").withColumn("duration", (micros(F.col("time_1")) - micros(F.col("time_0"))) / F.lit(1e6)).drop("__run", "track_no")


def flow_map(points: DataFrame, nodes: Sequence[tuple[int, float, float]], flow_col: str = "node", characteristic: str | None = None) -> DataFrame:
    """Rows (start, end, volume, track_ids, length, direction) of moves between nodes (code, x, y). A track that never leaves
    its node counts as a move to itself; points of no node (0) are passed over."""
    spark = points.sparkSession
    on = points.where(F.col(characteristic)) if characteristic else points
    w = W.partitionBy("agent_id", "track_no").orderBy("seq")
    on = on.where(F.col(flow_col) > 0).withColumn("__p", F.lag(flow_col).over(w)).where(f"__p is null or __p <> {flow_col}")
    moves = on.select("track_id", F.col(flow_col).alias("start"), F.lead(flow_col).over(w).alias("end"), F.count("*").over(W.partitionBy("agent_id", "track_no")).alias("__n"))
    moves = moves.withColumn("end", F.when(F.col("__n") == 1, F.col("start")).otherwise(F.col("end"))).where("end is not null")
    flows = moves.groupBy("start", "end").agg(F.count("*").alias("volume"), F.array_sort(F.collect_set("track_id")).alias("track_ids"))
    at = spark.createDataFrame([(int(c), float(x), float(y)) for c, x, y in nodes], "code int, x double, y double")
    for k, c in ((0, "start"), (1, "end")):
        flows = flows.join(F.broadcast(at.select(F.col("code").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))), c)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return flows.withColumns({"length": F.sqrt(dx * dx + dy * dy), "direction": F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))}).drop("x0", "y0", "x1", "y1")


def nearest_node(points: DataFrame, nodes: Sequence[tuple[int, float, float]], name: str = "node") -> DataFrame:
    """The node whose centre is nearest, the smaller code among equals: the Voronoi cell that holds a point.

    Nodes stand in the plan as an array, so no join is made.
    """
    table = F.array(*[F.struct(((F.col("x") - float(x)) ** 2 + (F.col("y") - float(y)) ** 2).alias("d"), F.lit(int(c)).alias("c")) for c, x, y in nodes])
    return points.withColumn(name, F.array_min(table)["c"])


def voronoi_cells(nodes: Sequence[tuple[int, float, float]], margin: float = 500_000.0) -> dict[int, list[tuple[float, float]]]:
    """The polygon of places nearest to each node (code, x, y), inside a square that reaches `margin` beyond the nodes.

    The square is cut by the line halfway to each other node. Of nodes in one place only the smallest code has a cell.
    """
    xs, ys = [n[1] for n in nodes], [n[2] for n in nodes]
    x0, x1, y0, y1 = min(xs) - margin, max(xs) + margin, min(ys) - margin, max(ys) + margin
    out: dict[int, list[tuple[float, float]]] = {}
    for code, x, y in sorted(nodes):
        cell = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        for other, a, b in nodes:
            if (a, b) == (x, y):
                cell = [] if other < code else cell
                continue
            # positive on the node's side
            side = lambda p: (x - a) * (2 * p[0] - a - x) + (y - b) * (2 * p[1] - b - y)  # noqa: B023, E731
            kept: list[tuple[float, float]] = []
            for p, q in zip(cell, cell[1:] + cell[:1]):
                u, v = side(p), side(q)
                if u >= 0:
                    kept.append(p)
                if (u > 0 > v) or (u < 0 < v):
                    t = u / (u - v)
                    kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            cell = kept
        if cell:
            out[code] = cell
    return out


def lateral_points(points: DataFrame, start: tuple[float, float], end: tuple[float, float], spacing: float = 100, n_slices: int = 0, polygon: Points | None = None) -> DataFrame:
    """Where tracks cross sections at right angles to an axis: (longitudinal, lateral, direction, x, y, track).

    Lateral offsets are negative to the left of the axis. direction is F for crossings along it, T for those against it.
    A step makes its own crossings from the range of sections it spans.
    """
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = math.hypot(dx, dy)
    ux, uy = dx / length, dy / length
    if n_slices == 1:
        at = [0.0]
    elif n_slices > 1:
        at = [length * k / (n_slices - 1) for k in range(n_slices)]
    else:
        at = [spacing * k for k in range(math.ceil(length / spacing))] + [length]
    along = lambda x, y: (x - start[0]) * ux + (y - start[1]) * uy
    side = lambda x, y: (x - start[0]) * uy - (y - start[1]) * ux
    seg = points.withColumns({"__nx": nxt("x"), "__ny": nxt("y")}).where("__nx is not null")
    seg = seg.withColumns({"__a": along(F.col("x"), F.col("y")), "__b": along(F.col("__nx"), F.col("__ny")), "__l": side(F.col("x"), F.col("y")), "__m": side(F.col("__nx"), F.col("__ny"))}).where("__a <> __b")
    # a crossing belongs to the step that leaves the section, so that one at a shared point counts once
    hit = lambda s: ((F.col("__a") <= s) & (s < F.col("__b"))) | ((F.col("__a") >= s) & (s > F.col("__b")))
    cut = seg.withColumn("longitudinal", F.explode(F.filter(F.array(*[F.lit(float(v)) for v in at]), hit)))
    s = (F.col("longitudinal") - F.col("__a")) / (F.col("__b") - F.col("__a"))
    out = cut.select(
        "agent_id", "track_id", "seq", "longitudinal", F.round(F.col("__l") + s * (F.col("__m") - F.col("__l")), 8).alias("lateral"),
        F.when(F.col("__b") > F.col("__a"), F.lit("F")).otherwise(F.lit("T")).alias("direction"),
        F.round(F.col("x") + s * (F.col("__nx") - F.col("x")), 8).alias("x"), F.round(F.col("y") + s * (F.col("__ny") - F.col("y")), 8).alias("y"),
    )
    return out.where(in_polygon(F.col("x"), F.col("y"), polygon)) if polygon else out


def lateral_distribution(crossings: DataFrame, width: float = 100, split: bool = True, density: bool = True) -> DataFrame:
    """Counts of crossings by section, direction and bin of lateral offset; the bins are aligned at 0."""
    key = ["longitudinal", "direction"] if split else ["longitudinal"]
    out = crossings.groupBy(*key, F.floor(F.col("lateral") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("frequency", F.col("n") / F.sum("n").over(W.partitionBy(*key)) if density else F.col("n").cast("double"))
