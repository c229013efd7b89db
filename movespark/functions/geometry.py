"""Plane geometry as column expressions. Shapes are lists of (x, y) vertices on the driver, of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Points = Sequence[tuple[float, float]]
#: Distance from a boundary that still counts as on it.
ON = 1e-8


def edges_of(shape: Points, closed: bool = True) -> list[tuple[float, float, float, float]]:
    """Edges of a polygon (closed again if need be) or of a polyline."""
    pts = [(float(x), float(y)) for x, y in shape]
    if closed and pts[0] != pts[-1]:
        pts.append(pts[0])
    return [(*a, *b) for a, b in zip(pts, pts[1:])]


def edge_array(edges: Sequence[tuple[float, float, float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in edges])


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment, and the share of the segment at which it is reached."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return distance(px, py, x1 + t * dx, y1 + t * dy), t


def in_polygon(x: Column, y: Column, shape: Points) -> Column:
    """In or on the polygon's outer ring; null where a coordinate is null. The bounding box is tested first."""
    edges = edge_array(edges_of(shape))
    xs, ys = [float(p[0]) for p in shape], [float(p[1]) for p in shape]
    box = x.between(min(xs) - ON, max(xs) + ON) & y.between(min(ys) - ON, max(ys) + ON)

    def crosses(e: Column) -> Column:
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    def on(e: Column) -> Column:
        return segment_distance(x, y, e["x1"], e["y1"], e["x2"], e["y2"])[0] <= ON

    return box & ((F.size(F.filter(edges, crosses)) % 2 == 1) | F.exists(edges, on))


def shares(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Shares of a-b and of c-d at which the lines through them cross; null if they are parallel."""
    det = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    t = F.try_divide((ax - cx) * (cy - dy) - (ay - cy) * (cx - dx), det)
    u = F.try_divide((ax - cx) * (ay - by) - (ay - cy) * (ax - bx), det)
    return t, u


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Shares t of a-b and u of c-d at which the segments cross, ends included; null if they don't or are parallel."""
    t, u = shares(ax, ay, bx, by, cx, cy, dx, dy)
    hit = t.between(0.0, 1.0) & u.between(0.0, 1.0)
    return F.when(hit, t), F.when(hit, u)


def meets(ax: Column, ay: Column, bx: Column, by: Column, edges: Sequence[tuple[float, float, float, float]]) -> Column:
    """Whether a segment crosses or touches any of the edges."""
    def hit(e: Column) -> Column:
        return crossing(ax, ay, bx, by, e["x1"], e["y1"], e["x2"], e["y2"])[0].isNotNull()

    return F.coalesce(F.exists(edge_array(edges), hit), F.lit(False))


def wkt_line(points: Column) -> Column:
    """LINESTRING text of an array of structs with x and y."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
