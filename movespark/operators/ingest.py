"""From raw rows to points by agent: clipping, renaming, parsing, dropping what is incomplete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Points, in_polygon
from .mapping import lookup, rename
from .meta import agent_static_mode


def clip_to_box(rows: DataFrame, box: tuple[float, float, float, float], mapper: Mapping[str, str] | None = None, keep: Sequence[str] | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows inside a box (xmin, ymin, xmax, ymax), its edges included."""
    out = rename(rows, mapper or {})
    out = out.where(F.col(x).cast("double").between(box[0], box[2]) & F.col(y).cast("double").between(box[1], box[3]))
    return out.select(*keep) if keep else out


def clip_to_polygon(rows: DataFrame, shape: Points, mapper: Mapping[str, str] | None = None, keep: Sequence[str] | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """Rows in or on a polygon; its box is a plain range test that reaches the scan."""
    xs, ys = [p[0] for p in shape], [p[1] for p in shape]
    out = clip_to_box(rows, (min(xs), min(ys), max(xs), max(ys)), mapper, None, x, y)
    out = out.where(in_polygon(F.col(x).cast("double"), F.col(y).cast("double"), shape))
    return out.select(*keep) if keep else out


def group_points(rows: DataFrame, mapper: Mapping[str, str] | None = None, groupby: str | Sequence[str] = "Unique_ID", static: Sequence[str] = (), dynamic: Sequence[str] = (),
                 data_mappers: Mapping[str, Mapping] | None = None, prefix: str = "agent", time_format: str | None = None, tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points (agent_id, time, x, y, tie, dynamic columns) and agents (agent_id, static columns) of raw rows.

    Rows whose time, x or y is missing or can't be read are dropped. Values of dynamic columns go through their mappers,
    unmapped ones as they are. A static column has its most frequent value by agent. Without a tie column, rows of
    one agent and time are told apart by a hash of what they hold.
    """
    df = rename(rows, mapper or {})
    for c, m in (data_mappers or {}).items():
        if c in df.columns and c in dynamic:
            df = df.withColumn(c, lookup(F.col(c), m, F.col(c)))
    keys = [groupby] if isinstance(groupby, str) else list(groupby)
    df = df.dropna(subset=keys)
    time = F.col("Time") if dict(df.dtypes)["Time"].startswith("timestamp") else F.try_to_timestamp("Time", F.lit(time_format)) if time_format else F.try_to_timestamp("Time")
    order = F.col(tie).cast("long") if tie else F.xxhash64(*sorted(df.columns))
    picked = df.select(
        F.concat(F.lit(prefix), F.concat_ws("_", *[F.col(k).cast("string") for k in keys])).alias("agent_id"), time.cast("timestamp_ntz").alias("time"),
        F.col("X").try_cast("double").alias("x"), F.col("Y").try_cast("double").alias("y"), order.alias("tie"), *[c for c in dict.fromkeys([*static, *dynamic]) if c in df.columns and c not in ("Time", "X", "Y")],
    )
    whole = picked.dropna(subset=["agent_id", "time", "x", "y"])
    agents = agent_static_mode(whole, [c for c in static if c in whole.columns])
    return whole.drop(*[c for c in static if c not in dynamic]), agents


def points_of_lines(lines: DataFrame, vertices: str = "vertices", identifier: str = "identifier", prefix: str = "agent") -> DataFrame:
    """Points of rows with an array of (x, y) structs; times are spread over one second from the epoch."""
    out = lines.select(F.concat(F.lit(prefix), F.col(identifier).cast("string")).alias("agent_id"), F.size(vertices).alias("__n"), F.posexplode(vertices).alias("tie", "p"))
    us = F.floor(F.coalesce(F.try_divide(F.col("tie") * F.lit(1e6), F.col("__n") - 1), F.lit(0.0))).cast("long")
    return out.select("agent_id", F.timestamp_micros(us).cast("timestamp_ntz").alias("time"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), F.col("tie").cast("long").alias("tie"))
