"""Splitting a stream of points into tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_sessions(points: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions by gaps in time alone: built-in windows, with a watermark."""
    w = points.withColumn("ts", F.col("time").cast("timestamp")).withWatermark("ts", late)
    out = w.groupBy("agent_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("npoints"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    return out.select("agent_id", F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"), "npoints", "xmin", "xmax")


def spatiotemporal(points: DataFrame, time: float, dist: float, late: str = "1 hour") -> DataFrame:
    """Track numbers by gaps in time or distance; an agent's last point and track number are its state.

    Points of a micro-batch are put in order; one that is earlier than the agent's last stays out, as late.
    """
    out = "agent_id string, track_no int, time timestamp, x double, y double, tie long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "tie"])
        last_t, last_x, last_y, no = state.get if state.exists else (None, 0.0, 0.0, 0)
        us = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
        rows = []
        for t, x, y, tie in zip(us.tolist(), pdf["x"], pdf["y"], pdf["tie"]):
            if last_t is not None and t <= last_t:
                continue
            if last_t is not None and ((t - last_t) / 1e6 > time or np.hypot(x - last_x, y - last_y) > dist):
                no += 1
            last_t, last_x, last_y = t, float(x), float(y)
            rows.append((key[0], no, pd.Timestamp(t, unit="us"), x, y, tie))
        state.update((last_t, last_x, last_y, no))
        yield pd.DataFrame(rows, columns=["agent_id", "track_no", "time", "x", "y", "tie"])

    w = points.select("agent_id", F.col("time").cast("timestamp").alias("ts"), "x", "y", "tie").withWatermark("ts", late)
    return w.groupBy("agent_id").applyInPandasWithState(step, out, "t long, x double, y double, no int", "append", GroupStateTimeout.NoTimeout)
