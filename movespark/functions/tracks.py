"""Windows, times and steps that the operators on tracks share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .geometry import distance


def track() -> WindowSpec:
    """A track's points in order."""
    return W.partitionBy("agent_id", "track_no").orderBy("seq")


def whole() -> WindowSpec:
    """All points of a track. The exchange by agent that a split makes serves this and track() too."""
    return W.partitionBy("agent_id", "track_no")


def agent() -> WindowSpec:
    """An agent's points in order."""
    return W.partitionBy("agent_id").orderBy("time", "tie")



def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def prev(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(track())


def nxt(c: str, n: int = 1) -> Column:
    return F.lead(c, n).over(track())


def step_back() -> Column:
    """Length of the step that arrives at a point; null at a track's first."""
    return distance(prev("x"), prev("y"), F.col("x"), F.col("y"))


def by_method(forward: Column, backward: Column, method: str) -> Column:
    """The step that leaves, the one that arrives, or the mean of both; ends take the one there is."""
    f, b = F.coalesce(forward, backward), F.coalesce(backward, forward)
    return {"forward": f, "backward": b, "middle": (f + b) / 2}[method]
