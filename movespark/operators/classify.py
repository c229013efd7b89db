"""Boolean columns code<n> on points: where they are, how fast, how long, and what their track does."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import Points, edges_of, in_polygon, meets
from ..functions.tracks import track, whole, micros, nxt, prev


def ends_() -> WindowSpec:
    """All points of a track in order, for its first and last."""
    return track().rowsBetween(-(2**63), 2**63 - 1)


def polygon(points: DataFrame, shape: Points, code: int = 16) -> DataFrame:
    return points.withColumn(f"code{code}", F.coalesce(in_polygon(F.col("x"), F.col("y"), shape), F.lit(False)))


def polygons(points: DataFrame, shapes: Sequence[tuple[int, Points]], to_codes: bool = False, name: str = "polygon") -> DataFrame:
    """The code of the first polygon that holds a point, 0 if none does; with to_codes also a column for each."""
    inside = {c: F.coalesce(in_polygon(F.col("x"), F.col("y"), s), F.lit(False)) for c, s in shapes}
    first = F.lit(0)
    for c, _ in reversed(list(shapes)):
        first = F.when(inside[c], c).otherwise(first)
    return points.withColumns({name: first} | ({f"code{c}": v for c, v in inside.items()} if to_codes else {}))


def toward(points: DataFrame, target: tuple[float, float], code: int = 16) -> DataFrame:
    """Whole tracks that end nearer to the target than they start."""
    d = (F.col("x") - target[0]) ** 2 + (F.col("y") - target[1]) ** 2
    return points.withColumn("__d", d).withColumn(f"code{code}", F.first("__d").over(ends_()) > F.last("__d").over(ends_())).drop("__d")


def speed(points: DataFrame, bound: float, higher: bool = True, lower: bool = False, code: int = 17, speed_col: str = "speed") -> DataFrame:
    test = F.col(speed_col) <= bound if lower or not higher else F.col(speed_col) >= bound
    return points.withColumn(f"code{code}", F.coalesce(test, F.lit(False)))


def turns(points: DataFrame, rate: float, code: int = 18) -> DataFrame:
    return points.withColumn(f"code{code}", F.coalesce(F.abs("turning_rate") >= rate, F.lit(False)))


def speed_in_polygon(points: DataFrame, bound: float, shape: Points, higher: bool = True, lower: bool = False, code: int = 19) -> DataFrame:
    both = polygon(speed(points, bound, higher, lower, -1), shape, -2)
    return both.withColumn(f"code{code}", F.col("code-1") & F.col("code-2")).drop("code-1", "code-2")


def trip(points: DataFrame, one: Points, other: Points, code: int = 20) -> DataFrame:
    """Whole tracks with one end in each polygon, either way round."""
    at = {k: (f("x").over(ends_()), f("y").over(ends_())) for k, f in (("a", F.first), ("z", F.last))}
    ends = points.withColumns({f"__{k}{c}": v for k, xy in at.items() for c, v in zip("xy", xy)})
    inside = {(k, n): F.coalesce(in_polygon(F.col(f"__{k}x"), F.col(f"__{k}y"), s), F.lit(False)) for k in "az" for n, s in ((1, one), (2, other))}
    hit = (inside["a", 1] & inside["z", 2]) | (inside["a", 2] & inside["z", 1])
    return ends.withColumn(f"code{code}", hit).drop("__ax", "__ay", "__zx", "__zy")


def touching(points: DataFrame, shape: Points, segments: bool = False, code: int = 21, closed: bool = True) -> DataFrame:
    """Whole tracks that meet a shape, or both ends of each segment that does. A polygon's inside counts."""
    hit = meets(F.col("x"), F.col("y"), nxt("x"), nxt("y"), edges_of(shape, closed))
    if closed:
        hit = hit | in_polygon(F.col("x"), F.col("y"), shape) | in_polygon(nxt("x"), nxt("y"), shape)
    out = points.withColumn("__h", F.coalesce(hit & nxt("x").isNotNull(), F.lit(False)))
    value = F.col("__h") | F.coalesce(prev("__h"), F.lit(False)) if segments else F.max("__h").over(whole())
    return out.withColumn(f"code{code}", value).drop("__h")


def runs(points: DataFrame, flag: str) -> DataFrame:
    """Adds __run, which numbers maximal runs of equal flags in a track; null flags break runs."""
    change = (F.coalesce(F.col(flag), F.lit(False)) != F.coalesce(prev(flag), F.lit(False))).cast("int")
    return points.withColumn("__c", change).withColumn("__run", F.sum("__c").over(track().rowsBetween(-(2**63), 0))).drop("__c")


def stops(points: DataFrame, threshold: float = 0.15, least: float = 1800, code: int = 22, speed_col: str = "speed") -> DataFrame:
    """Maximal runs of two or more points no faster than the threshold that last long enough."""
    slow = runs(points.withColumn("__s", F.coalesce(F.col(speed_col) <= threshold, F.lit(False))), "__s")
    w = whole().partitionBy("agent_id", "track_no", "__run")
    long_ = (F.max(micros(F.col("time"))).over(w) - F.min(micros(F.col("time"))).over(w)) / F.lit(1e6) >= least
    return slow.withColumn(f"code{code}", F.col("__s") & (F.count("*").over(w) >= 2) & long_).drop("__s", "__run")


def custom(points: DataFrame, values: Mapping[str, bool] | DataFrame, code: int = 23) -> DataFrame:
    """A boolean by track id put on the points of the tracks listed; others get null."""
    table = values if isinstance(values, DataFrame) else points.sparkSession.createDataFrame(list(values.items()), "track_id string, value boolean")
    return points.join(table.withColumnRenamed("value", f"code{code}"), "track_id", "left")


def of_tracks(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """The points of the tracks in a table: a semi-join."""
    return points.join(tracks.select("track_id"), "track_id", "left_semi")
