"""Columns derived from the steps of a track. All windows share one partitioning and order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geometry import distance
from ..functions.tracks import track, whole, by_method, micros, nxt, prev, seconds, step_back


def _steps(points: DataFrame, forward: Column, backward: Column, method: str, name: str) -> DataFrame:
    return points.withColumn(name, by_method(forward, backward, method))


def coursing(points: DataFrame, method: str = "middle", name: str = "coursing", geographic: bool = False, circular: bool = False) -> DataFrame:
    """Direction of travel in degrees from north, clockwise. The mean of two is not circular unless asked for.

    Geographic positions take WGS84 azimuths, in Arrow batches on the two columns' pairs.
    """
    if geographic:

        @F.pandas_udf("double")
        def azimuth(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(kernels.geodesic_azimuth(a, b, c, d)).where((a.notna() & c.notna()).to_numpy())

        points = points.withColumns({"__nx": nxt("x"), "__ny": nxt("y")}).withColumn("__f", azimuth("x", "y", "__nx", "__ny"))
    else:
        points = points.withColumn("__f", F.when(nxt("x").isNotNull(), F.degrees(F.atan2(nxt("x") - F.col("x"), nxt("y") - F.col("y")))))
    f, b = F.coalesce("__f", prev("__f")), F.coalesce(prev("__f"), F.col("__f"))
    value = {"forward": f, "backward": b, "middle": (f + b) / 2}[method]
    if circular and method == "middle":
        r = F.radians
        value = F.degrees(F.atan2(F.sin(r(f)) + F.sin(r(b)), F.cos(r(f)) + F.cos(r(b))))
    return points.withColumn(name, F.pmod(value, F.lit(360.0))).drop("__f", "__nx", "__ny")


def turning_rate(points: DataFrame, direction: str = "coursing", method: str = "middle", name: str = "turning_rate", circular: bool = False) -> DataFrame:
    """Change of direction in degrees a second; not wrapped at 360 unless asked for."""
    wrap = (lambda d: F.pmod(d + 180, F.lit(360.0)) - 180) if circular else (lambda d: d)
    f = F.try_divide(wrap(nxt(direction) - F.col(direction)), seconds(F.col("time"), nxt("time")))
    b = F.try_divide(wrap(F.col(direction) - prev(direction)), seconds(prev("time"), F.col("time")))
    return _steps(points, f, b, method, name)


def speed(points: DataFrame, method: str = "middle", name: str = "speed") -> DataFrame:
    f = F.try_divide(distance(F.col("x"), F.col("y"), nxt("x"), nxt("y")), seconds(F.col("time"), nxt("time")))
    return _steps(points, f, F.try_divide(step_back(), seconds(prev("time"), F.col("time"))), method, name)


def acceleration(points: DataFrame, method: str = "middle", name: str = "acceleration", speed_col: str = "speed") -> DataFrame:
    f = F.try_divide(nxt(speed_col) - F.col(speed_col), seconds(F.col("time"), nxt("time")))
    b = F.try_divide(F.col(speed_col) - prev(speed_col), seconds(prev("time"), F.col("time")))
    return _steps(points, f, b, method, name)


def timestep(points: DataFrame, method: str = "backward", name: str = "timestep") -> DataFrame:
    """Seconds from the point before, or to the next; null at the end that has none."""
    return points.withColumn(name, seconds(prev("time"), F.col("time")) if method == "backward" else seconds(F.col("time"), nxt("time")))


def distance_travelled(points: DataFrame, relative: bool = False, name: str = "distance_travelled") -> DataFrame:
    run = points.withColumn("__dr", F.coalesce(step_back(), F.lit(0.0))).withColumn(name, F.sum("__dr").over(track().rowsBetween(-(2**63), 0))).drop("__dr")
    return run.withColumn(name, F.try_divide(F.col(name), F.max(name).over(whole()))) if relative else run


def radius_of_curvature(points: DataFrame, name: str = "radius_of_curvature") -> DataFrame:
    """Radius of the circle through a point and its neighbours; infinite on a line, null at a track's ends."""
    a, b, c = step_back(), distance(F.col("x"), F.col("y"), nxt("x"), nxt("y")), distance(prev("x"), prev("y"), nxt("x"), nxt("y"))
    cross = (F.col("x") - prev("x")) * (nxt("y") - prev("y")) - (F.col("y") - prev("y")) * (nxt("x") - prev("x"))
    flat = F.abs(cross) <= 1e-12 * F.greatest(F.lit(1.0), a * c)
    return points.withColumn(name, F.when(a.isNotNull() & b.isNotNull(), F.when(flat, F.lit(float("inf"))).otherwise(F.try_divide(a * b * c, 2 * F.abs(cross)))))


def sinuosity(points: DataFrame, window: int = 3, name: str = "sinuosity") -> DataFrame:
    """Path over chord in a centred window of an odd number of points; null where it doesn't fit or the chord is 0."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 3")
    h = window // 2
    steps = points.withColumn("__dr", step_back())
    path = F.sum("__dr").over(track().rowsBetween(-h + 1, h))
    chord = distance(prev("x", h), prev("y", h), nxt("x", h), nxt("y", h))
    return steps.withColumn(name, F.try_divide(F.when(chord.isNotNull(), path), F.when(chord > 0, chord))).drop("__dr")


def sample_raster(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float, name: str = "sample", method: str = "linear") -> DataFrame:
    """Values of a raster (row, col, value), whose cell (0, 0) has its centre at (x0, y0), at the points; null outside."""
    fx, fy = (F.col("x") - x0) / dx, (F.col("y") - y0) / dy
    r = raster.select("row", "col", "value")
    if method == "nearest":
        cell = points.withColumns({"__c": F.floor(fx + 0.5).cast("int"), "__r": F.floor(fy + 0.5).cast("int")})
        return cell.join(r, (cell["__r"] == r["row"]) & (cell["__c"] == r["col"]), "left").drop("__r", "__c", "row", "col").withColumnRenamed("value", name)
    near = r
    for right, down, key in ((1, 0, "v01"), (0, 1, "v10"), (1, 1, "v11")):
        other = r.select((F.col("row") - down).alias("row"), (F.col("col") - right).alias("col"), F.col("value").alias(key))
        near = near.join(other, ["row", "col"], "left")
    last = raster.agg(F.max("row"), F.max("col")).collect()[0]
    # a point on the last row or column belongs to the cell before it
    cell = points.withColumns({"__fx": fx, "__fy": fy}).withColumns({
        "__c": F.when(F.col("__fx") == last[1], last[1] - 1).otherwise(F.floor("__fx")).cast("int"),
        "__r": F.when(F.col("__fy") == last[0], last[0] - 1).otherwise(F.floor("__fy")).cast("int"),
    })
    both = cell.join(near, (cell["__r"] == near["row"]) & (cell["__c"] == near["col"]), "left")
    u, v = F.col("__fx") - F.col("__c"), F.col("__fy") - F.col("__r")
    value = (1 - u) * (1 - v) * F.col("value") + u * (1 - v) * F.col("v01") + (1 - u) * v * F.col("v10") + u * v * F.col("v11")
    return both.select(*[points[c] for c in points.columns], value.alias(name))
