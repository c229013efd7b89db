"""Metadata of tracks, agents and the dataset, as aggregates over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..functions.tracks import micros, prev, step_back

POINT_COLUMNS = ("agent_id", "track_no", "track_id", "seq", "time", "x", "y", "tie")


def codes_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower().startswith("code") and c[4:].isdigit()]


def _rolled(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in codes_of(df)]


def track_meta(points: DataFrame) -> DataFrame:
    """A row for each track: size, length, times, extent, resolutions, sinuosity, and whether any point has a code."""
    dt = F.floor((micros(F.col("time")) - micros(prev("time"))) / F.lit(1e6))
    steps = points.withColumns({"__dr": step_back(), "__dt": dt})
    out = steps.groupBy("agent_id", "track_no").agg(
        F.first("track_id").alias("track_id"), F.count("*").alias("npoints"), F.coalesce(F.sum("__dr"), F.lit(0.0)).alias("track_length"),
        F.min("time").alias("start_time"), F.max("time").alias("end_time"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.min_by("x", "seq").alias("xstart"), F.min_by("y", "seq").alias("ystart"), F.max_by("x", "seq").alias("xend"), F.max_by("y", "seq").alias("yend"),
        *[F.coalesce(f(c), F.lit(0)).cast("double").alias(f"{n}_{name}_resolution") for c, name in (("__dt", "temporal"), ("__dr", "spatial")) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))],
        *_rolled(points),
    )
    out = out.withColumn("effective_distance", distance(F.col("xstart"), F.col("ystart"), F.col("xend"), F.col("yend")))
    return out.withColumns({
        "duration": F.floor((micros(F.col("end_time")) - micros(F.col("start_time"))) / F.lit(1e6)).cast("long"),
        "year": F.year("end_time"), "month": F.month("end_time"),
        "sinuosity": F.try_divide("track_length", F.when(F.col("effective_distance") > 0, F.col("effective_distance"))),
    })


def agent_meta(points: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """A row for each agent: number of points and tracks, extent, time span, codes; with its static columns."""
    out = points.groupBy("agent_id").agg(
        F.count("*").alias("npoints"), F.count_distinct("track_no").alias("ntracks"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), *_rolled(points),
    )
    return out if static is None else out.join(static, "agent_id", "left")


def dataset_meta(points: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Rows (kind, field): names of the static and dynamic fields, from the schemas."""
    own = [("static", c) for c in sorted(static.columns if static is not None else []) if c != "agent_id"]
    own += [("dynamic", c) for c in sorted(points.columns) if c not in ("agent_id", "track_no", "track_id", "seq", "tie")]
    return points.sparkSession.createDataFrame(own, "kind string, field string")


def agent_static_mode(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Static columns by agent: the most frequent value that isn't null, the lowest among equals."""
    if not columns:
        return rows.select("agent_id").distinct()
    return rows.groupBy("agent_id").agg(*[F.mode(c, True).alias(c) for c in columns])


def longest_tracks(tracks: DataFrame, k: int = 10) -> DataFrame:
    return tracks.orderBy(F.desc("track_length"), "track_id").limit(k)


def status_share(points: DataFrame, column: str) -> DataFrame:
    """How often an agent has each value, and its share of the agent's points."""
    n = points.groupBy("agent_id", column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("agent_id")))


def describe_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation, least, median and largest of a value by group, and for all."""
    return (
        rows.rollup(by).agg(
            F.grouping(by).alias("__all"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("largest"),
        ).withColumn(by, F.when(F.col("__all") == 1, F.lit("All")).otherwise(F.col(by))).drop("__all")
    )


def counts_by_month(rows: DataFrame, by: str, time: str) -> DataFrame:
    month = rows.withColumn("month", F.date_format(time, "yyyy-MM"))
    out = month.rollup("month", by).agg(F.grouping("month").alias("__m"), F.grouping(by).alias("__b"), F.count("*").alias("n"))
    return out.select(F.when(F.col("__m") == 1, F.lit("All")).otherwise(F.col("month")).alias("month"), F.when(F.col("__b") == 1, F.lit("All")).otherwise(F.col(by)).alias(by), "n")


def histogram_by(rows: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """Counts in bins of equal width by group, and their share of all values."""
    out = rows.where(F.col(value).isNotNull()).groupBy(by, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count(value)).collect()[0][0]
    return out.withColumn("share", F.col("n") / F.lit(float(max(1, total))))
