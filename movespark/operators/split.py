"""Splitting agents' points into tracks, and removing agents and tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clustering, kernels
from ..functions.geometry import distance
from ..functions.tracks import agent, micros, seconds
from .simplify import whole_tracks

_IDS = ("track_no", "track_id", "seq")


def numbered(points: DataFrame, fresh: Column) -> DataFrame:
    """Tracks from a flag that is true where a new one begins, in the order of an agent's points."""
    out = points.drop(*_IDS).withColumn("track_no", (F.sum(F.coalesce(fresh, F.lit(False)).cast("int")).over(agent().rowsBetween(-(2**63), 0))).cast("int"))
    return with_ids(out)


def with_ids(points: DataFrame) -> DataFrame:
    """track_id and seq from agent_id and track_no."""
    order = agent().partitionBy("agent_id", "track_no").orderBy("time", "tie")
    return points.withColumns({"track_id": F.concat("agent_id", F.lit("_T"), F.col("track_no").cast("string")), "seq": (F.row_number().over(order) - 1).cast("int")})


def dedupe_times(points: DataFrame) -> DataFrame:
    """One point for each agent and time: that of the lowest tie. Needs no exchange but by agent."""
    return points.withColumn("__p", F.lag("time").over(agent())).where("not (time <=> __p) or __p is null").drop("__p")




def spatiotemporal(points: DataFrame, time: float = 43200, dist: float = 0.5, tracks: Sequence[str] | None = None) -> DataFrame:
    """A new track where the gap in time or in distance to the point before exceeds its bound. With tracks,
    those of an agent are pooled and split again, and its other tracks are numbered after them."""
    if tracks is not None:
        chosen = F.col("track_id").isin(list(tracks))
        again = spatiotemporal(points.where(chosen), time, dist)
        last = again.groupBy("agent_id").agg((F.max("track_no") + 1).alias("__n"))
        rest = points.where(~chosen)
        order = rest.groupBy("agent_id", "track_no").agg(F.first("track_id").alias("__t"))
        rank = F.row_number().over(agent().partitionBy("agent_id").orderBy("track_no")) - 1
        renumbered = order.withColumn("__k", rank).join(last, "agent_id", "left")
        renumbered = renumbered.select("agent_id", "track_no", (F.col("__k") + F.coalesce("__n", F.lit(0))).cast("int").alias("__new"))
        rest = rest.join(renumbered, ["agent_id", "track_no"]).withColumn("track_no", F.col("__new")).drop("__new")
        return again.unionByName(with_ids(rest))
    points = dedupe_times(points)
    gap = seconds(F.lag("time").over(agent()), F.col("time"))
    far = distance(F.lag("x").over(agent()), F.lag("y").over(agent()), F.col("x"), F.col("y"))
    return numbered(points, (gap > time) | (far > dist))


def by_data(points: DataFrame, column: str, within: bool = False) -> DataFrame:
    """A new track at each change of a column; nulls are equal. within keeps the boundaries there are."""
    change = ~F.col(column).eqNullSafe(F.lag(column).over(agent()))
    if within:
        change = change | (F.col("track_no") != F.lag("track_no").over(agent()))
    return numbered(points, change & F.lag("time").over(agent()).isNotNull())


def _assign(points: DataFrame, label) -> DataFrame:
    """Applies label(frame) -> track numbers to each agent's points. Agents are dealt by hash and sorted; a task holds a batch and the agent that goes on."""
    base = points.drop(*_IDS)
    schema = T.StructType([*base.schema.fields, T.StructField("track_no", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_tracks(batches, ("agent_id",)):
            yield pdf.assign(track_no=np.concatenate([np.asarray(label(pdf.iloc[lo:hi]), np.int32) for lo, hi in zip(edges, edges[1:])]))

    return with_ids(base.repartition("agent_id").sortWithinPartitions("agent_id", "time", "tie").mapInPandas(run, schema))


def overlapping(points: DataFrame, time: float, dist: float) -> DataFrame:
    """Each point joins the first open track whose last point is near enough in time and place, or opens one.

    Greedy and sequential, so an agent is a group: it must fit in a task's memory.
    """
    return _assign(points, lambda pdf: kernels.greedy_tracks(kernels.secs(pdf["time"]), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), time, dist))


def _features(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    parts = []
    for c in columns:
        v = pdf[c]
        if np.issubdtype(v.dtype, np.datetime64):
            parts.append(kernels.secs(v)[:, None])
        elif v.dtype == object or v.dtype == bool:
            parts.append(pd.get_dummies(v).to_numpy(float))
        else:
            parts.append(v.to_numpy(float)[:, None])
    x = np.concatenate(parts, 1)
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd == 0, 1, sd)


def kmeans(points: DataFrame, clusters: Sequence[int] = range(2, 10), columns: Sequence[str] = ("x", "y"), optimal: str = "davies-bouldin", seed: int = 0) -> DataFrame:
    """Clusters of each agent's points in scaled features as tracks; their number is the best by a score."""
    return _assign(points.dropna(subset=list(columns)), lambda pdf: clustering.best_kmeans(_features(pdf, columns), clusters, optimal, seed, scores=(optimal,))[0])


def kmeans_errors(points: DataFrame, clusters: Sequence[int] = range(2, 10), columns: Sequence[str] = ("x", "y"), seed: int = 0) -> DataFrame:
    """Rows (agent_id, n_clusters, inertia, davies_bouldin, silhouette)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = clustering.best_kmeans(_features(pdf, columns), clusters, "davies-bouldin", seed)[1]
        return pd.DataFrame([(pdf["agent_id"].iloc[0], *r) for r in rows], columns=["agent_id", "n_clusters", "inertia", "davies_bouldin", "silhouette"])

    return points.dropna(subset=list(columns)).groupBy("agent_id").applyInPandas(run, "agent_id string, n_clusters int, inertia double, davies_bouldin double, silhouette double")


def dbscan(points: DataFrame, columns: Sequence[str] = ("x", "y"), eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Density clusters of each agent's points in scaled features as tracks, noise, where there is any, first."""
    return _assign(points.dropna(subset=list(columns)), lambda pdf: clustering.dbscan(_features(pdf, columns), eps, min_samples))


def repair(points: DataFrame, tracks: DataFrame, time: float, dist: float) -> DataFrame:
    """Joins tracks of an agent whose end and start lie near each other in time and place.

    Chains are found on track metadata alone, one small group for each agent, and renumber the points by a join.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_no")
        new = kernels.repair_chains(kernels.secs(pdf["start_time"]), kernels.secs(pdf["end_time"]), pdf[["xstart", "ystart", "xend", "yend"]].to_numpy(float), time, dist)
        return pdf[["agent_id", "track_no"]].assign(new_no=np.asarray(new, np.int32))

    ends = tracks.select("agent_id", "track_no", "start_time", "end_time", "xstart", "ystart", "xend", "yend")
    chains = ends.groupBy("agent_id").applyInPandas(run, "agent_id string, track_no int, new_no int")
    out = points.join(chains, ["agent_id", "track_no"]).withColumn("track_no", F.col("new_no")).drop("new_no", "track_id", "seq")
    return with_ids(out)


def track_gaps(tracks: DataFrame) -> DataFrame:
    """Between consecutive tracks of an agent: time, distance and speed from the end of one to the start of the next."""
    w = agent().partitionBy("agent_id").orderBy("track_no")
    out = tracks.select(
        "agent_id", F.col("track_id").alias("track_id_0"), F.lead("track_id").over(w).alias("track_id_1"),
        ((micros(F.lead("start_time").over(w)) - micros(F.col("end_time"))) / 1e6).alias("time_difference"),
        distance(F.col("xend"), F.col("yend"), F.lead("xstart").over(w), F.lead("ystart").over(w)).alias("distance"),
    )
    return out.where("track_id_1 is not null").withColumns({"speed": F.try_divide("distance", "time_difference"), "connect": F.lit(False)})


def remove_agents(points: DataFrame, agents: Sequence[str] | None = None) -> DataFrame:
    return points.where(F.lit(False)) if agents is None else points.where(~F.col("agent_id").isin(list(agents)))


def remove_tracks(points: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """Without these tracks; the others keep their numbers."""
    return points.where(~F.col("track_id").isin(list(tracks)))
