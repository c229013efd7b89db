"""The data set: points, agents and what is known of them, with an operator for each method. Nothing runs before an action."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, edit, export, features, ingest, mapping, meta, pairs, resample, simplify, split, zones
from .sources import files


@dataclass(frozen=True)
class Dataset:
    """Raw rows until group_points(), then points by agent and, after a split, by track. Every method gives a new data set."""

    points: DataFrame | None = None
    agents: DataFrame | None = None
    raw: DataFrame | None = None
    crs: int = 4326
    units: Mapping[str, str] = field(default_factory=dict)

    # ------------------------------------------------ plumbing

    def copy(self) -> Dataset:
        return replace(self)

    def _on(self, operator: Callable[..., DataFrame], *args: Any, agents: Sequence[str] | None = None, tracks: Sequence[str] | None = None, **options: Any) -> Dataset:
        """Applies an operator to all points, or to those of some agents or tracks beside the others."""
        if agents is None and tracks is None:
            return replace(self, points=operator(self.points, *args, **options))
        chosen = F.col("agent_id").isin(list(agents)) if agents is not None else F.col("track_id").isin(list(tracks))
        changed = operator(self.points.where(chosen), *args, **options)
        return replace(self, points=self.points.where(~chosen).unionByName(changed, allowMissingColumns=True))

    @property
    def tracks(self) -> DataFrame:
        return meta.track_meta(self.points)

    @property
    def agent_table(self) -> DataFrame:
        return meta.agent_meta(self.points, self.agents)

    @property
    def fields(self) -> DataFrame:
        return meta.dataset_meta(self.points, self.agents)

    def refresh_meta(self) -> Dataset:
        """Metadata are plans over the points, so they are never stale."""
        return self

    def check_meta(self) -> bool:
        return self.points is not None

    def write(self, path: str, mode: str = "errorifexists") -> None:
        files.write_points(self.points, f"{path}/points", mode=mode)
        if self.agents is not None:
            self.agents.write.mode(mode).parquet(f"{path}/agents")

    # ------------------------------------------------ ingestion and splits

    def group_points(self, **options: Any) -> Dataset:
        points, agents = ingest.group_points(self.raw, **options)
        return replace(self, points=points, agents=agents)

    def split_tracks_spatiotemporal(self, time: float = 43200, distance: float = 0.5, tracks: Sequence[str] | None = None) -> Dataset:
        return replace(self, points=split.spatiotemporal(self.points, time, distance, tracks))

    def split_tracks_by_data(self, data_col: str = "Status", within: bool = False) -> Dataset:
        return replace(self, points=split.by_data(self.points, data_col, within))

    def split_overlapping_tracks_spatiotemporal(self, time: float = 43200, distance: float = 0.5) -> Dataset:
        return replace(self, points=split.overlapping(self.points, time, distance))

    def split_tracks_kmeans(self, n_clusters: Sequence[int] = range(2, 10), feature_cols: Sequence[str] = ("x", "y"), optimal_method: str = "davies-bouldin", return_error: bool = False) -> Any:
        out = replace(self, points=split.kmeans(self.points, n_clusters, feature_cols, optimal_method))
        return (out, split.kmeans_errors(self.points, n_clusters, feature_cols)) if return_error else out

    def split_tracks_dbscan(self, feature_cols: Sequence[str] = ("x", "y"), eps: float = 0.5, min_samples: int = 2) -> Dataset:
        return replace(self, points=split.dbscan(self.points, feature_cols, eps, min_samples))

    def repair_tracks_spatiotemporal(self, time: float, distance: float) -> Dataset:
        return replace(self, points=split.repair(self.points, self.tracks, time, distance))

    def remove_agents(self, agents: Sequence[str] | None = None) -> Dataset:
        return replace(self, points=split.remove_agents(self.points, agents))

    def remove_tracks(self, tracks: Sequence[str]) -> Dataset:
        return replace(self, points=split.remove_tracks(self.points, tracks))

    def get_track_splits(self) -> DataFrame:
        return split.track_gaps(self.tracks)

    # ------------------------------------------------ mapping

    def make_meta_mapper(self, meta_cols: Sequence[str]) -> dict[str, DataFrame]:
        return {c: mapping.values_of(self.agents, c) for c in meta_cols}

    def make_data_mapper(self, data_cols: Sequence[str]) -> dict[str, DataFrame]:
        return {c: mapping.values_of(self.points, c) for c in data_cols}

    def map_meta(self, mappers: Mapping[str, Mapping], out: Mapping[str, str] | None = None, drop: bool = False, fill: Any = None) -> Dataset:
        return replace(self, agents=mapping.map_columns(self.agents, mappers, out, drop, fill))

    def map_data(self, mappers: Mapping[str, Mapping], out: Mapping[str, str] | None = None, drop: bool = False, fill: Any = None) -> Dataset:
        return replace(self, points=mapping.map_columns(self.points, mappers, out, drop, fill))

    def map_data_to_codes(self, data_col: str, mapper: Mapping[Any, int], drop: bool = False, fill: int = -1) -> Dataset:
        return replace(self, points=mapping.map_to_codes(self.points, data_col, mapper, drop, fill))

    def drop_meta(self, meta_cols: Sequence[str]) -> Dataset:
        return replace(self, agents=mapping.drop_columns(self.agents, meta_cols))

    def drop_data(self, data_cols: Sequence[str]) -> Dataset:
        return replace(self, points=mapping.drop_columns(self.points, data_cols))

    # ------------------------------------------------ access

    def get_agent(self, agent: str) -> DataFrame:
        return self.points.where(F.col("agent_id") == agent)

    def get_agents(self, agents: Sequence[str]) -> DataFrame:
        return self.points.where(F.col("agent_id").isin(list(agents)))

    def get_track(self, track: str) -> DataFrame:
        return export.get_tracks(self.points, [track])

    def get_tracks(self, tracks: Sequence[str]) -> DataFrame:
        return export.get_tracks(self.points, list(tracks))

    def to_df(self, code: int | None = None) -> DataFrame:
        return export.to_table(self.points, self.agents, code)

    def to_gdf(self, code: int | None = None, segments: bool = False, method: str = "middle") -> DataFrame:
        return export.to_segments(self.points, method, code=code) if segments else export.to_lines(self.points, code)

    def map_agents(self, function: Callable, schema: Any) -> DataFrame:
        """Any function of an agent's points as a pandas frame; an agent must fit in a task's memory."""
        return self.points.groupBy("agent_id").applyInPandas(function, schema)

    to_dask_bag = map_agents

    def map_tracks(self, function: Callable, schema: Any) -> DataFrame:
        return self.points.groupBy("agent_id", "track_no").applyInPandas(function, schema)

    # ------------------------------------------------ geometry and features

    def reproject_crs(self, crs: int) -> Dataset:
        unit = "degrees" if crs == 4326 else "metres"
        return replace(self, points=resample.reproject(self.points, self.crs, crs), crs=crs, units={**self.units, "x": unit, "y": unit})

    def compute_coursing(self, method: str = "middle", data_col: str = "coursing", **options: Any) -> Dataset:
        return replace(self._on(features.coursing, method, data_col, self.crs == 4326, **options), units={**self.units, data_col: "degrees"})

    def compute_speed(self, method: str = "middle", data_col: str = "speed", **options: Any) -> Dataset:
        return replace(self._on(features.speed, method, data_col, **options), units={**self.units, data_col: f"{self.units.get('x', 'units')} / s"})

    def _plain(operator: Callable[..., DataFrame]) -> Callable[..., Dataset]:  # noqa: N805
        def method(self: Dataset, *args: Any, **options: Any) -> Dataset:
            return self._on(operator, *args, **options)

        method.__doc__ = operator.__doc__
        return method

    def _table(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:  # noqa: N805
        def method(self: Dataset, *args: Any, **options: Any) -> DataFrame:
            return operator(self.points, *args, **options)

        method.__doc__ = operator.__doc__
        return method

    def _pairs(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:  # noqa: N805
        def method(self: Dataset, *args: Any, tracks0: Sequence[str] | None = None, tracks1: Sequence[str] | None = None, meta_cols: Sequence[str] = (), **options: Any) -> DataFrame:
            """tracks0 and tracks1 choose the tracks of either side (one of them: those among themselves); meta_cols are static columns to add."""
            sides = [self.points if t is None else export.get_tracks(self.points, list(t)) for t in (tracks0, tracks1)]
            if tracks1 is not None:
                options.setdefault("others", sides[1])
            found = operator(sides[0], *args, **options)
            if tracks1 is not None:
                found = found.where("track_id_0 <> track_id_1")
            if operator is pairs.encounters:
                found = pairs.with_circles(found)
            return pairs.with_static(found, self.agents, meta_cols) if meta_cols else found

        method.__doc__ = f"{operator.__doc__}\n\n    {method.__doc__}"
        return method

    resample_spacing, resample_time, resample_time_global = _plain(resample.spacing), _plain(resample.time), _plain(resample.on_axis)
    smooth_corners = _plain(resample.smooth_corners)
    compute_turning_rate, compute_acceleration, compute_timestep = _plain(features.turning_rate), _plain(features.acceleration), _plain(features.timestep)
    compute_distance_travelled, compute_radius_of_curvature = _plain(features.distance_travelled), _plain(features.radius_of_curvature)
    compute_sinuosity, interpolate_raster = _plain(features.sinuosity), _plain(features.sample_raster)
    decimate_tracks, characteristic_tracks, simplify_stops = _plain(simplify.decimate), _plain(simplify.characteristic), _plain(simplify.simplify_stops)
    imprint_geometry, route_through_raster, reduce_to_flow_map = _plain(edit.imprint), _plain(edit.route_through_raster), _plain(edit.reduce_to_nodes)
    classify_in_polygon, classify_in_polygons, classify_toward_point = _plain(classify.polygon), _plain(classify.polygons), _plain(classify.toward)
    classify_speed, classify_turns, classify_speed_in_polygon = _plain(classify.speed), _plain(classify.turns), _plain(classify.speed_in_polygon)
    classify_trip, classify_touching, classify_stops, classify_custom = _plain(classify.trip), _plain(classify.touching), _plain(classify.stops), _plain(classify.custom)
    assign_nearest_node = _plain(zones.nearest_node)
    encounters, intersections, proximities = _pairs(pairs.encounters), _pairs(pairs.intersections), _pairs(pairs.proximities)
    proximity_to_object = _table(pairs.proximity_to_object)
    proximities_binned, proximities_relative = _table(pairs.proximities_binned), _table(pairs.proximities_relative)
    time_in_polygon, lateral_points, generate_flow_map = _table(zones.time_in_polygon), _table(zones.lateral_points), _table(zones.flow_map)
    rasterize = _table(export.rasterize)

    def lateral_distribution(self, start: tuple[float, float], end: tuple[float, float], bins: float = 100, split: bool = True, density: bool = True, **options: Any) -> DataFrame:
        return zones.lateral_distribution(zones.lateral_points(self.points, start, end, **options), bins, split, density)

    del _plain, _table, _pairs


def read(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", crs: int = 4326) -> Dataset:
    return Dataset(raw=files.read_any(spark, paths, sep), crs=crs)


def open_dataset(spark: SparkSession, path: str, agents: Sequence[str] | None = None, crs: int = 4326) -> Dataset:
    """A data set that write() wrote."""
    return Dataset(points=files.read_points(spark, f"{path}/points", agents), crs=crs)


def from_df(rows: DataFrame, crs: int = 4326) -> Dataset:
    return Dataset(raw=rows, crs=crs)


def from_lines(lines: DataFrame, vertices: str = "vertices", identifier: str = "identifier", crs: int = 4326) -> Dataset:
    return Dataset(points=ingest.points_of_lines(lines, vertices, identifier), crs=crs)
