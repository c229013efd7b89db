"""Small tracks worked out by hand, properties, and sequential algorithms against plain loops."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from movespark import Dataset, from_df, from_lines
from movespark.functions import clustering, kernels
from movespark.operators import classify, export, features, mappers, mapping, meta, pairs, resample, simplify, split, zones
from movespark.sources import files
from movespark.plans.joins import interval_join, salted_join

T0 = dt.datetime(2024, 1, 1)


def track(spark, pts, agent="a"):
    rows = [(agent, T0 + dt.timedelta(seconds=t), float(x) if x is not None else None, float(y), i) for i, (t, x, y) in enumerate(pts)]
    p = spark.createDataFrame(rows, "agent_id string, time timestamp_ntz, x double, y double, tie long")
    return split.spatiotemporal(p, 1e9, 1e9)


def values(df, c):
    return [r[c] for r in df.orderBy("agent_id", "track_no", "seq").collect()]


def test_straight_line(spark):
    p = track(spark, [(0, 0, 0), (10, 3, 4), (20, 6, 8)])
    assert values(features.speed(p), "speed") == [0.5, 0.5, 0.5]
    assert values(features.radius_of_curvature(p), "radius_of_curvature") == [None, math.inf, None]
    assert values(features.sinuosity(p), "sinuosity") == [None, 1.0, None]
    m = meta.track_meta(p).collect()[0]
    assert (m.npoints, m.track_length, m.sinuosity, m.duration) == (3, 10.0, 1.0, 20)


def test_right_angle(spark):
    p = track(spark, [(0, 0, 0), (10, 10, 0), (20, 10, 10)])
    assert values(features.coursing(p, "forward"), "coursing") == [90.0, 0.0, 0.0]
    assert values(features.radius_of_curvature(p), "radius_of_curvature")[1] == pytest.approx(7.0710678)
    assert values(features.distance_travelled(p, True), "distance_travelled") == [0.0, 0.5, 1.0]


def test_single_and_twin_points(spark):
    one, two = track(spark, [(0, 1, 1)]), track(spark, [(0, 1, 1), (10, 1, 1)])
    assert values(features.speed(one), "speed") == [None]
    assert meta.track_meta(one).collect()[0].track_length == 0
    assert meta.track_meta(two).collect()[0].sinuosity is None
    assert resample.spacing(one, 1.0).count() == 1
    assert simplify.decimate(two, 1.0).count() == 2


def test_same_time_keeps_lowest_tie(spark):
    p = track(spark, [(0, 1, 1), (0, 9, 9), (5, 2, 2)])
    assert values(p, "x") == [1.0, 2.0]


def test_circular_mean(spark):
    p = track(spark, [(0, 0, 0), (1, math.sin(math.radians(170)), math.cos(math.radians(170))), (2, 0, 2 * math.cos(math.radians(170)))])
    assert values(features.coursing(p), "coursing")[1] == pytest.approx(0, abs=1e-6)
    assert values(features.coursing(p, circular=True), "coursing")[1] == pytest.approx(180)


def test_stops_need_two_points(spark):
    p = track(spark, [(0, 0, 0), (1000, 0, 0), (2000, 0, 0), (2001, 50, 0), (3000, 50, 0)]).withColumn("speed", classify.F.element_at(classify.F.array(*map(classify.F.lit, [0.0, 0.0, 0.0, 1.0, 0.0])), classify.F.col("seq") + 1))
    assert values(classify.stops(p, 0.1, 1800), "code22") == [True, True, True, False, False]


def test_approach_is_the_share_inside(spark):
    a = track(spark, [(0, 0, 0), (10, 0, 0)], "a")
    b = track(spark, [(0, 10, 0), (10, 0, 0)], "b")
    out = pairs.proximities_binned(a.unionByName(b), [4.0]).collect()
    assert out[0].seconds == pytest.approx(4.0)
    assert pairs.proximities_binned(a.unionByName(b), [4.0], compat=True).collect()[0].seconds == pytest.approx(6.0)


def test_crossing_tracks(spark):
    both = track(spark, [(0, 0, 0), (10, 10, 10)], "a").unionByName(track(spark, [(0, 0, 10), (10, 10, 0)], "b"))
    r = pairs.intersections(both).collect()
    assert [(round(x.x, 6), round(x.y, 6)) for x in r] == [(5.0, 5.0)]


def test_on_edge_is_inside(spark):
    p = track(spark, [(0, 0, 5), (1, 10, 10), (2, 11, 5)])
    assert values(classify.polygon(p, [(0, 0), (10, 0), (10, 10), (0, 10)]), "code16") == [True, True, False]


def test_empty_and_null(spark):
    p = track(spark, [(0, None, 1), (1, 2, 2)])
    assert values(classify.polygon(p, [(0, 0), (10, 0), (10, 10)]), "code16") == [False, True]
    assert features.speed(p.where("false")).count() == 0
    assert zones.time_in_polygon(p.where("false"), [(0, 0), (1, 0), (1, 1)]).count() == 0


@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=40), st.floats(0.1, 20))
@settings(max_examples=60, deadline=None)
def test_rdp_keeps_within_epsilon(pts, eps):
    x, y = np.array(pts).T
    keep = kernels.rdp(x, y, eps)
    assert keep[0] == 0 and keep[-1] == len(x) - 1
    for a, b in zip(keep, keep[1:]):
        d = np.hypot(x[b] - x[a], y[b] - y[a])
        for k in range(a + 1, b):
            far = abs((x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a])) / d if d else np.hypot(x[k] - x[a], y[k] - y[a])
            assert far <= eps + 1e-9


def test_chaikin_sizes_and_ends(spark):
    p = track(spark, [(0, 0, 0), (10, 10, 0), (20, 10, 10)])
    out = resample.smooth_corners(p, 2)
    assert out.count() == 12
    assert (values(out, "x")[0], values(out, "y")[-1]) == (0.0, 10.0)


def test_split_overlapping_against_loop(spark):
    rng = np.random.default_rng(1)
    pts = [(int(t), *rng.integers(0, 30, 2)) for t in range(0, 600, 10)]
    got = values(split.overlapping(track(spark, pts), 40, 8.0).withColumn("seq", split.F.col("tie").cast("int")).withColumn("track_no", split.F.lit(0)), "track_id")
    tails, want = [], []
    for t, x, y in pts:
        for k, (t2, x2, y2) in enumerate(tails):
            if t - t2 <= 40 and math.hypot(x - x2, y - y2) <= 8:
                break
        else:
            k = len(tails)
            tails.append(None)
        tails[k] = (t, x, y)
        want.append(f"a_T{k}")
    assert got == want


def test_repair_joins_each_successor_once():
    start, end = np.array([0.0, 10, 10]), np.array([5.0, 20, 20])
    ends = np.array([[0, 0, 1, 1], [1, 1, 2, 2], [1, 1, 3, 3]], float)
    assert kernels.repair_chains(start, end, ends, 10, 1) == [0, 0, 1]


def test_dbscan_and_kmeans_find_two_groups():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (20, 2)), np.random.default_rng(1).normal(5, 0.1, (20, 2))])
    assert len(set(clustering.dbscan(x, 1.0, 3))) == 2
    labels, rows = clustering.best_kmeans(x, range(2, 5), "silhouette", 0)
    assert len(set(labels)) == 2 and rows[0][0] == 2


def test_path_goes_round():
    cost = np.ones((5, 5))
    cost[0:4, 2] = np.inf
    path = kernels.cheapest_path(cost, (0, 0), (0, 4))
    assert path[0] == (0, 0) and path[-1] == (0, 4) and (4, 2) in path


def test_interval_join_counts_each_pair_once(spark):
    a = spark.createDataFrame([(0.0, 25.0, 1), (30.0, 31.0, 2)], "s double, e double, i int")
    b = spark.createDataFrame([(5.0, 40.0, 1), (26.0, 27.0, 2)], "s2 double, e2 double, j int")
    got = sorted((r.i, r.j) for r in interval_join(a, b, "s", "e", "s2", "e2", 10.0).collect())
    assert got == [(1, 1), (2, 1)]


def test_fluent_data_set(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "2024-01-01 00:00:00", "1.0", "2.0", "A"), ("v1", "2024-01-01 01:00:00", "1.1", "2.0", "A"), ("v1", "bad", "1.2", "2.0", "B"), ("v2", "2024-01-02 00:00:00", "5", None, "C")],
                                 "MMSI string, BaseDateTime string, LON string, LAT string, name string")
    ds = from_df(rows, crs=3857).group_points(mapper={"BaseDateTime": "Time", "LON": "X", "LAT": "Y"}, groupby="MMSI", static=["name"])
    ds = ds.split_tracks_spatiotemporal(7200, 1.0).compute_speed()
    assert [r.track_id for r in ds.tracks.collect()] == ["agentv1_T0"]
    assert ds.agents.collect()[0].name == "A"
    ds.write(str(tmp_path / "out"))
    from movespark.model import open_dataset

    assert open_dataset(spark, str(tmp_path / "out"), ["agentv1"]).points.count() == 2
    assert isinstance(ds.copy(), Dataset) and ds.reproject_crs(4326).crs == 4326


def test_lines_spread_one_second(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])], "identifier int, vertices array<struct<x:double,y:double>>")
    assert [r.time.microsecond for r in from_lines(lines).points.orderBy("tie").collect()] == [0, 500000, 0]


def test_mappers():
    assert mapping.column_mapper(["Base Date_Time", "lat", "foo"]) == {"Base Date_Time": "Time", "lat": "Y", "foo": None}
    with pytest.raises(TypeError):
        mapping.map_to_codes(None, "x", {"a": "b"})


def test_geodesic_azimuth_of_known_lines():
    assert kernels.geodesic_azimuth([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(90)
    assert kernels.geodesic_azimuth([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(0)


def test_streaming_split(spark, tmp_path):
    from movespark.streaming.sessions import spatiotemporal

    p = track(spark, [(0, 0, 0), (10, 1, 0), (5000, 1, 0), (5010, 900, 0)]).select("agent_id", "time", "x", "y", "tie")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = spatiotemporal(stream, 1000, 100).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.track_no for r in spark.table("tracks").orderBy("time").collect()] == [0, 0, 1, 2]


def test_raster_cells_are_closed(spark):
    def touched(pts):
        out = export.rasterize(track(spark, pts), 0.0, 0.0, 3, 3, 10.0, 10.0).collect()
        assert all(r.value == 1.0 for r in out)
        return {(r.row, r.col) for r in out}

    assert touched([(0, 0, 10), (1, 30, 10)]) == {(r, c) for r in (0, 1) for c in range(3)}  # along a border
    assert touched([(0, 10, 10)]) == {(0, 0), (0, 1), (1, 0), (1, 1)}  # one point on a corner
    assert touched([(0, 1, 1), (1, 9, 9)]) == {(0, 0)}
    assert touched([(0, 0, 0), (1, 30, 30)]) == {(r, c) for r in range(3) for c in range(3) if abs(r - c) <= 1}
    assert touched([(0, -5, 5), (1, -1, 5)]) == set()


@given(st.lists(st.tuples(st.floats(-5, 35), st.floats(-5, 35)), min_size=1, max_size=2))
@settings(max_examples=15, deadline=None)
def test_raster_against_samples_along_a_step(spark, pts):
    got = {(r.row, r.col) for r in export.rasterize(track(spark, [(k, *p) for k, p in enumerate(pts)]), 0.0, 0.0, 3, 3, 10.0, 10.0).collect()}
    (ax, ay), (bx, by) = pts[0], pts[-1]
    along = [(ax + s * (bx - ax), ay + s * (by - ay)) for s in np.linspace(0, 1, 401)]
    sure = {(int(y // 10), int(x // 10)) for x, y in along if 0 < x < 30 and 0 < y < 30}
    near = {(r, c) for r in range(3) for c in range(3) if any(c * 10 - 0.2 <= x <= c * 10 + 10.2 and r * 10 - 0.2 <= y <= r * 10 + 10.2 for x, y in along)}
    assert sure <= got <= near


def test_full_cells_are_salted(spark):
    a = spark.range(3000).selectExpr("id", "id % 3 as k").withColumn("x", split.F.lit(1))
    b = spark.range(40).selectExpr("id as other", "id % 4 as k")
    got = salted_join(a, b, ["k"], ["id"], split.F.col("id") % 7 < split.F.col("other"), full=100)
    assert sorted(got.columns) == ["id", "k", "other", "x"]
    want = sum(1 for i in range(3000) for o in range(40) if i % 3 == o % 4 and i % 7 < o)
    assert got.count() == want


@given(st.integers(0, 10_000))
@settings(max_examples=200, deadline=None)
def test_characteristic_points_against_the_prose(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    x, y = np.cumsum(rng.normal(size=(2, n)), 1)
    t, speed, course = np.cumsum(rng.integers(1, 50, n)).astype(float), rng.random(n), rng.random(n) * 360
    slow, turn, shortest, longest, least = 0.3, float(rng.choice([20.0, 90.0])), float(rng.choice([0, 0.5, 3.0])), float(rng.choice([0.5, 3.0, 8.0])), 30.0
    want, goals, starts = {0, n - 1} if n > 2 else set(range(n)), [], [0]
    p = 0
    while p < n:
        q = p
        while q < n and speed[q] <= slow:
            q += 1
        if q > p:
            goals.append(p if t[q - 1] - t[p] > least else q - 1)
            starts.append(q - 1)
        p = max(q, p + 1)
    goals.append(n - 1)
    if n > 2:
        want |= {*goals, *starts}
        for i, j in zip(starts, goals):
            while i < j:
                far, way = i + 1, 0.0
                while far < j and way + math.hypot(x[far + 1] - x[far], y[far + 1] - y[far]) < longest:
                    way += math.hypot(x[far + 1] - x[far], y[far + 1] - y[far])
                    far += 1
                bent = i + sum(abs(course[k] - course[i + 1]) < turn for k in range(i + 1, j + 1))
                length = sum(math.hypot(x[k + 1] - x[k], y[k + 1] - y[k]) for k in range(i + 1, bent))
                i = bent if bent < far and length > shortest else far
                want.add(i)
    assert sorted(want) == kernels.characteristic(x, y, t, speed, course, slow, turn, shortest, longest, least).tolist()


def test_a_stop_is_left_as_legs_of_drift():
    x, zero = np.array([0.0, 1, 2, 5, 5, 5, 9, 9, 50]), np.zeros(9)
    speed, t = np.array([0.0] * 8 + [9]), np.arange(9.0) * 1000
    assert kernels.simplified_stops(x, zero, t, speed, 0.1, 1800, 3.0).tolist() == [0, 4, 7, 8]
    assert kernels.simplified_stops(x, zero, t, speed, 0.1, 1800, 100.0).tolist() == [0, 7, 8]
    assert kernels.simplified_stops(x, zero, t, speed, 0.1, 90_000, 3.0).tolist() == list(range(9))


def test_tracks_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        both = track(spark, [(k, k, k % 2 * 5) for k in range(40)], "a").unionByName(track(spark, [(k, k, 0) for k in range(30)], "b"))
        out = simplify.decimate(both, 0.5).orderBy("agent_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.agent_id, r.seq, r.x) for r in out] == [("a", k, float(k)) for k in range(40)] + [("b", 0, 0.0), ("b", 1, 29.0)]


def test_dbscan_and_silhouette_against_loops():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(size=(rng.integers(1, 60), 2)) * 2
        eps, least = 0.6, int(rng.integers(1, 5))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = (d <= eps).sum(1) >= least
        want, k = [-1] * len(x), 0
        for i in range(len(x)):
            if want[i] < 0 and core[i]:
                front = [i]
                want[i] = k
                while front:
                    j = front.pop()
                    for m in range(len(x)):
                        if core[j] and d[j, m] <= eps and want[m] < 0:
                            want[m] = k
                            front.append(m)
                k += 1
        got = clustering.dbscan(x, eps, least)
        shift = 1 if -1 in want else 0
        assert [g - shift for g in got] == want
        labels = rng.integers(0, 3, len(x))
        if len(set(labels.tolist())) > 1:
            s = []
            for i in range(len(x)):
                mine = [d[i, j] for j in range(len(x)) if labels[j] == labels[i] and j != i]
                b = min(np.mean([d[i, j] for j in range(len(x)) if labels[j] == c]) for c in set(labels.tolist()) - {labels[i]})
                s.append((b - np.mean(mine)) / max(b, np.mean(mine)) if mine else 0.0)
            assert clustering.silhouette(x, labels, block=7) == pytest.approx(np.mean(s), abs=1e-6)


def test_vessel_codes_and_status(spark):
    assert [mappers.vessel_type(k) for k in (0, 29, 30, 49, 64, 150, 255, 999, 1000, 1024)] == [
        ("Not available or no ship, default", "Unknown"), ("Wing in ground (WIG), reserved for future use", "Other"), ("Fishing", "Fishing"), ("High speed craft (HSC), no additional information", "Other"),
        ("Passenger, hazardous category D", "Passenger"), ("Reserved for regional use", "Other"), ("Reserved for future use", "Other"), ("No designation", "Other"), None, ("Tank Ship", "Tanker")]
    assert mappers.vessel_types(spark).count() == 1025
    rows = spark.createDataFrame([(" Moored ",), ("3.0",), ("16",), ("x",), (None,), ("AIS-SART (active)",)], "s string")
    assert [r.c for r in rows.select(mappers.status_code(rows.s).alias("c")).collect()] == [5, 3, 15, None, None, 14]
    assert mappers.update({"a": 1, "b": 2}, {"b": 3, "c": None, "d": ""}) == {"a": 1, "b": 3}


def test_csv_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,LON\n1,2\n1,2,3\n4,5\n6\n")
    good = files.read_csv(spark, str(tmp_path), ["MMSI", "LON"])
    assert sorted(tuple(r) for r in good.collect()) == [("1", "2"), ("4", "5")]
    assert good.count() == 2 and good.select("LON").count() == 2
    assert [(r.lines, r.bad) for r in files.bad_lines(spark, str(tmp_path), ["MMSI", "LON"]).collect()] == [(4, 2)]


def test_points_in_any_number_of_buckets(spark, tmp_path):
    both = track(spark, [(k, k, 0) for k in range(20)], "a").unionByName(track(spark, [(0, 1, 1)], "b"))
    for n, per in ((None, 5), (3, 1), (None, 10_000)):
        path = str(tmp_path / f"{n}-{per}")
        files.write_points(both, path, n, per_bucket=per)
        assert files.read_points(spark, path).count() == 21 and files.read_points(spark, path, ["b"]).collect()[0].x == 1.0
        assert files.read_points(spark, path).columns == both.columns


def test_voronoi_cells_hold_what_is_nearest():
    rng = np.random.default_rng(4)
    nodes = [(k + 1, *map(float, p)) for k, p in enumerate(rng.uniform(0, 100, (12, 2)))] + [(99, *[0.0, 0.0])]
    cells = zones.voronoi_cells(nodes, 50.0)
    assert set(cells) == {n[0] for n in nodes}
    for x, y in rng.uniform(-40, 140, (200, 2)):
        best = min(nodes, key=lambda n: (n[1] - x) ** 2 + (n[2] - y) ** 2)[0]
        ring = cells[best]
        turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(ring, ring[1:] + ring[:1])]
        assert min(turns) >= -1e-6


def test_pairs_of_chosen_tracks_with_static_columns(spark):
    pts = track(spark, [(0, 0, 0), (10, 10, 10)], "a").unionByName(track(spark, [(0, 0, 10), (10, 10, 0)], "b")).unionByName(track(spark, [(0, 0, 9), (10, 10, 1)], "c"))
    agents = spark.createDataFrame([("a", "ann"), ("b", "bob")], "agent_id string, name string")
    ds = Dataset(points=pts, agents=agents)
    assert ds.intersections().count() == 3
    one = ds.intersections(tracks0=["a_T0"], tracks1=["b_T0", "a_T0"], meta_cols=["name"]).collect()
    assert [(r.track_id_0, r.track_id_1, r.name_0, r.name_1) for r in one] == [("a_T0", "b_T0", "ann", "bob")]
    met = ds.encounters(dist=2.0, time=60.0, tracks0=["b_T0", "c_T0"]).collect()
    assert met and all(r.radius == r.distance / 2 and r.x == (r.x_0 + r.x_1) / 2 for r in met) and {r.track_id_0 for r in met} == {"b_T0"}
