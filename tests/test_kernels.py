"""Sequential operators: streams of whole tracks against one track at a time."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from movespark.functions import clustering, kernels
from movespark.operators import edit, simplify, split


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(7)
    rows = [(f"a{a}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * t), *rng.uniform(-2, 8, 2).round(3).tolist(), t) for a in range(12) for t in range(30)]
    p = spark.createDataFrame(rows, "agent_id string, time timestamp_ntz, x double, y double, tie long")
    p = split.numbered(p, edit.F.expr("tie % 9 = 0"))
    return p, p.toPandas().sort_values(["agent_id", "track_no", "seq"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_against_a_track_at_a_time(tracks):
    """F8: tracks aren't groups, and a path is looked for once."""
    p, rows = tracks
    cost = np.ones((6, 7))
    cost[1:5, 3] = 9.0
    got = edit.route_through_raster(p, cost, 0.0, 0.0, 1.0, 1.0)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = []
    for (agent, no), g in rows.groupby(["agent_id", "track_no"]):
        xy = g[["x", "y"]].to_numpy()
        cells = [(int(r), int(c)) if 0 <= r < 6 and 0 <= c < 7 else None for c, r in np.rint(xy)]
        out = []
        for inside, run in itertools.groupby(range(len(xy)), lambda i: cells[i] is not None):
            run = list(run)
            path = kernels.cheapest_path(cost, cells[run[0]], cells[run[-1]]) if inside and len(run) > 1 else []
            out += [tuple(xy[run[0]]), *((float(c), float(r)) for r, c in path[1:-1]), tuple(xy[run[-1]])] if len(path) > 1 else [tuple(xy[i]) for i in run]
        want += [(agent, no, k, *v) for k, v in enumerate(out)]
    found = got.select("agent_id", "track_no", "seq", "x", "y").toPandas()
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want)


def test_clusters_are_streams_of_agents(tracks):
    """agents aren't groups, and each gets the labels that its points get alone."""
    p, rows = tracks
    for got, label in ((split.dbscan(p, eps=0.4), lambda x: clustering.dbscan(x, 0.4, 2)), (split.kmeans(p, range(2, 5)), lambda x: clustering.best_kmeans(x, range(2, 5), "davies-bouldin", 0)[0])):
        assert "FlatMapGroupsInPandas" not in plan(got)
        found = got.select("agent_id", "tie", "track_no").toPandas().sort_values(["agent_id", "tie"])
        for agent, g in found.groupby("agent_id"):
            of = rows[rows["agent_id"] == agent].sort_values("time")
            assert g["track_no"].tolist() == label(split._features(of, ("x", "y"))).tolist()


def test_whole_tracks_however_batched(tracks):
    _p, rows = tracks
    for size in (1, 5, 50, 1000):
        seen = [g for pdf, edges in simplify.whole_tracks(rows[lo : lo + size] for lo in range(0, len(rows), size)) for g in (pdf[a:b] for a, b in zip(edges, edges[1:]))]
        assert [len(g.drop_duplicates(["agent_id", "track_no"])) for g in seen] == [1] * len(seen) and len(seen) == len(rows.drop_duplicates(["agent_id", "track_no"]))
        assert pd.concat(seen)["tie"].tolist() == rows["tie"].tolist()


def test_dbscan_of_few_points_is_that_of_many(monkeypatch):
    """the matrix of all pairs gives the labels that look-ups give."""
    rng = np.random.default_rng(2)
    for eps, least in ((0.3, 1), (0.5, 2), (0.5, 4)):
        x = rng.normal(size=(80, 2))
        few = clustering.dbscan(x, eps, least)
        monkeypatch.setattr(clustering, "DENSE", 0)
        assert few.tolist() == clustering.dbscan(x, eps, least).tolist()
        monkeypatch.undo()


def test_scores_not_asked_for_are_not_made(monkeypatch):
    """the silhouette, quadratic in the points, is not made where it doesn't choose."""
    monkeypatch.setattr(clustering, "silhouette", lambda *a: pytest.fail("made"))
    x = np.random.default_rng(2).normal(size=(50, 2))
    assert clustering.best_kmeans(x, range(2, 5), "davies-bouldin", 0, scores=("davies-bouldin",))[0].max() > 0
