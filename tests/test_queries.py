"""Every query with SQL gives the rows of its SQL on the smallest table."""

from __future__ import annotations

import math

import duckdb
import pytest

from movespark.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str)})

    def plain(v):
        if v is None or v != v:
            return "null"
        return round(float(v), 5) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-5, rel_tol=1e-9))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(same(x, y) for r, q in zip(a, b) for x, y in zip(r, q))


def test_clusters_and_chains_keep_every_point(spark, duck):
    """Queries without SQL: each point once, tracks numbered on, cluster tables as large as they must be."""
    assert set(QUERIES) - set(SQL) == {"split_kmeans", "kmeans_errors", "split_dbscan", "repair", "route_raster"}
    ties = {r[0] for r in duck.sql("select event_id from events").fetchall()}
    for name in ("split_kmeans", "split_dbscan", "repair"):
        got = QUERIES[name](spark, DATA).toPandas()
        assert sorted(got["tie"]) == sorted(ties)
    assert (got.groupby("track_id")["seq"].agg(lambda v: sorted(v) == list(range(len(v))))).all()
    plain = duck.sql(SQL["split_st"]).df()["track_id"].nunique()
    assert got["track_id"].nunique() <= plain
    errors = QUERIES["kmeans_errors"](spark, DATA).toPandas()
    agents = duck.sql("select count(distinct user_id) from events").fetchall()[0][0]
    assert len(errors) == 3 * agents and (errors["inertia"] >= 0).all() and errors["silhouette"].between(-1, 1).all()
    routed = QUERIES["route_raster"](spark, DATA).toPandas()
    assert (routed.groupby("track_id")["seq"].agg(lambda v: sorted(v) == list(range(len(v))))).all() and routed["track_id"].nunique() == plain
