"""Queries over the star-schema tables, one for each operator, with SQL that gives the same rows.

Events are points: the user is the agent, the value x, props.k y, the event id the tie, the event type a status.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import edges_of
from ..operators import classify, edit, export, features, ingest, mappers, mapping, meta, pairs, resample, simplify, split, zones
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TIME, DIST = 172_800, 300.0
SQUARE = ((50.0, 20.0), (250.0, 20.0), (250.0, 80.0), (50.0, 80.0))
KITE = ((100.0, 0.0), (300.0, 50.0), (100.0, 99.0), (20.0, 50.0))
STATUS_CODES = {"click": 1, "view": 1, "purchase": 2, "error": 3}
NODES = ((1, 50.0, 25.0), (2, 50.0, 75.0), (3, 200.0, 25.0), (4, 200.0, 75.0))


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_id"), F.col("ts").alias("time"), F.col("value").alias("x"), k.alias("y"),
                                                 F.col("event_id").alias("tie"), F.col("event_type").alias("status"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.spatiotemporal(raw_points(spark, sf_dir), TIME, DIST)


def _case(pairs_: dict, column: str, miss: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs_.items()) + f" ELSE {miss} END"


def _pip(shape, x: str, y: str) -> str:
    """In-or-on test in SQL for a literal polygon."""
    cross, on = [], []
    for x1, y1, x2, y2 in edges_of(shape):
        if y1 != y2:
            cross.append(f"CASE WHEN ({y1} > {y}) <> ({y2} > {y}) AND {x} < ({x2 - x1}) * ({y} - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END")
        t = f"greatest(0.0, least(1.0, (({x} - {x1}) * ({x2 - x1}) + ({y} - {y1}) * ({y2 - y1})) / {(x2 - x1) ** 2 + (y2 - y1) ** 2}))"
        on.append(f"sqrt(({x} - {x1} - {t} * ({x2 - x1}))**2 + ({y} - {y1} - {t} * ({y2 - y1}))**2) <= 1e-8")
    return f"((({' + '.join(cross)}) % 2 = 1) OR {' OR '.join(on)})"


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


RAW = """raw AS (SELECT 'agent' || user_id AS agent_id, ts AS time, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_id AS tie, event_type AS status FROM events)"""
BASE = f"""WITH {RAW},
d1 AS (SELECT *, lag(time) OVER (PARTITION BY agent_id ORDER BY time, tie) AS pt FROM raw),
d2 AS (SELECT agent_id, time, x, y, tie, status FROM d1 WHERE pt IS NULL OR pt <> time),
s1 AS (SELECT *, lag(time) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM d2 WINDOW w AS (PARTITION BY agent_id ORDER BY time, tie)),
s2 AS (SELECT *, CASE WHEN (epoch_us(time) - epoch_us(pt)) / 1e6 > {TIME} OR sqrt((x - px)**2 + (y - py)**2) > {DIST} THEN 1 ELSE 0 END AS f FROM s1),
s3 AS (SELECT *, CAST(sum(f) OVER (PARTITION BY agent_id ORDER BY time, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track_no FROM s2),
pts AS (SELECT agent_id, track_no, agent_id || '_T' || track_no AS track_id, row_number() OVER (PARTITION BY agent_id, track_no ORDER BY time, tie) - 1 AS seq, time, x, y, tie, status FROM s3),
st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, epoch_us(time) / 1e6 AS t,
  (epoch_us(time) - lag(epoch_us(time)) OVER w) / 1e6 AS bdt, (lead(epoch_us(time)) OVER w - epoch_us(time)) / 1e6 AS fdt FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
sp0 AS (SELECT *, sqrt((x - px)**2 + (y - py)**2) AS bdr, sqrt((nx - x)**2 + (ny - y)**2) AS fdr FROM st),
sp AS (SELECT *, (coalesce(fdr / nullif(fdt, 0), bdr / nullif(bdt, 0)) + coalesce(bdr / nullif(bdt, 0), fdr / nullif(fdt, 0))) / 2 AS speed FROM sp0),
c0 AS (SELECT *, CASE WHEN nx IS NOT NULL THEN degrees(atan2(nx - x, ny - y)) END AS fc FROM sp),
c1 AS (SELECT *, lag(fc) OVER (PARTITION BY track_id ORDER BY seq) AS bc FROM c0),
co AS (SELECT *, ((((coalesce(fc, bc) + coalesce(bc, fc)) / 2) % 360) + 360) % 360 AS coursing FROM c1),
tm AS (SELECT agent_id, track_no, track_id, count(*) AS npoints, coalesce(sum(bdr), 0) AS track_length, min(time) AS start_time, max(time) AS end_time, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
  arg_min(x, seq) AS xstart, arg_min(y, seq) AS ystart, arg_max(x, seq) AS xend, arg_max(y, seq) AS yend, coalesce(min(floor(bdt)), 0) AS min_t, coalesce(avg(floor(bdt)), 0) AS mean_t, coalesce(max(floor(bdt)), 0) AS max_t,
  coalesce(min(bdr), 0) AS min_s, coalesce(avg(bdr), 0) AS mean_s, coalesce(max(bdr), 0) AS max_s FROM sp GROUP BY agent_id, track_no, track_id)
"""
K = "track_id, seq"


def speeds(spark: SparkSession, d: str) -> DataFrame:
    return features.speed(points(spark, d))


# ---------------------------------------------------------------- sources, sinks, scans


@query("scan_points", f"WITH {RAW} SELECT agent_id, time, {_r('x', 'x')}, {_r('y', 'y')} FROM raw WHERE time >= TIMESTAMP '2024-01-10'")
def _(s, d):
    return raw_points(s, d).where("time >= timestamp_ntz'2024-01-10'").select("agent_id", "time", "x", "y")


@query("from_lines", """WITH v AS (SELECT o_custkey, o_totalprice AS x, CAST(o_orderkey % 100 AS DOUBLE) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT 'agent' || o_custkey AS agent_id, make_timestamp(CAST(CASE WHEN n = 1 THEN 0 ELSE floor(k * 1e6 / (n - 1)) END AS BIGINT)) AS time, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, k AS tie FROM v""")
def _(s, d):
    v = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 100).cast("double").alias("y"))))
    return ingest.points_of_lines(table(s, d, "orders").groupBy(F.col("o_custkey").alias("identifier")).agg(v.alias("vertices")))


@query("scan_any", f"WITH {RAW} SELECT agent_id, count(*) AS n FROM raw GROUP BY agent_id")
def _(s, d):
    rows = files.read_any(s, [f"{d}/events.parquet"])
    return rows.groupBy(F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("agent_id")).agg(F.count("*").alias("n"))


@query("scan_csv", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3")
def _(s, d):
    """Orders as CSV lines, one in ten of them with a field too many, read again."""
    rows = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    more = F.when(F.col("o_orderkey") % 10 == 3, ",x").otherwise("")
    path = files.work_dir(s, "orders-csv")
    rows.select(F.concat_ws(",", "o_orderkey", F.concat("o_orderpriority", more))).write.mode("overwrite").text(path)
    return files.read_csv(s, path, ["o_orderkey", "o_orderpriority"], header=False).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


BOX = (50.0, 20.0, 250.0, 80.0)


@query("clip_box", f"WITH {RAW} SELECT agent_id, tie, {_r('x', 'x')}, {_r('y', 'y')} FROM raw WHERE x BETWEEN 50 AND 250 AND y BETWEEN 20 AND 80")
def _(s, d):
    return ingest.clip_to_box(raw_points(s, d), BOX, keep=["agent_id", "tie", "x", "y"], x="x", y="y")


@query("clip_polygon", f"WITH {RAW} SELECT agent_id, tie FROM raw WHERE {_pip(KITE, 'x', 'y')}")
def _(s, d):
    return ingest.clip_to_polygon(raw_points(s, d), KITE, keep=["agent_id", "tie"], x="x", y="y")


@query("get_tracks", BASE + f"SELECT {K}, time FROM pts WHERE track_id IN ('agent1_T0', 'agent2_T1', 'agent3_T0')")
def _(s, d):
    return export.get_tracks(points(s, d), ["agent1_T0", "agent2_T1", "agent3_T0"]).select("track_id", "seq", "time")


@query("to_df", BASE + f"SELECT p.track_id || '_P' || seq AS point_id, p.agent_id, {_r('x', 'x')}, c_mktsegment AS segment FROM pts p LEFT JOIN customer ON 'agent' || c_custkey = p.agent_id")
def _(s, d):
    static = table(s, d, "customer").select(F.concat(F.lit("agent"), F.col("c_custkey").cast("string")).alias("agent_id"), F.col("c_mktsegment").alias("segment"))
    return export.to_table(points(s, d), static).select("point_id", "agent_id", "x", "segment")


@query("to_df_code", BASE + f", f AS (SELECT * FROM pts WHERE {_pip(SQUARE, 'x', 'y')}) SELECT track_id || '_P' || (row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1) AS point_id, seq FROM f")
def _(s, d):
    return export.to_table(classify.polygon(points(s, d), SQUARE, 16), code=16).select("point_id", "seq")


@query("to_lines", BASE + f"SELECT agent_id, track_id, count(*) AS npoints, {_r('sum(x * (seq + 1))', 'checksum')} FROM pts GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    v = F.aggregate("vertices", F.lit(0.0), lambda a, p: a + p["x"] * (p["seq"] + 1))
    return export.to_lines(points(s, d)).select("agent_id", "track_id", "npoints", v.alias("checksum"))


RUNS = ", fl AS (SELECT *, {flag} AS f FROM {src}), r1 AS (SELECT *, CASE WHEN f <> coalesce(lag(f) OVER (PARTITION BY track_id ORDER BY seq), false) THEN 1 ELSE 0 END AS ch FROM fl), rn AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM r1)"


@query("to_lines_code", BASE + RUNS.format(flag=_pip(SQUARE, "x", "y"), src="pts") + "SELECT track_id, count(*) AS npoints, min(seq) AS first_seq FROM rn WHERE f GROUP BY track_id, run HAVING count(*) >= 2")
def _(s, d):
    return export.to_lines(classify.polygon(points(s, d), SQUARE, 16), 16).select("track_id", "npoints", "first_seq")


@query("to_segments", BASE + f"SELECT track_id || '_S' || seq AS segment_id, {_r('x', 'x0')}, {_r('nx', 'x1')}, {_r('(speed + nspeed) / 2', 'speed')} FROM (SELECT *, lead(speed) OVER (PARTITION BY track_id ORDER BY seq) AS nspeed FROM sp) WHERE nx IS NOT NULL")
def _(s, d):
    return export.to_segments(speeds(s, d), "middle", ("speed",)).select("segment_id", "x0", "x1", "speed")


@query("raster_blank", "SELECT r AS row, c AS col, 10.0 + (c + 0.5) * 5 AS x, 20.0 + (r + 0.5) * 4 AS y, CAST(0 AS DOUBLE) AS value FROM range(30) a(r), range(40) b(c)")
def _(s, d):
    return export.blank_raster(s, 10.0, 20.0, 40, 30, 5.0, 4.0)


def _cells_sql(value: str) -> str:
    # Liang-Barsky clipping of each step against each cell's square
    return BASE + f""", sg AS (SELECT track_id, seq, x, y, coalesce(nx, x) AS qx, coalesce(ny, y) AS qy FROM st),
g AS (SELECT r, c, c * 50.0 AS a, r * 10.0 AS b FROM range(10) u(r), range(8) v(c)),
h AS (SELECT sg.*, r, c, a, b, qx - x AS dx, qy - y AS dy FROM sg, g WHERE least(x, qx) <= a + 50 AND greatest(x, qx) >= a AND least(y, qy) <= b + 10 AND greatest(y, qy) >= b),
k AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (a - x) / dx WHEN dx < 0 THEN (a + 50 - x) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (b - y) / dy WHEN dy < 0 THEN (b + 10 - y) / dy ELSE 0 END) AS lo,
 least(1, CASE WHEN dx > 0 THEN (a + 50 - x) / dx WHEN dx < 0 THEN (a - x) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (b + 10 - y) / dy WHEN dy < 0 THEN (b - y) / dy ELSE 1 END) AS hi FROM h),
t AS (SELECT DISTINCT track_id, r, c FROM k WHERE lo <= hi + 1e-12)
SELECT r AS row, c AS col, {value}"""


@query("rasterize_count", _cells_sql("CAST(count(*) AS DOUBLE) AS value FROM t GROUP BY r, c"))
def _(s, d):
    return export.rasterize(points(s, d), 0.0, 0.0, 8, 10, 50.0, 10.0)


@query("rasterize_sum", _cells_sql("round(CAST(sum(npoints) AS DOUBLE), 6) + 0.0 AS value FROM t JOIN tm USING (track_id) GROUP BY r, c"))
def _(s, d):
    p = points(s, d)
    return export.rasterize(p.join(meta.track_meta(p).select("track_id", "npoints"), "track_id"), 0.0, 0.0, 8, 10, 50.0, 10.0, "npoints")


@query("udf_agent", BASE + f"SELECT agent_id, count(*) AS n, {_r('max(x) - min(x)', 'spread')} FROM pts GROUP BY agent_id")
def _(s, d):
    import pandas as pd

    def spread(pdf):
        return pd.DataFrame([(pdf["agent_id"].iloc[0], len(pdf), float(pdf["x"].max() - pdf["x"].min()))], columns=["agent_id", "n", "spread"])

    return points(s, d).groupBy("agent_id").applyInPandas(spread, "agent_id string, n long, spread double")


# ---------------------------------------------------------------- ingestion and mapping


@query("group_points", f"WITH {RAW} SELECT agent_id, time, {_r('x', 'x')}, {_r('y', 'y')}, CASE status WHEN 'click' THEN 'press' ELSE status END AS status FROM raw")
def _(s, d):
    rows = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    got, _agents = ingest.group_points(rows, {"ts": "Time", "value": "X", "k": "Y", "event_type": "status"}, "user_id", dynamic=["status"], data_mappers={"status": {"click": "press"}}, tie="event_id")
    return got.select("agent_id", "time", "x", "y", "status")


@query("agent_static_mode", f"WITH {RAW}, n AS (SELECT agent_id, status, count(*) AS n FROM raw GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY n DESC, status) AS k FROM n) SELECT agent_id, status FROM r WHERE k = 1")
def _(s, d):
    return meta.agent_static_mode(raw_points(s, d), ["status"])


_SYNONYMS = ", ".join(f"('{std}', '{w}')" for std, words in mappers.COLUMNS.items() for w in [std, *words])
_PLAIN = f"SELECT DISTINCT lower(regexp_replace(w, '[ _-]+', '', 'g')) AS raw, std AS mapped FROM (VALUES {_SYNONYMS}) v(std, w)"


@query("col_mapper", f"WITH m AS ({_PLAIN}) SELECT c AS raw, mapped FROM (VALUES ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props'), ('Base Date-Time'), ('LAT'), ('lon')) v(c) LEFT JOIN m ON m.raw = lower(regexp_replace(c, '[ _-]+', '', 'g'))")
def _(s, d):
    got = mapping.column_mapper(table(s, d, "events").columns + ["Base Date-Time", "LAT", "lon"])
    return s.createDataFrame(list(got.items()), "raw string, mapped string")


@query("raw_value_mapper", "WITH v AS (SELECT 'event_type' AS \"column\", event_type AS raw FROM events UNION SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events) SELECT \"column\", raw, CASE raw WHEN 'click' THEN 'press' WHEN '7' THEN 'seven' END AS mapped FROM v")
def _(s, d):
    fill = s.createDataFrame([("click", "press"), ("7", "seven")], "raw string, mapped string")
    return mapping.raw_value_mapper(table(s, d, "events"), ["event_type", "user_id"], fill)


@query("std_columns", _PLAIN)
def _(s, d):
    return mapping.standard_table(s)


_RAW_STATUS = ("At anchor", "5.0", "MOORED", "16", "under way using engine", "nonsense", "7", "Power-driven vessel towing astern", "17")


@query("ais_status", "SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in ((0, 1), (1, 5), (2, 5), (3, 15), (4, 0), (6, 7), (7, 11))) + " ELSE -1 END AS status FROM events")
def _(s, d):
    raw = F.element_at(F.array(*[F.lit(v) for v in _RAW_STATUS]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(s, d, "events").select("event_id", F.coalesce(mappers.status_code(raw), F.lit(-1)).alias("status"))


@query("ais_types", """WITH c AS (SELECT event_id, event_id % 1100 AS c FROM events) SELECT event_id, CASE WHEN c = 0 THEN 'Unknown' WHEN c IN (30, 1001, 1002) THEN 'Fishing' WHEN c IN (31, 32, 52, 1025) THEN 'Tug/Tow' WHEN c = 35 THEN 'Military'
 WHEN c IN (36, 37, 1019) THEN 'Recreational' WHEN c IN (51, 1021) THEN 'SAR' WHEN c BETWEEN 60 AND 69 OR c BETWEEN 1012 AND 1015 THEN 'Passenger' WHEN c BETWEEN 70 AND 79 OR c IN (1003, 1004, 1016) THEN 'Cargo' WHEN c BETWEEN 80 AND 89 OR c IN (1017, 1023, 1024) THEN 'Tanker'
 WHEN c < 1000 OR c BETWEEN 1005 AND 1022 THEN 'Other' ELSE 'none' END AS type, c BETWEEN 100 AND 199 AS regional FROM c""")
def _(s, d):
    rows = table(s, d, "events").select("event_id", (F.col("event_id") % 1100).alias("AISCode"))
    return mappers.with_vessel_types(rows).select("event_id", F.coalesce("type", F.lit("none")).alias("type"), F.coalesce(F.col("typestandard") == "Reserved for regional use", F.lit(False)).alias("regional"))


@query("meta_values", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def _(s, d):
    return mapping.values_of(table(s, d, "customer"), "c_mktsegment")


@query("data_values", "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
def _(s, d):
    return mapping.values_of(raw_points(s, d), "status")


@query("map_meta", "SELECT c_custkey, coalesce(n_name, 'nowhere') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def _(s, d):
    t = table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("raw"), F.col("n_name").alias("mapped"))
    return mapping.map_by_table(table(s, d, "customer"), "c_nationkey", t, "nation", "nowhere").select("c_custkey", "nation")


@query("map_data", f"WITH {RAW} SELECT tie, CAST({_case({'click': 1, 'view': 2}, 'status', '-9')} AS BIGINT) AS kind FROM raw")
def _(s, d):
    return mapping.map_columns(raw_points(s, d), {"status": {"click": 1, "view": 2}}, {"status": "kind"}, fill=-9).select("tie", "kind")


@query("map_codes", f"WITH {RAW}, m AS (SELECT tie, {_case(STATUS_CODES, 'status', '-1')} AS v FROM raw) SELECT tie, v = 1 AS code1, v = 2 AS code2, v = 3 AS code3 FROM m")
def _(s, d):
    return mapping.map_to_codes(raw_points(s, d), "status", STATUS_CODES).select("tie", "code1", "code2", "code3")


@query("drop_meta", "SELECT c_custkey, c_name FROM customer")
def _(s, d):
    return mapping.drop_columns(table(s, d, "customer"), ["c_nationkey", "c_acctbal", "c_mktsegment", "absent"])


@query("drop_data", f"WITH {RAW} SELECT agent_id, time, {_r('x', 'x')}, {_r('y', 'y')}, tie FROM raw")
def _(s, d):
    return mapping.drop_columns(raw_points(s, d), ["status", "absent"])


@query("format_input", "SELECT event_id, coalesce(TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT), 0) AS n FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", mapping.parse_number(F.col("props")).alias("n"))


# ---------------------------------------------------------------- splits


@query("split_st", BASE + "SELECT track_id, seq, tie FROM pts")
def _(s, d):
    return points(s, d).select("track_id", "seq", "tie")


@query("split_by_data", f"WITH {RAW}, a AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER w AND lag(time) OVER w IS NOT NULL THEN 1 ELSE 0 END AS f FROM raw WINDOW w AS (PARTITION BY agent_id ORDER BY time, tie)) SELECT tie, agent_id || '_T' || CAST(sum(f) OVER (PARTITION BY agent_id ORDER BY time, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track_id FROM a")
def _(s, d):
    return split.by_data(raw_points(s, d), "status").select("tie", "track_id")


# point by point: the first track whose last point is near enough, or a new one
OVERLAP_SQL = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT agent_id, tie, epoch_us(time) / 1e6 AS t, x, y, row_number() OVER (PARTITION BY agent_id ORDER BY time, tie) AS k FROM d2),
go(agent_id, k, tie, hit, tails) AS (SELECT agent_id, k, tie, CAST(1 AS BIGINT), [{{'t': t, 'x': x, 'y': y}}] FROM o WHERE k = 1
 UNION ALL SELECT agent_id, k, tie, hit, list_concat(list_concat(tails[:hit - 1], [{{'t': t, 'x': x, 'y': y}}]), tails[hit + 1:]) FROM (
  SELECT o.*, tails, CAST(coalesce(list_position(list_transform(tails, lambda e: o.t - e.t <= 172800 AND sqrt((o.x - e.x)**2 + (o.y - e.y)**2) <= 60), true), len(tails) + 1) AS BIGINT) AS hit FROM go JOIN o ON o.agent_id = go.agent_id AND o.k = go.k + 1))
SELECT tie, agent_id || '_T' || (hit - 1) AS track_id, row_number() OVER (PARTITION BY agent_id, hit ORDER BY k) - 1 AS seq FROM go"""


@query("split_overlap", OVERLAP_SQL)
def _(s, d):
    return split.overlapping(raw_points(s, d), 172_800, 60.0).select("tie", "track_id", "seq")


@query("split_kmeans")
def _(s, d):
    return split.kmeans(raw_points(s, d), range(2, 5)).select("tie", "track_id")


@query("kmeans_errors")
def _(s, d):
    return split.kmeans_errors(raw_points(s, d), range(2, 5))


@query("split_dbscan")
def _(s, d):
    return split.dbscan(raw_points(s, d), eps=0.5, min_samples=2).select("tie", "track_id")


@query("repair")
def _(s, d):
    p = points(s, d)
    return split.repair(p, meta.track_meta(p), 400_000, 60.0).select("tie", "track_id", "seq")


@query("track_gaps", BASE + f", g AS (SELECT agent_id, track_id AS track_id_0, lead(track_id) OVER w AS track_id_1, (lead(epoch_us(start_time)) OVER w - epoch_us(end_time)) / 1e6 AS dt, sqrt((lead(xstart) OVER w - xend)**2 + (lead(ystart) OVER w - yend)**2) AS dr FROM tm WINDOW w AS (PARTITION BY agent_id ORDER BY track_no)) SELECT track_id_0, track_id_1, {_r('dt', 'time_difference')}, {_r('dr', 'distance')}, {_r('dr / nullif(dt, 0)', 'speed')} FROM g WHERE track_id_1 IS NOT NULL")
def _(s, d):
    return split.track_gaps(meta.track_meta(points(s, d))).select("track_id_0", "track_id_1", "time_difference", "distance", "speed")


@query("remove_agents", BASE + "SELECT track_id, seq FROM pts WHERE agent_id NOT IN ('agent1', 'agent5')")
def _(s, d):
    return split.remove_agents(points(s, d), ["agent1", "agent5"]).select("track_id", "seq")


@query("remove_tracks", BASE + "SELECT track_id, seq FROM pts WHERE track_id NOT IN ('agent1_T0', 'agent5_T0')")
def _(s, d):
    return split.remove_tracks(points(s, d), ["agent1_T0", "agent5_T0"]).select("track_id", "seq")


# ---------------------------------------------------------------- metadata and aggregates


@query("track_meta", BASE + f"""SELECT track_id, agent_id, npoints, {_r('track_length', 'track_length')}, start_time, end_time, CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1e6) AS BIGINT) AS duration, year(end_time) AS year, month(end_time) AS month,
 {_r('xmin', 'xmin')}, {_r('ymax', 'ymax')}, {_r('xstart', 'xstart')}, {_r('yend', 'yend')}, {_r('sqrt((xend - xstart)**2 + (yend - ystart)**2)', 'effective_distance')}, {_r('min_t', 'min_temporal_resolution')}, {_r('mean_t', 'mean_temporal_resolution')},
 {_r('max_s', 'max_spatial_resolution')}, {_r('mean_s', 'mean_spatial_resolution')}, {_r('track_length / nullif(sqrt((xend - xstart)**2 + (yend - ystart)**2), 0)', 'sinuosity')} FROM tm""")
def track_meta_query(s, d):
    return meta.track_meta(points(s, d)).select("track_id", "agent_id", "npoints", "track_length", "start_time", "end_time", "duration", "year", "month", "xmin", "ymax", "xstart", "yend", "effective_distance",
                                                "min_temporal_resolution", "mean_temporal_resolution", "max_spatial_resolution", "mean_spatial_resolution", "sinuosity")


@query("agent_meta", BASE + f"SELECT agent_id, count(*) AS npoints, count(DISTINCT track_no) AS ntracks, {_r('min(x)', 'xmin')}, {_r('max(y)', 'ymax')}, min(time) AS start_time, max(time) AS end_time, bool_or({_pip(SQUARE, 'x', 'y')}) AS code16 FROM pts GROUP BY agent_id")
def _(s, d):
    return meta.agent_meta(classify.polygon(points(s, d), SQUARE, 16)).select("agent_id", "npoints", "ntracks", "xmin", "ymax", "start_time", "end_time", "code16")


@query("dataset_meta", "SELECT * FROM (VALUES ('dynamic', 'status'), ('dynamic', 'time'), ('dynamic', 'x'), ('dynamic', 'y'), ('static', 'segment')) t(kind, field)")
def _(s, d):
    return meta.dataset_meta(points(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("segment")))


@query("topk_longest_tracks", BASE + f"SELECT track_id, {_r('track_length', 'track_length')} FROM tm ORDER BY tm.track_length DESC, track_id LIMIT 10")
def _(s, d):
    return meta.longest_tracks(meta.track_meta(points(s, d))).select("track_id", "track_length")


@query("status_share", f"WITH {RAW}, n AS (SELECT agent_id, status, count(*) AS n FROM raw GROUP BY ALL) SELECT agent_id, status, n, {_r('n / sum(n) OVER (PARTITION BY agent_id)', 'share')} FROM n")
def _(s, d):
    return meta.status_share(raw_points(s, d), "status")


STOP = 0.001


@query("stopped_share", BASE + f"SELECT track_id, {_r(f'avg(CASE WHEN speed <= {STOP} THEN 1.0 ELSE 0.0 END)', 'share')} FROM sp GROUP BY track_id")
def _(s, d):
    return classify.speed(speeds(s, d), STOP, lower=True, code=17).groupBy("track_id").agg(F.avg(F.col("code17").cast("double")).alias("share"))


@query("polygon_first_last", BASE + f"SELECT agent_id, min(time) AS first_time, max(time) AS last_time FROM pts WHERE {_pip(SQUARE, 'x', 'y')} GROUP BY agent_id")
def _(s, d):
    return classify.polygon(points(s, d), SQUARE, 16).where("code16").groupBy("agent_id").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query("stats_describe_rollup", f"SELECT CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS event_type, count(value) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value)', 'std')}, {_r('min(value)', 'least')}, {_r('quantile_cont(value, 0.5)', 'median')}, {_r('max(value)', 'largest')} FROM events GROUP BY ROLLUP (event_type)")
def _(s, d):
    return meta.describe_by(table(s, d, "events"), "event_type", "value")


@query("counts_by_month_rollup", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS p FROM orders) SELECT CASE WHEN grouping(m) = 1 THEN 'All' ELSE m END AS month, CASE WHEN grouping(p) = 1 THEN 'All' ELSE p END AS o_orderpriority, count(*) AS n FROM m GROUP BY ROLLUP (m, p)")
def _(s, d):
    return meta.counts_by_month(table(s, d, "orders"), "o_orderpriority", "o_orderdate")


@query("hist_by_type", f"SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n, {_r('count(*) / (SELECT count(value) FROM events)', 'share')} FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _(s, d):
    return meta.histogram_by(table(s, d, "events"), "event_type", "value", 25.0)


# ---------------------------------------------------------------- classifiers


def _code(df: DataFrame, n: int) -> DataFrame:
    return df.select("track_id", "seq", F.col(f"code{n}").alias("code"))


@query("classify_polygon", BASE + f"SELECT {K}, {_pip(KITE, 'x', 'y')} AS code FROM pts")
def _(s, d):
    return _code(classify.polygon(points(s, d), KITE), 16)


@query("classify_polygons", BASE + f"SELECT {K}, CAST(CASE WHEN {_pip(SQUARE, 'x', 'y')} THEN 5 WHEN {_pip(KITE, 'x', 'y')} THEN 7 ELSE 0 END AS BIGINT) AS polygon FROM pts")
def _(s, d):
    return classify.polygons(points(s, d), [(5, SQUARE), (7, KITE)]).select("track_id", "seq", "polygon")


@query("classify_toward", BASE + f"SELECT {K}, (xstart - 100)**2 + (ystart - 50)**2 > (xend - 100)**2 + (yend - 50)**2 AS code FROM pts JOIN tm USING (track_id)")
def _(s, d):
    return _code(classify.toward(points(s, d), (100.0, 50.0)), 16)


@query("classify_speed", BASE + f"SELECT {K}, coalesce(speed >= 0.005, false) AS code FROM sp")
def _(s, d):
    return _code(classify.speed(speeds(s, d), 0.005), 17)


TURN = """, q AS (SELECT *, lead(coursing) OVER w AS nco, lag(coursing) OVER w AS pco FROM co WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
tr AS (SELECT *, (coalesce((nco - coursing) / nullif(fdt, 0), (coursing - pco) / nullif(bdt, 0)) + coalesce((coursing - pco) / nullif(bdt, 0), (nco - coursing) / nullif(fdt, 0))) / 2 AS tr FROM q)"""


@query("classify_turns", BASE + TURN + f"SELECT {K}, coalesce(abs(tr) >= 0.01, false) AS code FROM tr")
def _(s, d):
    return _code(classify.turns(features.turning_rate(features.coursing(points(s, d))), 0.01), 18)


@query("classify_speed_polygon", BASE + f"SELECT {K}, coalesce(speed <= 0.005, false) AND {_pip(SQUARE, 'x', 'y')} AS code FROM sp")
def _(s, d):
    return _code(classify.speed_in_polygon(speeds(s, d), 0.005, SQUARE, lower=True), 19)


@query("classify_trip", BASE + f"SELECT {K}, ({_pip(SQUARE, 'xstart', 'ystart')} AND {_pip(KITE, 'xend', 'yend')}) OR ({_pip(KITE, 'xstart', 'ystart')} AND {_pip(SQUARE, 'xend', 'yend')}) AS code FROM pts JOIN tm USING (track_id)")
def _(s, d):
    return _code(classify.trip(points(s, d), SQUARE, KITE), 20)


def _meet(shape) -> str:
    """Whether the step from (x, y) to (nx, ny) crosses an edge."""
    out = []
    for x1, y1, x2, y2 in edges_of(shape):
        det = f"nullif((x - nx) * ({y1 - y2}) - (y - ny) * ({x1 - x2}), 0)"
        out.append(f"coalesce(((x - {x1}) * ({y1 - y2}) - (y - {y1}) * ({x1 - x2})) / {det} BETWEEN 0 AND 1 AND ((x - {x1}) * (y - ny) - (y - {y1}) * (x - nx)) / {det} BETWEEN 0 AND 1, false)")
    return "(" + " OR ".join(out) + ")"


TRIANGLE = ((150.0, 10.0), (400.0, 45.0), (150.0, 60.0))
TOUCH = f", h AS (SELECT *, nx IS NOT NULL AND ({_meet(TRIANGLE)} OR {_pip(TRIANGLE, 'x', 'y')} OR {_pip(TRIANGLE, 'nx', 'ny')}) AS h FROM st)"


@query("classify_touching", BASE + TOUCH + f"SELECT {K}, bool_or(h) OVER (PARTITION BY track_id) AS code FROM h")
def _(s, d):
    return _code(classify.touching(points(s, d), TRIANGLE), 21)


@query("classify_touching_seg", BASE + TOUCH + f"SELECT {K}, h OR coalesce(lag(h) OVER (PARTITION BY track_id ORDER BY seq), false) AS code FROM h")
def _(s, d):
    return _code(classify.touching(points(s, d), TRIANGLE, True), 21)


STOPS = RUNS.format(flag=f"coalesce(speed <= {STOP}, false)", src="sp") + ", sr AS (SELECT *, count(*) OVER r AS n, (max(epoch_us(time)) OVER r - min(epoch_us(time)) OVER r) / 1e6 AS len, min(seq) OVER r AS a, max(seq) OVER r AS z FROM rn WINDOW r AS (PARTITION BY track_id, run))"


@query("classify_stops", BASE + STOPS + f"SELECT {K}, f AND n >= 2 AND len >= 1800 AS code FROM sr")
def _(s, d):
    return _code(classify.stops(speeds(s, d), STOP, 1800), 22)


@query("classify_custom", BASE + f"SELECT {K}, track_id = 'agent1_T0' AS code FROM pts")
def _(s, d):
    return _code(classify.custom(points(s, d), {"agent1_T0": True, "agent2_T0": False}), 23).withColumn("code", F.coalesce("code", F.lit(False)))


@query("semi_join_tracks", BASE + f"SELECT {K} FROM pts WHERE track_id IN (SELECT track_id FROM tm WHERE track_length > 2000)")
def _(s, d):
    p = points(s, d)
    return classify.of_tracks(p, meta.track_meta(p).where("track_length > 2000")).select("track_id", "seq")


# ---------------------------------------------------------------- derived columns


for _m, _f, _b in (("forward", 1, 0), ("backward", 0, 1), ("middle", 1, 1)):
    _short = {"forward": "fwd", "backward": "bwd", "middle": "mid"}[_m]
    _pick = {"forward": "coalesce({f}, {b})", "backward": "coalesce({b}, {f})", "middle": "(coalesce({f}, {b}) + coalesce({b}, {f})) / 2"}[_m]
    _c = _pick.format(f="fc", b="bc")

    @query(f"coursing_{_short}", BASE + f"SELECT {K}, {_r(f'((({_c}) % 360) + 360) % 360', 'coursing')} FROM co")
    def _(s, d, m=_m):
        return features.coursing(points(s, d), m).select("track_id", "seq", "coursing")

    @query(f"speed_{_short}", BASE + f"SELECT {K}, {_r(_pick.format(f='fdr / nullif(fdt, 0)', b='bdr / nullif(bdt, 0)'), 'speed')} FROM sp")
    def _(s, d, m=_m):
        return features.speed(points(s, d), m).select("track_id", "seq", "speed")


def _geodesic_sql() -> str:
    """Vincenty's inverse formula, fifteen times over."""
    f = 1 / 298.257223563
    base = BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    step = "sqrt((cos(u2) * sin(lam))**2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))**2)"
    return base + f""", ends AS (SELECT track_id, seq, x / 4 - 90 AS lon, y / 2 AS lat, nx / 4 - 90 AS lon2, ny / 2 AS lat2 FROM st),
g0 AS (SELECT track_id, seq, atan((1 - {f}) * tan(radians(lat))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lon2 - lon) AS l FROM ends WHERE lon2 IS NOT NULL),
v(track_id, seq, u1, u2, l, lam, k) AS (SELECT *, l, 0 FROM g0 UNION ALL SELECT track_id, seq, u1, u2, l, CASE WHEN ss = 0 THEN l ELSE l + (1 - c) * {f} * sa * (atan2(ss, cs) + c * ss * (m + c * cs * (2 * m * m - 1))) END, k + 1 FROM (
 SELECT *, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS c, CASE WHEN c2 > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / c2 ELSE 0 END AS m FROM (SELECT *, 1 - sa * sa AS c2 FROM (SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM (
  SELECT *, {step} AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v WHERE k < 15)))) ),
az AS (SELECT track_id, seq, degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) AS a FROM v WHERE k = 15)
SELECT p.track_id, p.seq, round((((coalesce(az.a, bz.a)) % 360) + 360) % 360, 6) + 0.0 AS coursing FROM pts p LEFT JOIN az ON az.track_id = p.track_id AND az.seq = p.seq LEFT JOIN az bz ON bz.track_id = p.track_id AND bz.seq = p.seq - 1"""


@query("coursing_geodesic", _geodesic_sql())
def _(s, d):
    p = points(s, d).withColumns({"x": F.col("x") / 4 - 90, "y": F.col("y") / 2})
    return features.coursing(p, "forward", geographic=True).select("track_id", "seq", "coursing")


@query("turning_rate", BASE + TURN + f"SELECT {K}, {_r('tr', 'turning_rate')} FROM tr")
def _(s, d):
    return features.turning_rate(features.coursing(points(s, d))).select("track_id", "seq", "turning_rate")


@query("acceleration", BASE + f", q AS (SELECT *, lead(speed) OVER w AS ns, lag(speed) OVER w AS ps FROM sp WINDOW w AS (PARTITION BY track_id ORDER BY seq)) SELECT {K}, {_r('1e6 * (coalesce((ns - speed) / nullif(fdt, 0), (speed - ps) / nullif(bdt, 0)) + coalesce((speed - ps) / nullif(bdt, 0), (ns - speed) / nullif(fdt, 0))) / 2', 'micro_acceleration')} FROM q")
def _(s, d):
    return features.acceleration(speeds(s, d)).select("track_id", "seq", (F.col("acceleration") * 1e6).alias("micro_acceleration"))


@query("timestep", BASE + f"SELECT {K}, {_r('bdt', 'timestep')} FROM st")
def _(s, d):
    return features.timestep(points(s, d)).select("track_id", "seq", "timestep")


TRAVEL = ", q AS (SELECT *, sum(coalesce(bdr, 0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dt FROM sp)"


@query("distance_travelled", BASE + TRAVEL + f"SELECT {K}, {_r('dt', 'distance_travelled')} FROM q")
def _(s, d):
    return features.distance_travelled(points(s, d)).select("track_id", "seq", "distance_travelled")


@query("distance_travelled_rel", BASE + TRAVEL + f"SELECT {K}, {_r('dt / nullif(max(dt) OVER (PARTITION BY track_id), 0)', 'distance_travelled')} FROM q")
def _(s, d):
    return features.distance_travelled(points(s, d), True).select("track_id", "seq", "distance_travelled")


@query("radius_curvature", BASE + f", q AS (SELECT *, sqrt((nx - px)**2 + (ny - py)**2) AS ch, abs((x - px) * (ny - py) - (y - py) * (nx - px)) AS cr FROM sp) SELECT {K}, CASE WHEN bdr IS NULL OR fdr IS NULL THEN NULL WHEN cr <= 1e-12 * greatest(1, bdr * ch) THEN -1.0 WHEN bdr * fdr * ch / (2 * cr) > 1e6 THEN 1e6 ELSE round(bdr * fdr * ch / (2 * cr), 4) + 0.0 END AS radius FROM q")
def _(s, d):
    r = F.col("radius_of_curvature")
    return features.radius_of_curvature(points(s, d)).select("track_id", "seq", F.when(r == float("inf"), -1.0).when(r > 1e6, 1e6).otherwise(F.round(r, 4)).alias("radius"))


def _sinuosity_sql(h: int) -> str:
    return BASE + f", q AS (SELECT *, sum(bdr) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING) AS path, lag(x, {h}) OVER w AS ax, lag(y, {h}) OVER w AS ay, lead(x, {h}) OVER w AS bx, lead(y, {h}) OVER w AS yb FROM sp WINDOW w AS (PARTITION BY track_id ORDER BY seq)) SELECT {K}, {_r('path / nullif(sqrt((bx - ax)**2 + (yb - ay)**2), 0)', 'sinuosity')} FROM q"


for _w in (3, 5):

    @query(f"sinuosity_w{_w}", _sinuosity_sql(_w // 2))
    def _(s, d, w=_w):
        return features.sinuosity(points(s, d), w).select("track_id", "seq", "sinuosity")


def _raster(s: SparkSession) -> DataFrame:
    return export.blank_raster(s, 0.0, 0.0, 12, 11, 50.0, 10.0).withColumn("value", (F.col("row") * 3 + F.col("col") * F.col("col")).cast("double"))


@query("raster_sample_nearest", BASE + f"SELECT {K}, CASE WHEN floor(x / 50 + 0.5) BETWEEN 0 AND 11 AND floor(y / 10 + 0.5) BETWEEN 0 AND 10 THEN floor(y / 10 + 0.5) * 3 + floor(x / 50 + 0.5)**2 + 0.0 END AS sample FROM pts")
def _(s, d):
    return features.sample_raster(points(s, d), _raster(s), 0.0, 0.0, 50.0, 10.0, method="nearest").select("track_id", "seq", "sample")


@query("raster_sample_linear", BASE + f", q AS (SELECT *, x / 50 AS fx, floor(x / 50) AS c FROM pts) SELECT {K}, CASE WHEN x BETWEEN 0 AND 550 AND y BETWEEN 0 AND 100 THEN {_r('0.3 * y + c * c + (fx - c) * ((c + 1)**2 - c * c)', 'v')[:-5]} END AS sample FROM q")
def _(s, d):
    return features.sample_raster(points(s, d), _raster(s), 0.0, 0.0, 50.0, 10.0).select("track_id", "seq", "sample")


# ---------------------------------------------------------------- geometry


@query("reproject_3857", f"WITH {RAW} SELECT tie, {_r('radians(x / 4 - 90) * 6378137', 'x')}, {_r('ln(tan(pi() / 4 + radians(y / 2) / 2)) * 6378137', 'y')} FROM raw")
def _(s, d):
    p = raw_points(s, d).withColumns({"x": F.col("x") / 4 - 90, "y": F.col("y") / 2})
    return resample.reproject(p, 4326, 3857).select("tie", "x", "y")


def _utm_sql() -> str:
    """Krueger's series in SQL: inverse hyperbolic functions as logarithms."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a0 = 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    ath = lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"
    sinh, cosh = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)")
    x = " + ".join(f"{a} * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    y = " + ".join(f"{a} * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, a in enumerate(al, 1))
    return f"""WITH {RAW}, g AS (SELECT tie, sin(radians(y / 20 + 38)) AS s, radians(x / 200 - 76 + 75) AS lam FROM raw), h AS (SELECT *, {ath('s')} - {e} * {ath(f'({e} * s)')} AS q FROM g), k AS (SELECT *, {sinh('q')} AS t FROM h),
m AS (SELECT tie, atan2(t, cos(lam)) AS xi, sin(lam) / sqrt(1 + t * t) AS v FROM k), o AS (SELECT tie, xi, {ath('v')} AS eta FROM m) SELECT tie, round(500000 + {a0} * (eta + {x}), 6) + 0.0 AS x, round({a0} * (xi + {y}), 6) + 0.0 AS y FROM o"""


@query("reproject_utm", _utm_sql())
def _(s, d):
    p = raw_points(s, d).withColumns({"x": F.col("x") / 200 - 76, "y": F.col("y") / 20 + 38})
    return resample.reproject(p, 4326, 32618).select("tie", "x", "y")


BRACKET = """, u AS (SELECT *, {u} AS u FROM sp), v AS (SELECT *, lead(u) OVER w AS v, lead(epoch_us(time)) OVER w AS nt, max(u) OVER (PARTITION BY track_id) AS ue FROM u WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
tick AS (SELECT track_id, k * {step} AS w FROM (SELECT track_id, max(u) AS ue FROM u GROUP BY track_id), range(0, 4000) r(k) WHERE k * {step} < ue UNION ALL SELECT track_id, max(u) FROM u GROUP BY track_id),
j AS (SELECT v.*, w FROM v JOIN tick USING (track_id) WHERE ue > {step} AND ((u <= w AND w < v) OR (v IS NULL AND w = u))),
out AS (SELECT track_id, w, CASE WHEN v > u THEN x + (w - u) / (v - u) * (nx - x) ELSE x END AS x, CASE WHEN v > u THEN y + (w - u) / (v - u) * (ny - y) ELSE y END AS y FROM j
 UNION ALL SELECT track_id, u, x, y FROM v WHERE ue <= {step})
SELECT track_id, {x}, {y} FROM out"""


@query("resample_spacing", BASE + BRACKET.format(u="sum(coalesce(bdr, 0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)", step="40.0", x="round(x, 4) + 0.0 AS x", y="round(y, 4) + 0.0 AS y"))
def _(s, d):
    return resample.spacing(points(s, d), 40.0).select("track_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("resample_time", BASE + BRACKET.format(u="(epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY track_id)) / 1e6", step="21600.0", x="round(x, 4) + 0.0 AS x", y="round(y, 4) + 0.0 AS y"))
def _(s, d):
    return resample.time(points(s, d), 21600.0).select("track_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


AXIS = (1_703_980_800_000_000, 1_706_832_000_000_000, 21_600.0)  # 2023-12-31 to 2024-02-02
AXIS_SQL = f""", v AS (SELECT *, epoch_us(time) AS u, lead(epoch_us(time)) OVER w AS v FROM sp WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
tick AS (SELECT {AXIS[0]} + k * 21600000000 AS w FROM range(0, {(AXIS[1] - AXIS[0]) // 21_600_000_000} + 1) r(k)),
j AS (SELECT agent_id, track_id, w, CASE WHEN v IS NULL THEN x ELSE x + (w - u) / (v - u) * (nx - x) END AS x, CASE WHEN v IS NULL THEN y ELSE y + (w - u) / (v - u) * (ny - y) END AS y FROM v JOIN tick ON (u <= w AND w < v) OR (v IS NULL AND w = u)),
o AS (SELECT *, round((u - {AXIS[0]}) / 21600000000.0 - 1e-12) * 21600000000 + {AXIS[0]} AS w FROM v WHERE track_id NOT IN (SELECT track_id FROM j)),
o2 AS (SELECT agent_id, track_id, CAST(w AS BIGINT) AS w, arg_min(x, abs(u - w)) AS x, arg_min(y, abs(u - w)) AS y FROM o GROUP BY agent_id, track_id, w),
ax AS (SELECT * FROM j UNION ALL SELECT * FROM o2)"""


def on_axis(s, d):
    return resample.on_axis(points(s, d), *AXIS)


@query("resample_global", BASE + AXIS_SQL + f"SELECT track_id, make_timestamp(w) AS time, {_r('x', 'x')}, {_r('y', 'y')} FROM ax")
def _(s, d):
    return on_axis(s, d).select("track_id", "time", "x", "y")


CHAIKIN = ", c_{n} AS (SELECT track_id, 2 * seq + k AS seq, CASE k WHEN 0 THEN 0.75 * x + 0.25 * coalesce(px, x) ELSE 0.75 * x + 0.25 * coalesce(nx, x) END AS x, CASE k WHEN 0 THEN 0.75 * y + 0.25 * coalesce(py, y) ELSE 0.75 * y + 0.25 * coalesce(ny, y) END AS y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {src} WINDOW w AS (PARTITION BY track_id ORDER BY seq)), range(2) r(k))"


@query("smooth_corners", BASE + CHAIKIN.format(n=1, src="pts") + CHAIKIN.format(n=2, src="c_1") + f"SELECT track_id, seq, {_r('x', 'x')}, {_r('y', 'y')} FROM c_2")
def _(s, d):
    return resample.smooth_corners(points(s, d), 2).select("track_id", "seq", "x", "y")


EPSILON = 25.0
# a piece is split at its farthest point until none is farther than the tolerance
DECIMATE_SQL = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", seg(track_id, a, b) AS (SELECT track_id, CAST(0 AS BIGINT), max(seq) FROM pts GROUP BY track_id HAVING max(seq) > 0
 UNION ALL SELECT track_id, unnest([a, k]), unnest([k, b]) FROM (SELECT track_id, a, b, first(seq ORDER BY far DESC, seq) AS k, max(far) AS far FROM (
  SELECT s.track_id, a, b, p.seq, CASE WHEN q.x = r.x AND q.y = r.y THEN sqrt((p.x - q.x)**2 + (p.y - q.y)**2) ELSE abs((r.x - q.x) * (p.y - q.y) - (r.y - q.y) * (p.x - q.x)) / sqrt((r.x - q.x)**2 + (r.y - q.y)**2) END AS far
  FROM seg s JOIN pts q ON q.track_id = s.track_id AND q.seq = a JOIN pts r ON r.track_id = s.track_id AND r.seq = b JOIN pts p ON p.track_id = s.track_id AND p.seq > a AND p.seq < b) GROUP BY track_id, a, b) WHERE far > {EPSILON}),
keep AS (SELECT track_id, a AS seq FROM seg UNION SELECT track_id, b FROM seg UNION SELECT track_id, 0 FROM pts)
SELECT p.track_id, row_number() OVER (PARTITION BY p.track_id ORDER BY p.seq) - 1 AS seq, tie FROM pts p JOIN keep k ON k.track_id = p.track_id AND k.seq = p.seq"""


@query("decimate", DECIMATE_SQL)
def _(s, d):
    return simplify.decimate(points(s, d), EPSILON).select("track_id", "seq", "tie")


# the walk from one mark to the next: as far as the distance allows, or where turns add up if that comes first and isn't near
CHARACTERISTIC_SQL = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + STOPS + """, cw AS (SELECT track_id, seq, coursing, sum(coalesce(bdr, 0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS way, count(*) OVER (PARTITION BY track_id) AS total FROM co),
mark AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY a) AS k FROM (SELECT DISTINCT track_id, a, z, CASE WHEN len > 1800 THEN a ELSE z END AS goal FROM sr WHERE f)),
start AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i FROM pts UNION ALL SELECT track_id, k, z FROM mark),
goal AS (SELECT track_id, k - 1 AS k, goal AS j FROM mark UNION ALL SELECT s.track_id, max(s.k), (SELECT max(seq) FROM pts p WHERE p.track_id = s.track_id) FROM start s GROUP BY s.track_id),
walk(track_id, i, j) AS (SELECT track_id, i, j FROM start JOIN goal USING (track_id, k)
 UNION ALL SELECT u.track_id, CASE WHEN bent < far AND b.way - one > 50 THEN bent ELSE far END, j FROM (
  SELECT w.track_id, w.i, w.j, any_value(q.way) AS one, w.i + count(*) FILTER (p.way - q.way < 400) AS far, w.i + count(*) FILTER (abs(p.coursing - q.coursing) < 90) AS bent
  FROM walk w JOIN cw q ON q.track_id = w.track_id AND q.seq = w.i + 1 JOIN cw p ON p.track_id = w.track_id AND p.seq > w.i AND p.seq <= w.j WHERE w.i < w.j GROUP BY w.track_id, w.i, w.j) u JOIN cw b ON b.track_id = u.track_id AND b.seq = greatest(bent, u.i + 1)),
kept AS (SELECT track_id, i AS seq FROM walk UNION SELECT track_id, j FROM goal)
SELECT c.track_id, c.seq, total < 3 OR k.seq IS NOT NULL AS characteristic FROM cw c LEFT JOIN kept k ON k.track_id = c.track_id AND k.seq = c.seq"""


@query("characteristic", CHARACTERISTIC_SQL)
def _(s, d):
    p = features.coursing(speeds(s, d))
    return simplify.characteristic(p, STOP, 90.0, 50.0, 400.0, 1800.0).select("track_id", "seq", "characteristic")


@query("simplify_stops", BASE + STOPS + "SELECT track_id, tie FROM sr WHERE NOT (f AND n >= 2 AND len >= 1800 AND seq > a AND seq < z)")
def _(s, d):
    return simplify.simplify_stops(speeds(s, d), STOP, 1800, None).select("track_id", "tie")


DRIFT = 20.0
# a leg begins one point after the first that lies so far from where the leg before began
DRIFT_SQL = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + STOPS + f""", stop AS (SELECT DISTINCT track_id, a, z FROM sr WHERE f AND n >= 2 AND len >= 1800),
leg(track_id, i, z) AS (SELECT track_id, a, z FROM stop UNION ALL SELECT l.track_id, min(p.seq) + 1, l.z FROM leg l JOIN pts q ON q.track_id = l.track_id AND q.seq = l.i JOIN pts p ON p.track_id = l.track_id AND p.seq >= l.i AND p.seq < l.z
 WHERE sqrt((p.x - q.x)**2 + (p.y - q.y)**2) >= {DRIFT} GROUP BY l.track_id, l.i, l.z)
SELECT track_id, tie FROM sr WHERE NOT (f AND n >= 2 AND len >= 1800) OR seq = z OR EXISTS (SELECT 1 FROM leg WHERE leg.track_id = sr.track_id AND leg.i = sr.seq)"""


@query("simplify_stops_drift", DRIFT_SQL)
def _(s, d):
    return simplify.simplify_stops(speeds(s, d), STOP, 1800, DRIFT).select("track_id", "tie")


def _imprint_sql() -> str:
    parts = []
    for x1, y1, x2, y2 in edges_of(TRIANGLE):
        det = f"nullif((x - nx) * ({y1 - y2}) - (y - ny) * ({x1 - x2}), 0)"
        parts.append(f"SELECT *, ((x - {x1}) * ({y1 - y2}) - (y - {y1}) * ({x1 - x2})) / {det} AS ht, ((x - {x1}) * (y - ny) - (y - {y1}) * (x - nx)) / {det} AS hq FROM st WHERE nx IS NOT NULL")
    return BASE + f""", h AS ({' UNION ALL '.join(parts)}), n AS (SELECT agent_id, track_id, make_timestamp(CAST(round(epoch_us(time) + ht * fdt * 1e6) AS BIGINT)) AS time, x + ht * (nx - x) AS x, y + ht * (ny - y) AS y, true AS imprinted FROM h WHERE ht BETWEEN 0 AND 1 AND hq BETWEEN 0 AND 1),
b AS (SELECT agent_id, track_id, time, x, y, false AS imprinted FROM pts UNION ALL SELECT * FROM n), f AS (SELECT *, lag(time) OVER (PARTITION BY track_id ORDER BY time, imprinted, x, y) AS p FROM b)
SELECT track_id, imprinted, count(*) AS n, {_r('sum(x)', 'sx')}, {_r('sum(y)', 'sy')} FROM f WHERE p IS NULL OR p <> time GROUP BY track_id, imprinted"""


@query("imprint", _imprint_sql())
def _(s, d):
    return edit.imprint(points(s, d), TRIANGLE).groupBy("track_id", "imprinted").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("route_raster")
def _(s, d):
    cost = np.ones((11, 12))
    cost[3:8, 4] = 50.0
    return edit.route_through_raster(points(s, d), cost, 0.0, 0.0, 50.0, 10.0).select("track_id", "seq", "x", "y")


# ---------------------------------------------------------------- pairs and zones


NEAR, WITHIN = 1.0, 43_200


ENC = BASE + f""", jn AS (SELECT a.track_id AS track_id_0, a.seq AS seq_0, b.track_id AS track_id_1, b.seq AS seq_1, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d, abs(epoch_us(a.time) - epoch_us(b.time)) / 1e6 AS dt
 FROM pts a JOIN pts b ON a.track_id < b.track_id AND abs(a.x - b.x) <= {NEAR} AND abs(a.y - b.y) <= {NEAR}),
best AS (SELECT *, row_number() OVER (PARTITION BY track_id_0, seq_0, track_id_1 ORDER BY d, seq_1) AS k FROM jn WHERE d <= {NEAR}),
en AS (SELECT e.* FROM best e JOIN tm p ON p.track_id = track_id_0 JOIN tm q ON q.track_id = track_id_1 WHERE k = 1 AND dt <= {WITHIN} AND p.start_time <= q.end_time AND q.start_time <= p.end_time)"""


@query("encounters", ENC + f"SELECT track_id_0, seq_0, track_id_1, seq_1, {_r('d', 'distance')}, {_r('dt', 'time_difference')} FROM en")
def _(s, d):
    return pairs.encounters(points(s, d), dist=NEAR, time=WITHIN).select("track_id_0", "seq_0", "track_id_1", "seq_1", "distance", "time_difference")


@query("encounters_cpa", ENC + f", m AS (SELECT *, row_number() OVER (PARTITION BY track_id_0, track_id_1 ORDER BY d, seq_0 DESC) AS k2 FROM en) SELECT track_id_0, seq_0, track_id_1, {_r('d', 'distance')} FROM m WHERE k2 = 1")
def _(s, d):
    return pairs.encounters(points(s, d), dist=NEAR, time=WITHIN, filter_min=True).select("track_id_0", "seq_0", "track_id_1", "distance")


CROSS_TIME = 600


@query("intersections", BASE + f""", sg AS (SELECT track_id, seq, x, y, nx, ny, t, t + fdt AS u FROM st WHERE nx IS NOT NULL),
jn AS (SELECT a.track_id AS track_id_0, a.seq AS seq_0, b.track_id AS track_id_1, b.seq AS seq_1, a.t AS at_, a.u AS au, b.t AS bt, b.u AS bu, (a.x - a.nx) * (b.y - b.ny) - (a.y - a.ny) * (b.x - b.nx) AS det, (a.x - b.x) * (b.y - b.ny) - (a.y - b.y) * (b.x - b.nx) AS p, (a.x - b.x) * (a.y - a.ny) - (a.y - b.y) * (a.x - a.nx) AS q, a.x AS ax, a.nx AS bx
 FROM sg a JOIN sg b ON a.track_id < b.track_id AND a.t <= b.u + {CROSS_TIME} AND b.t <= a.u + {CROSS_TIME})
SELECT track_id_0, seq_0, track_id_1, seq_1, round(ax + p / det * (bx - ax), 4) + 0.0 AS x FROM jn WHERE det <> 0 AND p / det BETWEEN 0 AND 1 AND q / det BETWEEN 0 AND 1 AND abs(at_ + p / det * (au - at_) - bt - q / det * (bu - bt)) <= {CROSS_TIME}""")
def _(s, d):
    return pairs.intersections(points(s, d), time=CROSS_TIME).select("track_id_0", "seq_0", "track_id_1", "seq_1", F.round("x", 4).alias("x"))


def _proximity_sql() -> str:
    def ps(px, py, ax, ay, bx, by):
        t = f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax})**2 + ({by} - {ay})**2, 0), 0)))"
        return f"sqrt(({px} - {ax} - {t} * ({bx} - {ax}))**2 + ({py} - {ay} - {t} * ({by} - {ay}))**2)"

    ds = []
    for x1, y1, x2, y2 in edges_of(TRIANGLE):
        ds += [ps("x", "y", x1, y1, x2, y2), ps(x1, y1, "x", "y", "qx", "qy"), ps(x2, y2, "x", "y", "qx", "qy")]
    return BASE + f", sg AS (SELECT track_id, x, y, nx, ny, coalesce(nx, x) AS qx, coalesce(ny, y) AS qy FROM st) SELECT track_id, round(min(CASE WHEN nx IS NOT NULL AND {_meet(TRIANGLE)} THEN 0 ELSE least({', '.join(ds)}) END), 6) + 0.0 AS min_distance FROM sg GROUP BY track_id"


@query("proximity_object", _proximity_sql())
def _(s, d):
    return pairs.proximity_to_object(points(s, d), TRIANGLE).select("track_id", "min_distance")


PROX = BASE + AXIS_SQL + ", cm AS (SELECT a.track_id AS track_id_0, b.track_id AS track_id_1, a.w, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d FROM ax a JOIN ax b ON a.w = b.w AND a.track_id < b.track_id)"
BINNED = PROX + ", b1 AS (SELECT *, lead(d) OVER w AS d2, (lead(w) OVER w - w) / 1e6 AS sec FROM cm WINDOW w AS (PARTITION BY track_id_0, track_id_1 ORDER BY w)), b2 AS (SELECT *, sec * CASE WHEN d <= bin AND d2 <= bin THEN 1 WHEN d <= bin THEN (bin - d) / (d2 - d) WHEN d2 <= bin THEN (bin - d2) / (d - d2) ELSE 0 END AS inside FROM b1, (VALUES (10.0::DOUBLE), (40.0::DOUBLE)) b(bin) WHERE d2 IS NOT NULL)"


@query("proximities", PROX + f"SELECT track_id_0, track_id_1, count(*) AS common_timesteps, {_r('min(d)', 'min_distance')} FROM cm GROUP BY ALL")
def _(s, d):
    return pairs.proximities(on_axis(s, d)).select("track_id_0", "track_id_1", "common_timesteps", "min_distance")


@query("proximities_binned", BINNED + "SELECT track_id_0, track_id_1, bin, round(sum(inside), 3) + 0.0 AS seconds FROM b2 GROUP BY ALL")
def _(s, d):
    return pairs.proximities_binned(on_axis(s, d), [10.0, 40.0]).withColumn("seconds", F.round("seconds", 3))


@query("proximities_relative", BINNED + "SELECT make_timestamp(w) AS time, bin, round(max(inside), 3) + 0.0 AS seconds FROM b2 GROUP BY w, bin")
def _(s, d):
    return pairs.proximities_relative(on_axis(s, d), [10.0, 40.0]).withColumn("seconds", F.round("seconds", 3))


@query("time_in_polygon", BASE + RUNS.format(flag=_pip(SQUARE, "x", "y"), src="sp") + f", i AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY seq) AS k FROM rn WHERE f) SELECT track_id, min(time) AS time_0, max(time) AS time_1, count(*) AS npoints, {_r('(epoch_us(max(time)) - epoch_us(min(time))) / 1e6', 'duration')}, {_r('sum(CASE WHEN k = 1 THEN 0 ELSE bdr END)', 'distance_travelled')} FROM i GROUP BY track_id, run HAVING count(*) >= 2")
def _(s, d):
    return zones.time_in_polygon(points(s, d), SQUARE).select("track_id", "time_0", "time_1", "npoints", "duration", "distance_travelled")


NODE = "CASE least({0}) " + " ".join(f"WHEN {{{k + 1}}} THEN {n[0]}" for k, n in enumerate(NODES)) + " END"
_D = [f"((x - {x})**2 + (y - {y})**2)" for _, x, y in NODES]
NODE = f"CAST({NODE.format(', '.join(_D), *_D)} AS BIGINT)"


@query("nearest_node", BASE + f"SELECT {K}, {NODE} AS node FROM pts")
def _(s, d):
    return zones.nearest_node(points(s, d), NODES).select("track_id", "seq", "node")


@query("reduce_flow", BASE + f"SELECT {K}, CASE WHEN node <= 2 THEN 50.0 ELSE 200.0 END AS x, CASE WHEN node % 2 = 1 THEN 25.0 ELSE 75.0 END AS y FROM (SELECT *, {NODE} AS node FROM pts)")
def _(s, d):
    return edit.reduce_to_nodes(zones.nearest_node(points(s, d), NODES), NODES).select("track_id", "seq", "x", "y")


@query("flow_map", BASE + f", n AS (SELECT track_id, seq, {NODE} AS node FROM pts), c AS (SELECT *, lag(node) OVER (PARTITION BY track_id ORDER BY seq) AS p FROM n), r AS (SELECT track_id, node AS s, lead(node) OVER (PARTITION BY track_id ORDER BY seq) AS e, count(*) OVER (PARTITION BY track_id) AS k FROM c WHERE p IS NULL OR p <> node), m AS (SELECT track_id, s, CASE WHEN k = 1 THEN s ELSE e END AS e FROM r) SELECT s AS start, e AS \"end\", count(*) AS volume, count(DISTINCT track_id) AS ntracks FROM m WHERE e IS NOT NULL GROUP BY s, e")
def _(s, d):
    return zones.flow_map(zones.nearest_node(points(s, d), NODES), NODES).select("start", "end", "volume", F.size("track_ids").alias("ntracks"))


LATERAL = BASE + """, lt AS (SELECT *, (x - 0) * 1.0 AS a, (nx - 0) * 1.0 AS b, -(y - 50) AS l, -(ny - 50) AS m FROM st WHERE nx IS NOT NULL), sl AS (SELECT k * 50.0 AS s FROM range(0, 9) r(k)),
cr AS (SELECT track_id, seq, s AS longitudinal, round(l + (s - a) / (b - a) * (m - l), 8) AS lat, CASE WHEN b > a THEN 'F' ELSE 'T' END AS direction FROM lt JOIN sl ON (a <= s AND s < b) OR (a >= s AND s > b))"""


@query("lateral_points", LATERAL + f"SELECT track_id, seq, {_r('longitudinal', 'longitudinal')}, round(lat * 100, 6) + 0.0 AS centi_lateral, direction FROM cr")
def _(s, d):
    return zones.lateral_points(points(s, d), (0.0, 50.0), (400.0, 50.0), 50.0).select("track_id", "seq", "longitudinal", (F.col("lateral") * 100).alias("centi_lateral"), "direction")


@query("lateral_hist", LATERAL + f", g AS (SELECT longitudinal, direction, CAST(floor(lat / 10) AS BIGINT) AS bin, count(*) AS n FROM cr GROUP BY ALL) SELECT {_r('longitudinal', 'longitudinal')}, direction, bin, n, {_r('n / sum(n) OVER (PARTITION BY longitudinal, direction)', 'frequency')} FROM g")
def _(s, d):
    return zones.lateral_distribution(zones.lateral_points(points(s, d), (0.0, 50.0), (400.0, 50.0), 50.0), 10.0)
