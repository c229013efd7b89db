"""Tables, lines and segments of tracks, and rasters of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import wkt_line
from ..functions.tracks import track, micros, nxt
from .classify import runs


def get_tracks(points: DataFrame, tracks: list[str]) -> DataFrame:
    return points.where(F.col("track_id").isin(tracks))


def to_table(points: DataFrame, agents: DataFrame | None = None, code: int | None = None) -> DataFrame:
    """Points with their agent's static columns and a point id, numbered within the track after the code's filter."""
    out = points.where(F.col(f"code{code}")) if code is not None else points
    number = F.row_number().over(track()) - 1
    out = out.withColumn("point_id", F.concat("track_id", F.lit("_P"), number.cast("string")))
    return out.join(agents, "agent_id", "left") if agents is not None else out


def to_lines(points: DataFrame, code: int | None = None) -> DataFrame:
    """A line for each track of two or more points; with a code, a row for each run of two or more points that have it."""
    key = ["agent_id", "track_no", "track_id"]
    if code is not None:
        points = runs(points, f"code{code}").where(F.col(f"code{code}"))
        key = [*key, "__run"]
    out = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"), F.count("*").alias("npoints"), F.min("seq").alias("first_seq")).where("npoints >= 2")
    return out.select("agent_id", "track_id", "npoints", "first_seq", wkt_line(F.col("p")).alias("wkt"), F.col("p").alias("vertices"))


def to_segments(points: DataFrame, method: str = "middle", columns: tuple[str, ...] = (), code: int | None = None) -> DataFrame:
    """The steps of each track, with values of the start, the end or the mean of both."""
    pick = {"forward": lambda c: F.col(c), "backward": nxt, "middle": lambda c: (F.col(c) + nxt(c)) / 2}[method]
    extra = [pick(c).alias(c) for c in columns]
    has = [(F.col(f"code{code}") | nxt(f"code{code}")).alias("__code")] if code is not None else []
    out = points.select(
        "agent_id", "track_id", F.concat("track_id", F.lit("_S"), F.col("seq").cast("string")).alias("segment_id"), F.col("x").alias("x0"), F.col("y").alias("y0"),
        nxt("x").alias("x1"), nxt("y").alias("y1"), "time", nxt("time").alias("end_time"), *extra, *has,
    ).where("x1 is not null")
    return out.where("__code").drop("__code") if has else out


def blank_raster(spark: SparkSession, x0: float, y0: float, nx: int, ny: int, dx: float, dy: float) -> DataFrame:
    """Rows (row, col, x, y, value 0); x and y are the centres of cells."""
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return cells.withColumns({"x": F.lit(float(x0)) + (F.col("col") + 0.5) * dx, "y": F.lit(float(y0)) + (F.col("row") + 0.5) * dy, "value": F.lit(0.0)})


def rasterize(points: DataFrame, x0: float, y0: float, nx: int, ny: int, dx: float, dy: float, attribute: str | None = None) -> DataFrame:
    """Rows (row, col, value): how many tracks touch a cell, or the sum of an attribute over them.

    Cells are closed: a step that only meets a border or a corner touches the cells on both sides of it, also where it
    runs along the border. A step makes the columns of its box, and in each column the rows that its piece there spans, so
    a long step makes about as many cells as it touches. A track counts once in a cell; one point alone is a step to itself.
    """
    seg = points.withColumns({"__nx": F.coalesce(nxt("x"), F.col("x")), "__ny": F.coalesce(nxt("y"), F.col("y"))})
    seg = seg.withColumns({"__dx": F.col("__nx") - F.col("x"), "__dy": F.col("__ny") - F.col("y")})

    def span(low: Column, high: Column, n: int, slack: float = 0.0) -> Column:
        """Numbers of the closed cells from low to high (in cells), those of the raster only."""
        first = F.greatest(F.ceil(low - slack) - 1, F.lit(0)).cast("int")
        last = F.least(F.floor(high + slack), F.lit(n - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    def within(start: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Shares of the step between which it lies from low to high on an axis, if it does at all."""
        a, b = (low - start) / d, (high - start) / d
        return F.when(d == 0, F.lit(0.0)).otherwise(F.least(a, b)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    cols = span((F.least("x", "__nx") - x0) / dx, (F.greatest("x", "__nx") - x0) / dx, nx)
    dealt = seg.withColumn("col", F.explode(cols))
    left = x0 + F.col("col") * dx
    enter, leave = within(F.col("x"), F.col("__dx"), left, left + dx)
    dealt = dealt.withColumns({"__in": F.greatest(enter, F.lit(0.0)), "__out": F.least(leave, F.lit(1.0))})
    ends = [(F.col("y") + F.col(t) * F.col("__dy") - y0) / dy for t in ("__in", "__out")]
    dealt = dealt.withColumn("row", F.explode(span(F.least(*ends), F.greatest(*ends), ny, 1e-9)))
    low = y0 + F.col("row") * dy
    enter, leave = within(F.col("y"), F.col("__dy"), low, low + dy)
    box = (F.least("y", "__ny") <= low + dy) & (F.greatest("y", "__ny") >= low)
    dealt = dealt.where(box & (F.greatest("__in", enter) <= F.least("__out", leave) + 1e-12))
    touched = dealt.groupBy("track_id", "row", "col").agg((F.max(attribute) if attribute else F.lit(1)).alias("__v"))
    return touched.groupBy("row", "col").agg(F.sum("__v").cast("double").alias("value"))
