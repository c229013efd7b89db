"""Resampling in space and time, reprojection and smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..functions.tracks import track, whole, from_micros, micros, nxt, prev, step_back

KEY = ("agent_id", "track_no", "track_id")


def _segments(points: DataFrame, at: Column, extra: Sequence[str]) -> DataFrame:
    """Points with their abscissa u and that of the next point, v, and the next point's values."""
    out = points.withColumn("__u", at)
    return out.withColumns({"__v": nxt("__u"), "__end": F.max("__u").over(whole()), "__t": micros(F.col("time")), "__nt": F.lead(micros(F.col("time"))).over(track()), **{f"__n_{c}": nxt(c) for c in ("x", "y", *extra)}})


def _fill(segments: DataFrame, w: str, extra: Sequence[str]) -> DataFrame:
    """Values at the abscissa w inside each row's segment, by straight lines; at its beginning where there is no next."""
    s = F.coalesce(F.try_divide(F.col(w) - F.col("__u"), F.col("__v") - F.col("__u")), F.lit(0.0))
    line = lambda c: F.col(c) + s * F.coalesce(F.col(f"__n_{c}") - F.col(c), F.lit(0.0))
    time = from_micros(F.round(F.col("__t") + s * F.coalesce(F.col("__nt") - F.col("__t"), F.lit(0))))
    out = segments.select(*KEY, F.col(w).alias("__w"), time.alias("time"), line("x").alias("x"), line("y").alias("y"), *[line(c).alias(c) for c in extra])
    return out.withColumn("seq", (F.row_number().over(track().partitionBy("agent_id", "track_no").orderBy("__w")) - 1).cast("int")).withColumn("tie", F.col("seq").cast("long")).drop("__w")


def _ticks(segments: DataFrame, step: float, w: str) -> DataFrame:
    """Multiples of the step that fall into [u, v) of each segment, and the last point. Each segment makes its own, so no join is needed."""
    first, last = F.ceil(F.col("__u") / step), F.ceil(F.col("__v") / step) - 1
    inner = F.when(F.col("__v") > F.col("__u"), F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * F.lit(float(step)))))
    end = F.when(F.col("__v").isNull(), F.array(F.col("__u")))
    return segments.withColumn(w, F.explode(F.coalesce(end, inner, F.array().cast("array<double>"))))


def spacing(points: DataFrame, step: float, extra: Sequence[str] = ()) -> DataFrame:
    """Points every `step` along a track, and its last one. Tracks no longer than a step keep their points."""
    run = points.withColumn("__d", F.coalesce(step_back(), F.lit(0.0))).withColumn("__d", F.sum("__d").over(track().rowsBetween(-(2**63), 0)))
    return _resampled(_segments(run, F.col("__d"), extra).drop("__d"), step, extra)


def time(points: DataFrame, seconds: float, extra: Sequence[str] = ()) -> DataFrame:
    """Points every so many seconds from a track's start, and its last one. Tracks no longer than that keep their points."""
    start = F.min(micros(F.col("time"))).over(whole())
    return _resampled(_segments(points, (micros(F.col("time")) - start) / F.lit(1e6), extra), seconds, extra)


def _resampled(segments: DataFrame, step: float, extra: Sequence[str]) -> DataFrame:
    long_ = F.col("__end") > step
    kept = segments.where(~long_).withColumn("__w", F.col("__u"))
    # points at equal abscissas of tracks that stay must not be merged: their order is kept by seq
    same = kept.select(*KEY, "time", "x", "y", *extra, "seq", F.col("seq").cast("long").alias("tie"))
    return _fill(_ticks(segments.where(long_), step, "__w"), "__w", extra).unionByName(same)


def on_axis(points: DataFrame, start_us: int, end_us: int, seconds: float, extra: Sequence[str] = ()) -> DataFrame:
    """Points at the ticks of a common time axis that a track spans; a track that spans none is put on the nearest tick."""
    step = int(seconds * 1_000_000)
    t = micros(F.col("time"))
    seg = _segments(points, t.cast("double"), extra)
    first, last = F.ceil((F.col("__u") - start_us) / step), F.ceil((F.col("__v") - start_us) / step) - 1
    ticks = lambda a, b: F.when(b >= a, F.transform(F.sequence(a, b), lambda k: (k * step + start_us).cast("double")))
    inner = F.when(F.col("__v") > F.col("__u"), ticks(first, last))
    closing = F.when(F.col("__v").isNull() & (F.pmod(F.col("__u").cast("long") - start_us, F.lit(step)) == 0), F.array("__u"))
    seg = seg.withColumn("__w", F.coalesce(inner, closing, F.array().cast("array<double>")))
    seg = seg.withColumn("__w", F.filter("__w", lambda w: w.between(start_us, end_us)))
    some = F.max(F.size("__w")).over(whole()) > 0
    seg = seg.withColumn("__some", some)
    on = _fill(seg.where("__some").withColumn("__w", F.explode("__w")), "__w", extra)
    near = F.least(F.greatest(F.ceil((F.col("__u") - start_us) / step - 0.5), F.lit(0)), F.lit((end_us - start_us) // step)) * step + start_us
    off = seg.where("not __some").withColumn("__k", near)
    # values at a tick outside the track are those of its nearer end
    best = off.groupBy(*KEY, "__k").agg(F.min_by(F.struct("x", "y", *extra), F.struct(F.abs(F.col("__u") - F.col("__k")), "seq")).alias("p"))
    snapped = best.select(*KEY, from_micros(F.col("__k")).alias("time"), "p.*")
    snapped = snapped.withColumn("seq", (F.row_number().over(track().partitionBy("agent_id", "track_no").orderBy("time")) - 1).cast("int")).withColumn("tie", F.col("seq").cast("long"))
    return on.unionByName(snapped)


def smooth_corners(points: DataFrame, refinements: int = 2) -> DataFrame:
    """Chaikin's corner cutting: every point gives two, at a quarter of the way to either neighbour; ends stay. Time goes along."""
    out = points.select(*KEY, "seq", micros(F.col("time")).cast("double").alias("__t"), "x", "y")
    for _ in range(refinements):
        cut = lambda other: F.struct(*[(F.col(c) * 0.75 + F.coalesce(other(c), F.col(c)) * 0.25).alias(c) for c in ("__t", "x", "y")])
        both = out.withColumn("__c", F.array(cut(prev), cut(nxt))).select(*KEY, "seq", F.posexplode("__c").alias("k", "p"))
        out = both.select(*KEY, (F.col("seq") * 2 + F.col("k")).alias("seq"), "p.*")
    return out.select(*KEY, F.col("seq").cast("int").alias("seq"), from_micros(F.round("__t")).alias("time"), "x", "y", F.col("seq").cast("long").alias("tie"))


R = 6378137.0


def _utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Krueger's series for the transverse Mercator projection on WGS84, to the third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a0 = R / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(al, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(al, 1))
    return 500_000 + 0.9996 * a0 * x, 0.9996 * a0 * y + (10_000_000 if south else 0)


def reproject(points: DataFrame, source: int, target: int) -> DataFrame:
    """x and y from one EPSG code to another: 4326 to and from 3857, and 4326 to UTM on WGS84 (326zz, 327zz)."""
    x, y = F.col("x"), F.col("y")
    if source == target:
        return points
    if (source, target) == (4326, 3857):
        new = F.radians(x) * R, F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * R
    elif (source, target) == (3857, 4326):
        new = F.degrees(x / R), F.degrees(2 * F.atan(F.exp(y / R)) - math.pi / 2)
    elif source == 4326 and target // 100 in (326, 327) and 1 <= target % 100 <= 60:
        new = _utm(x, y, target % 100, target // 100 == 327)
    else:
        raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}; 4326, 3857 and 4326 to UTM are known")
    return points.withColumns({"x": new[0], "y": new[1]})
