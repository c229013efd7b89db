"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given as knots (time, weight) joined by straight
lines. Its integral is the source's overall weight; weights share a token budget, but no source gets more
than `repeats` times what it has (the excess goes to the others by weight). A source's documents are put in
the order of a hash and repeated end to end; the running token count is inverted through the source's
cumulative demand to a training position, and documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, bounded_broadcast, documents, stage

#: Weights by a source's rank, repeated; and how each schedule leans (integrals stay as given).
WEIGHTS, LEAN = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5)


def leaning(rank: int, weights: Sequence[float] = WEIGHTS, lean: Sequence[float] = LEAN) -> list[tuple[float, float]]:
    """Knots of a schedule that falls, stays or rises over time around the weight of this rank."""
    w, a = weights[rank % len(weights)], lean[rank % len(lean)]
    return [(0.0, w * (1 + a)), (1.0, w * (1 - a))]


def _integrals(cycle: list[list[tuple[float, float]]]) -> list[list[dict]]:
    """Linear pieces of each schedule: start and end time, start weight, slope, integral before and in all."""
    out = []
    for knots in cycle:
        at, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            pieces.append([t0, t1, w0, (w1 - w0) / (t1 - t0), at])
            at += (w0 + w1) / 2 * (t1 - t0)
        if at <= 0 or any(w < 0 for _, w in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
            raise ValueError("a schedule must cover 0..1 with weights that are not negative and not all 0")
        out.append([dict(zip(("t0", "t1", "w0", "slope", "before"), p)) | {"whole": at} for p in pieces])
    return out


def targets(per_source: DataFrame, pieces: list[list[dict]], share: float, repeats: float) -> DataFrame:
    """Adds rank, weight, target and cycle index to rows (source, source_size): water-filling in closed form.

    Sources are ordered by how soon they fill (repeats * size / weight). Up to the first that does not
    fill at the level the rest would get, all are full; the rest share what is left by weight.
    """
    n = len(pieces)
    ranked = per_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    whole = F.array(*[F.lit(p[0]["whole"]) for p in pieces])
    ranked = ranked.withColumns({"cycle": (F.col("rank") % n).cast("int"), "cap": repeats * F.col("source_size")})
    ranked = ranked.withColumn("weight", F.element_at(whole, F.col("cycle") + 1))
    ranked = ranked.withColumn("full_at", F.try_divide("cap", "weight"))
    fill = W.orderBy(F.col("full_at").asc_nulls_last(), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy(F.lit(1))
    ranked = ranked.withColumns({
        "cap_before": F.sum("cap").over(fill) - F.col("cap"),
        "weight_left": F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"),
        "budget": share * F.sum("source_size").over(everything),
    })
    level = F.try_divide(F.col("budget") - F.col("cap_before"), F.col("weight_left"))
    ranked = ranked.withColumns({"level": level, "nth": F.row_number().over(W.orderBy(F.col("full_at").asc_nulls_last(), "rank"))})
    first_open = F.min(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.struct("nth", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(F.col("weight") * first_open, F.col("cap")))
    return ranked.select("source", "source_size", "cycle", F.greatest(F.lit(0.0), target).alias("target"))


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    schedule: Callable[[int], list[tuple[float, float]]] = leaning,
    cycle: int = 3,
    share: float = 1.5,
    repeats: int = 2,
    per_bucket: int = 20_000,
) -> DataFrame:
    """Rows (doc, source, size, source_size, target, taken, parts, positions): what the mix takes of each document.

    docs has doc_id, source and text; `doc` is a struct of the columns named in keep, others are ignored.
    Null sources form one source, ranked last; null texts have size 0. Documents of size 0 are taken 0 words
    and have no positions. A document may be taken in part at its source's end, so that a source's taken words
    equal its target to the word. Repeated rows are separate documents. An empty table gives an empty table.
    Reruns agree: order depends on hashes alone. A hot source is split by hash into buckets whose sums are
    pre-aggregated; the running sum is made inside buckets, which bounds the rows that meet in a task.
    """
    pieces = _integrals([schedule(k) for k in range(cycle)])
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("row"),
    )
    if "text" not in keep:
        sized = stage(sized, "sizes")
    bits = max(8, min(14, (sized.count() // per_bucket).bit_length()))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("row", 64 - bits).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    shares = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), pieces, share, repeats)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.withColumn("bucket_start", F.sum("bucket_size").over(before) - F.col("bucket_size"))
    starts = starts.join(F.broadcast(shares) if shares.count() <= 100_000 else shares, starts.source.eqNullSafe(shares.source)).drop(shares.source)
    starts = stage(starts.select("source", "bucket", "bucket_start", "source_size", "target", "cycle"), "starts")
    order = W.partitionBy("source", "bucket").orderBy("row", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = sized.withColumn("in_bucket", F.sum("size").over(order) - F.col("size"))
    at = bounded_broadcast(starts)
    placed = placed.join(at, placed.source.eqNullSafe(at.source) & (placed.bucket == at.bucket)).drop(at.source, at.bucket)
    start = F.col("bucket_start") + F.col("in_bucket")
    wanted = F.round("target").cast("long")
    offsets = [start + k * F.col("source_size") for k in range(repeats)]
    parts = F.array(*[F.greatest(F.lit(0), F.least(o + F.col("size"), wanted) - o) for o in offsets])
    table = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in ps]) for ps in pieces])

    def position(offset):
        """Training time at which the source's demand reaches this token."""
        mine = F.element_at(table, F.col("cycle") + 1)
        x = F.try_divide(offset.cast("double"), F.col("target")) * mine[0]["whole"]
        p = F.element_at(F.filter(mine, lambda s: s["before"] <= x), -1)
        need = x - p["before"]
        root = F.sqrt(F.greatest(F.lit(0.0), p["w0"] * p["w0"] + 2 * p["slope"] * need))
        return F.least(p["t1"], p["t0"] + F.coalesce(F.try_divide(2 * need, p["w0"] + root), F.lit(0.0)))

    spots = F.array(*[F.when((o < wanted) & (F.col("size") > 0), position(o)) for o in offsets])
    return placed.select(
        "doc", "source", "size", "source_size", "target",
        F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        F.filter(spots, lambda p: p.isNotNull()).alias("positions"), parts.alias("parts"),
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document's columns, once for each time it is taken, range-sorted by position.

    A last taking that is less than half of a document is left out, one of half or more is whole.
    """
    mixed = mix(docs, keep=docs.columns, **options)
    taken = F.filter(F.arrays_zip("positions", "parts"), lambda z: z["positions"].isNotNull() & (2 * z["parts"] >= F.col("size")))
    once = mixed.select("doc", F.explode(taken).alias("z")).select("doc", F.col("z.positions").alias("position"))
    sort = once.repartitionByRange(F.col("position")).sortWithinPartitions("position")
    return sort.select("doc.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0))
    rows = mixed.select("doc.doc_id", "size", "source_size", "target", "taken", first.alias("position"), F.get("positions", F.lit(1)).alias("position_again"))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
