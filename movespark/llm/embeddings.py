"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random to pairs of 8-dimensional points, which are decoded to the nearest points of
the E8 lattice. Two vectors meet in a table if one's cell is the other's, or among the neighbouring cells that the
other comes closest to. Cosines decide in double precision. A cell tells only a spanning forest of
the links in it, so its output is linear; the links themselves are counted inside components, where all of
them lie, block by block. Equal vectors are one node from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, in_pieces, runs, stage

#: Hash tables, lattice points of a key, projection scale, and neighbouring cells probed in each table. Measured
#: on random pairs of cosine 0.93 exactly, 64 dimensions: at least 99 % meet; pairs of larger cosine meet more often.
TABLES, POINTS, SCALE, PROBES = 6, 2, 2.2, 6
_LEAST = np.array(
    [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    + [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0], float
)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    off, odd = x - r, r.sum(1) % 2 != 0
    k = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by one half in each coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hash(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64 bits of rows of half-integers; salt is per row."""
    h = salt.astype(np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ (2 * points[:, k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def cells(x: np.ndarray, label: np.ndarray, seed: int = 7) -> Iterator[np.ndarray]:
    """Per table, keys (rows, 1 + PROBES): the vector's own cell, then those it comes closest to."""
    rng, n = np.random.default_rng(seed), len(x)
    for t in range(TABLES):
        at, near = [], []
        for _ in range(POINTS):
            p = x @ (rng.normal(size=(x.shape[1], 8)) / SCALE)
            q = nearest_e8(p)
            at.append(q)
            near.append((p - q) @ _LEAST.T)
        salt = label.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + np.uint64(t + 1)
        own = np.concatenate(at, 1)
        keys = [_hash(own, salt)]
        gain = np.concatenate(near, 1)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for k in range(PROBES):
            point, step = best[:, k] // len(_LEAST), best[:, k] % len(_LEAST)
            moved = own.reshape(n, POINTS, 8).copy()
            moved[np.arange(n), point] += _LEAST[step]
            keys.append(_hash(moved.reshape(n, -1), salt))
        yield np.stack(keys, 1).view(np.int64)


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.flatten() if isinstance(vectors, pa.Array) else vectors.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_copies(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null. Those that are null, empty or zero, or hold null or
    non-finite components, link with nothing: no links, their own component, kept. So do vectors whose number of
    dimensions differs. Vectors of equal 64-bit hash of label and components are taken for equal, and link. Repeated rows are separate vectors. Null ids stay null and
    name a component only if it has no other. Other columns are ignored; an empty table gives an empty one.
    """
    # components stay as exact as they come; labels that are no numbers are told apart by a hash of 64 bits, as vectors are
    exact = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "double"
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, T.IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{exact}>").alias("embedding"), label.alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    nodes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = stage(nodes.withColumn("node", F.xxhash64("label", "embedding")), "nodes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                for lo in range(0, part.num_rows, 4096):
                    p = part.slice(lo, 4096)
                    label = p.column("label").to_numpy() * 4099 + d
                    for key in cells(_unit(p.column("embedding")), label):
                        # a row goes to each of its cells once
                        flat, who = key.ravel(), np.repeat(np.arange(p.num_rows), key.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(flat), p.column("node").take(pa.array(who))], names=["cell", "node"])

    wanted = nodes.select("node", "label", "embedding")
    met = wanted.mapInArrow(keys, "cell long, node long")
    met = stage(met, "cells")
    # cells of one vector are of no use
    shared = met.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("cell")
    met = in_pieces(met.join(shared, "cell").distinct(), "cell").join(wanted.select("node", "embedding"), "node")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["cell", "i", "j"]):
            if run.num_rows < 2 or len(set(run.column("embedding").combine_chunks().value_lengths().to_pylist())) > 1:
                continue
            x, who = _unit(run.column("embedding")), run.column("node").to_numpy()
            root = np.arange(len(x))
            links = []
            left = np.ones(len(x), bool)
            # grow each tree from a vector at a time; a vector is looked at once
            for s in range(len(x)):
                if not left[s]:
                    continue
                left[s], front = False, np.array([s])
                while len(front):
                    rest = np.flatnonzero(left)
                    if not len(rest):
                        break
                    hit = x[front[:256]] @ x[rest].T >= least
                    found = hit.any(0)
                    links += zip(who[front[:256][hit[:, found].argmax(0)]].tolist(), who[rest[found]].tolist())
                    left[rest[found]] = False
                    front = np.concatenate([front[256:], rest[found]])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    rows_of = met.select("cell", "i", "j", "node", "embedding").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    comps = stage(components(rows_of.mapInArrow(forest, "a long, b long")), "components")

    inside = in_pieces(comps.withColumnRenamed("component", "of"), "of").join(nodes.select("node", "embedding", "copies"), "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["of", "i", "j"]):
            x, mine, copies = _unit(run.column("embedding")), run.column("mine").to_numpy(), run.column("copies").to_numpy()
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            n = np.zeros(len(x), np.int64)
            for lo in range(0, len(x), 512):
                hit = x[lo : lo + 512] @ x.T >= least
                hit[np.arange(hit.shape[0]), np.arange(lo, lo + hit.shape[0])] = False
                if i != j:
                    hit &= mine[lo : lo + 512, None] != mine[None]
                n[lo : lo + 512] = hit @ copies
            yield pa.RecordBatch.from_arrays([run.column("node").combine_chunks(), pa.array(n)], names=["node", "n"])

    rows_in = inside.select("of", "i", "j", "mine", "node", "embedding", "copies").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j")
    counted = rows_in.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    least_id = comps.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    linked = comps.join(least_id, "component").join(counted, "node", "left").select("node", "least", F.coalesce("n", F.lit(0)).alias("n"))
    known = nodes.join(linked, "node", "left").select(
        "node", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    known = stage(known, "known")
    named = rows.select("vec_id", F.when(good, F.xxhash64("label", "embedding")).alias("node")).join(known, "node", "left")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
