"""What the operators of this subpackage share: words, the shared folder, bounded broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space; bytes.split() splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch: texts may be very long, and a batch is held as a whole on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, UPPER, UPPER.lower())


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text modulo mod; null keys count as -1, which is no fold."""
    return F.coalesce(F.crc32(key.cast("string")) % mod, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside spark.checkpoint.dir. Where that is unset a temporary one serves, in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf:
        conf = f"file://{tempfile.gettempdir()}/movespark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    root = f"{conf.rstrip('/')}/movespark-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, survives lost executors.

    What was shuffled for it isn't needed again, so its files go when it is written.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later step reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marks a staged or small table for broadcast if a count shows that it has few rows; else it is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(df: DataFrame, per_task: int, least: int = 1) -> int:
    """Tasks for a table of so many rows at so many rows a task."""
    return max(least, -(-df.count() // per_task))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component being the smallest node.

    Alternating large-star and small-star steps over distinct links, each round staged in the shared folder.
    A node with very many neighbours is pre-aggregated to its smallest neighbour (a partial aggregate), and
    the join that spreads this minimum is an equi-join that adaptive execution may split.
    Nulls in a or b and self-links are ignored; an empty table gives an empty table.
    """
    edges = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is hung on the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node itself, on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = stage(small, "links")
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        discard(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def in_pieces(rows: DataFrame, key: str, piece: int = 2048) -> DataFrame:
    """Deals keys with over `piece` rows (key, node) into pairs of pieces, so that no task compares many more: adds i and j (i = j in whole keys) and mine, the row's piece."""
    big = rows.groupBy(key).count().where(F.col("count") > piece).select(key, F.ceil(F.col("count") / piece).cast("int").alias("g"))
    rows = rows.join(bounded_broadcast(big), key, "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(11)), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    return rows.withColumn("other", other).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("g", "other")


def give_back(collect: bool = True) -> None:
    """Returns freed memory to the system, which Python processes, and Arrow's pool in them, else keep."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work for mapInArrow, giving memory back before and after: Python workers serve one stage after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(collect=False)  # what an earlier task was sent is freed by now
        yield from work(batches)
        give_back()

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, z in zip(edges, edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Sets of nodes that are merged; stars() tells them as (smallest node, node)."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    def merge(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(r, x) for x in self.up if (r := self.root(x)) != x]
        return [r for r, _ in pairs], [x for _, x in pairs]
