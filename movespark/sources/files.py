"""Reading raw rows and writing data sets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application in spark.checkpoint.dir, or in local mode, where that is unset, in the temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.gettempdir()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


#: Lines that don't fit are kept in this column.
BAD = "_corrupt_record"


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ",", keep_bad: bool = False, header: bool = True) -> DataFrame:
    """CSV files, by default with a header, as text columns, so that files agree in types.

    Lines of another number of fields are left out, or with keep_bad kept: as text in the column BAD, null for the others.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD]])
    rows = spark.read.option("columnPruning", "false").csv(paths if isinstance(paths, str) else list(paths), schema=schema, header=header, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True)
    # Spark reads no query of the bad lines alone: the second condition, which always holds, asks for a column of the file too
    return rows if keep_bad else rows.where(F.col(BAD).isNull() & F.coalesce(F.length(columns[0]) >= 0, F.lit(True))).drop(BAD)


def bad_lines(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Rows (file, lines, bad, unkeyed): how many lines each file has, how many of them read_csv leaves out, and how many lack the first column."""
    rows = read_csv(spark, paths, columns, sep, keep_bad=True).select(F.input_file_name().alias("file"), F.col(BAD).isNotNull().cast("long").alias("bad"), *columns)
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.sum("bad").alias("bad"), F.sum(F.col(columns[0]).isNull().cast("long")).alias("unkeyed"))


def read_any(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Parquet, ORC, JSON or CSV files by their ending; files of different columns are combined by name."""
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        kind = p.rstrip("/").rsplit(".", 1)[-1].lower()
        one = {"parquet": spark.read.parquet, "orc": spark.read.orc, "json": spark.read.json}.get(kind, lambda q: spark.read.csv(q, header=True, sep=sep))(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def _bucket(agent: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(agent), F.lit(buckets))


def write_points(points: DataFrame, path: str, buckets: int | None = None, mode: str = "errorifexists", per_bucket: int = 20_000_000) -> None:
    """Parquet in folders by hash of the agent, each sorted by agent, so that reading some agents prunes.

    Without a number of buckets there are as many as hold per_bucket points each. Each is written by several tasks, that
    agents are dealt to, so none has more than an agent's or a small part of a bucket's points. The number stands in the
    folders' names.
    """
    if buckets is None:
        buckets = max(1, -(-points.count() // per_bucket))
    out = points.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.col("agent_id"), buckets)})
    deal = F.pmod(F.xxhash64("agent_id", F.lit(7)), F.lit(8))
    out.repartition("bucket", deal).sortWithinPartitions("bucket", "agent_id", "time").write.partitionBy("buckets", "bucket").mode(mode).parquet(path)


def read_points(spark: SparkSession, path: str, agents: Sequence[str] | None = None) -> DataFrame:
    """The points, or those of some agents; then only their folders are read."""
    out = spark.read.parquet(path)
    if agents is not None:
        numbers = [r.buckets for r in out.select("buckets").distinct().collect()]
        ids = spark.createDataFrame([(a,) for a in agents], "a string")
        mine = F.lit(False)
        for n in numbers:
            hit = [r.b for r in ids.select(_bucket(F.col("a"), n).alias("b")).distinct().collect()]
            mine = mine | ((F.col("buckets") == n) & F.col("bucket").isin(hit))
        out = out.where(mine & F.col("agent_id").isin(list(agents)))
    return out.drop("buckets", "bucket")
