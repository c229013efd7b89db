"""Renaming columns and mapping values, static and dynamic, and discovering what there is to map."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mappers import COLUMNS

def _plain(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name).lower()


def standard_columns() -> dict[str, str]:
    """Standard names by plain spelling: lower case without separators."""
    return {_plain(w): std for std, words in COLUMNS.items() for w in [std, *words]}


def column_mapper(columns: Sequence[str], fill: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """Each column's standard name, from fill (exact or plain spelling), or None."""
    fill = standard_columns() if fill is None else dict(fill)
    return {c: fill.get(c, fill.get(_plain(c))) for c in columns}


def rename(df: DataFrame, mapper: Mapping[str, str | None]) -> DataFrame:
    """Renames mapped columns; the others keep their names."""
    return df.toDF(*[mapper.get(c) or c for c in df.columns])


def lookup(column: Column, mapper: Mapping[Any, Any], miss: Column) -> Column:
    """A value's image; a miss, or an image of None, gives `miss`. For mappers that fit into a plan."""
    known = {k: v for k, v in mapper.items() if v is not None and k is not None}
    if not known:
        return miss
    pairs = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, column), miss)


def map_columns(df: DataFrame, mappers: Mapping[str, Mapping[Any, Any]], out: Mapping[str, str] | None = None, drop: bool = False, fill: Any = None) -> DataFrame:
    """Maps values of columns into columns (the same ones unless `out` names others); misses become fill."""
    for c, mapper in mappers.items():
        if c in df.columns:
            df = df.withColumn((out or {}).get(c, c), lookup(F.col(c), mapper, F.lit(fill)))
    gone = [c for c in mappers if drop and (out or {}).get(c, c) != c]
    return df.drop(*gone)


def map_by_table(df: DataFrame, column: str, table: DataFrame, out: str, fill: Any = None) -> DataFrame:
    """The same by a table (raw, mapped) of any size: a left join, which Spark broadcasts if it is small."""
    t = table.select(F.col("raw").alias("__raw"), F.col("mapped").alias("__mapped"))
    return df.join(t, F.col(column) == F.col("__raw"), "left").withColumn(out, F.coalesce("__mapped", F.lit(fill))).drop("__raw", "__mapped")


def map_to_codes(points: DataFrame, column: str, mapper: Mapping[Any, int], drop: bool = False, fill: int = -1) -> DataFrame:
    """A boolean column code<n> for each distinct code of the mapper."""
    if not all(isinstance(v, int) for v in mapper.values()):
        raise TypeError("codes must be integers")
    value = lookup(F.col(column), mapper, F.lit(fill)) if column in points.columns else F.lit(fill)
    out = points.withColumns({f"code{n}": value == n for n in sorted(set(mapper.values()))})
    return out.drop(column) if drop else out


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def values_of(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that aren't null."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def raw_value_mapper(df: DataFrame, columns: Sequence[str], fill: DataFrame | None = None) -> DataFrame:
    """Rows (column, raw, mapped): distinct values as text, with their image in fill (raw, mapped) or null."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.where("raw is not null").distinct()
    return out.withColumn("mapped", F.lit(None).cast("string")) if fill is None else out.join(fill.select("raw", "mapped"), "raw", "left").select("column", "raw", "mapped")


def parse_number(text: Column, kind: str = "int") -> Column:
    """The digits of a text (and its points, for float) as a number; 0 if there are none."""
    kept = F.regexp_replace(text, r"[^0-9.]" if kind == "float" else r"[^0-9]", "")
    return F.coalesce(kept.try_cast("double" if kind == "float" else "long"), F.lit(0).cast("double" if kind == "float" else "long"))


def standard_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(standard_columns().items()), "raw string, mapped string")
