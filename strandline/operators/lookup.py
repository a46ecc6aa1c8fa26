"""Lookups in ordered data: as-of, adjacent pairs, semi and anti, distinct by first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered


def as_of(df: DataFrame, keys: list[str], order: list[str], match: Column, value: Column, out: str) -> DataFrame:
    """out: value of the last row of the group at or before this one where match holds, in two phases, so a long group is many tasks."""
    return ordered.last_known(ordered.dealt(df, keys, order[0]), keys, order, F.when(match, value), out).drop(ordered.PART)


def page_at(offsets: DataFrame, points: DataFrame, keys: list[str], offset: str, point: str, value: str) -> DataFrame:
    """points with value of the last offset at or below point: both sides in one order instead of a range join, in two phases. Of equal offsets the greatest value."""
    a = offsets.select(*keys, F.col(offset).alias("_at"), F.lit(0).alias("_side"), F.col(value), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in keys))
    b = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(offsets.schema[value].dataType).alias(value), *(c for c in points.columns if c not in keys))
    both = ordered.last_known(ordered.dealt(a.unionByName(b), keys, "_at"), keys, ["_at", "_side", value], F.col(value), "_found")
    return both.where("_side = 1").drop("_at", "_side", ordered.PART, value).withColumnRenamed("_found", value)


def adjacent_pairs(df: DataFrame, keys: list[str], order: str, linked: Column, columns: list[str]) -> DataFrame:
    """keys, a, b: order of each row and the next where linked holds; linked sees columns, and the next row's as next_<column>."""
    picked = list(dict.fromkeys([*keys, order, *columns]))
    d = ordered.next_values(ordered.dealt(df.select(*picked), keys, order), keys, order, list(dict.fromkeys([*columns, order])))
    return d.where(F.col(f"next_{order}").isNotNull() & linked).select(*keys, F.col(order).alias("a"), F.col(f"next_{order}").alias("b"))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order: what a map built row by row would hold."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def referenced_only(df: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    return df.join(refs.select(*on).distinct(), on, "left_semi")


def unreferenced(df: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    return df.join(refs.select(*on), on, "left_anti")


def first_of_each(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row, in order, of each value of by; aggregated before the shuffle, unlike row_number()."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), order).alias("r")).select(*by, "r.*").select(*df.columns)


def append(*frames: DataFrame) -> DataFrame:
    """All rows, those of the first frame first by the column part."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered; every task keeps at most n a group before the shuffle (Spark's limit below a ranking window)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)
