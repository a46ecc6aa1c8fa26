"""Masks over ordered rows: dilation, islands, sessions, zones, algebra.

All are window expressions partitioned by keys; without keys a window would be one task, so keys are required. What depends on rows near by only
takes part_rows: then order counts rows from 0, and a long group is worked on in parts that hold copies of their neighbours' edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered


def _by(keys: list[str], order: str) -> Window:
    if not keys:
        raise ValueError("keys are needed: a window without them is one task")
    return Window.partitionBy(*keys).orderBy(order)


def in_parts(df: DataFrame, keys: list[str], order: str, reach: int, part_rows: int, work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """work(frame, keys) on parts of long groups that hold copies of reach rows of their neighbours; the copies are left out of what it gives."""
    d = work(ordered.halo(df, keys, order, reach, part_rows), [*keys, ordered.PART])
    return d.where(ordered.OWN).drop(ordered.OWN, ordered.PART)


def dilate(df: DataFrame, keys: list[str], order: str, mask: str, margin: int, out: str = "blocked", part_rows: int | None = None) -> DataFrame:
    """out: a true row lies within margin rows."""
    if part_rows:
        return in_parts(df, keys, order, margin, part_rows, lambda d, k: dilate(d, k, order, mask, margin, out))
    return df.withColumn(out, F.max(mask).over(_by(keys, order).rowsBetween(-margin, margin)))


def islands(df: DataFrame, keys: list[str], order: str, keep: Column, least: int = 1) -> DataFrame:
    """keys, start, end (exclusive), size: maximal runs of rows where keep holds, of at least least rows. order counts rows from 0 without gaps."""
    _by(keys, order)
    # numbered in two phases, so a long group is many tasks
    d = ordered.running_sum(ordered.dealt(df.where(keep).select(*keys, order), keys, order), keys, order, F.lit(1), "_n").withColumn("_g", F.col(order) - F.col("_n"))
    return d.groupBy(*keys, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).withColumn("size", F.col("end") - F.col("start")).where(F.col("size") >= least).drop("_g")


def safe_bands(df: DataFrame, keys: list[str], order: str, busy: str, margin: int, least: int, part_rows: int | None = None) -> DataFrame:
    """Islands of rows that no busy row comes within margin of."""
    return islands(dilate(df, keys, order, busy, margin, "_b", part_rows), keys, order, ~F.col("_b"), least)


def sessionise(df: DataFrame, keys: list[str], order: str, mask: str, gap: int) -> DataFrame:
    """keys, first, last: groups of true rows with at most gap other rows between neighbours."""
    _by(keys, order)
    # a row after which a session ends counts for all rows after it; in two phases, so a long group is many tasks
    d = ordered.next_values(ordered.dealt(df.where(F.col(mask)).select(*keys, order), keys, order), keys, order, [order])
    d = ordered.running_sum(d, keys, order, (F.col(f"next_{order}") - F.col(order) - 1 > gap).cast("int"), "_s")
    return d.groupBy(*keys, "_s").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_s")


def zones(df: DataFrame, keys: list[str], order: str, mask: str, gap: int = 16, expand: int = 12, out: str = "zone", part_rows: int | None = None) -> DataFrame:
    """out: the row lies in a session widened by expand on both sides; sessions of one row aren't widened.

    Sessions are never joined back by range: each row looks at the last session row at or before it and the first at or after it.
    """
    if part_rows:  # a row within expand of a true one, which has another within gap
        return in_parts(df, keys, order, gap + expand + 2, part_rows, lambda d, k: zones(d, k, order, mask, gap, expand, out))
    # what follows is looked for from the end: a frame that ends with the group is gone through anew for each row
    w, up = _by(keys, order), Window.partitionBy(*keys).orderBy(F.col(order).desc())
    d = df.withColumn("_m", F.when(F.col(mask), F.col(order)))
    before, after = (F.last("_m", True).over(x.rowsBetween(Window.unboundedPreceding, 0)) for x in (w, up))
    d = d.withColumn("_p", before).withColumn("_q", after)
    pp, nn = (F.last("_m", True).over(x.rowsBetween(Window.unboundedPreceding, -1)) for x in (w, up))
    linked = F.col(mask) & ((F.col(order) - pp - 1 <= gap) | (nn - F.col(order) - 1 <= gap))
    d = d.withColumn("_wide", F.coalesce(linked, F.lit(False)))
    # whether the neighbouring true rows belong to sessions of more than one row
    d = d.withColumn("_pw", F.last(F.when(F.col("_m").isNotNull(), F.col("_wide")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_qw", F.last(F.when(F.col("_m").isNotNull(), F.col("_wide")), True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("_q") - F.col("_p") - 1 <= gap
    widened = lambda wide, distance: F.coalesce(F.col(wide) & (distance <= expand), F.lit(False))
    hit = F.col(mask) | F.coalesce(inside, F.lit(False)) | widened("_pw", F.col(order) - F.col("_p")) | widened("_qw", F.col("_q") - F.col(order))
    return d.withColumn(out, hit).drop("_m", "_p", "_q", "_pw", "_qw", "_wide")


def both(a: str, b: str) -> Column:
    return F.col(a) & F.col(b)


def either(a: str, b: str) -> Column:
    return F.col(a) | F.col(b)


def percent_true(mask: str) -> Column:
    """Aggregate: share of true rows, in whole percent, rounded down."""
    return (F.count_if(F.col(mask)) * 100 / F.greatest(F.count("*"), F.lit(1))).cast("long")


def nearest_free(df: DataFrame, keys: list[str], order: str, blocked: str, most: int | None = None) -> DataFrame:
    """Adds nearest: the closest free row of the group, of equal distances the lower one; null beyond most rows away. In two phases each way, so a long group is many tasks."""
    _by(keys, order)
    free = F.when(~F.col(blocked), F.col(order))
    d = ordered.last_known(ordered.dealt(df, keys, order), keys, [order], free, "_d").drop(ordered.PART).withColumn("_back", -F.col(order))
    d = ordered.last_known(ordered.dealt(d, keys, "_back"), keys, ["_back"], free, "_u").drop(ordered.PART, "_back")
    pick = F.when(F.col("_u").isNull() | (F.col(order) - F.col("_d") <= F.col("_u") - F.col(order)), F.col("_d")).otherwise(F.col("_u"))
    d = d.withColumn("nearest", pick).drop("_d", "_u")
    return d if most is None else d.withColumn("nearest", F.when(F.abs(F.col("nearest") - F.col(order)) <= most, F.col("nearest")))
