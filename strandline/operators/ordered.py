"""Running values over long ordered groups in two phases.

A window over a group is one task, however long the group. Here rows are dealt by ranges of keys and order; each part is
totalled, the few totals of a group are added up in order, and the rows of a part start from what the parts before it hold. So
a group that fills most of a table is worked on by as many tasks as it has parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import shared_table

PART, OWN = "_part", "_own"


def dealt(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """df with its part, written once so that totals and rows see the same parts. Rows of equal order share a part. Without parts, adaptive execution sizes them."""
    by = (*keys, order)
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return shared_table(ranged.withColumn(PART, F.spark_partition_id()))


def by_part(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys, PART).orderBy(order)


def with_parts(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of totals (one row per group and part); null keys are a group of their own."""
    t = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(PART).alias("_p"), *(c for c in totals.columns if c not in (*keys, PART)))
    on = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(t, on).drop("_p", *(f"_k{i}" for i in range(len(keys))))


def running_sum(parts: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """out: the sum of value over the rows before, for a frame from dealt(); nulls count 0."""
    value = F.coalesce(value, F.lit(0))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, PART).agg(F.sum(value).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum(value).over(by_part(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return with_parts(parts, totals, keys).withColumn(out, (F.col("_before") + inside).cast("long")).drop("_before")


def last_known(parts: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """out: the last value that is not null at or before each row; order may go on within rows of equal first order."""
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    d = parts.withColumn("_v", value)
    totals = d.groupBy(*keys, PART).agg(F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_t")).withColumn("_before", F.last("_t", True).over(before)).drop("_t")
    inside = F.last("_v", True).over(Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return with_parts(d, totals, keys).withColumn(out, F.coalesce(inside, F.col("_before"))).drop("_before", "_v")


def next_values(parts: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """next_<column> of the row after each, in the part or at the head of the next one; null at the end of a group."""
    heads = parts.groupBy(*keys, PART).agg(F.min_by(F.struct(*columns), order).alias("_h"))
    heads = heads.withColumn("_after", F.lead("_h").over(Window.partitionBy(*keys).orderBy(PART))).drop("_h")
    d = with_parts(parts.withColumn("_row", F.struct(*columns)), heads, keys)
    d = d.withColumn("_n", F.coalesce(F.lead("_row").over(by_part(keys, order)), F.col("_after")))
    return d.select(*(c for c in parts.columns), *(F.col(f"_n.{c}").alias(f"next_{c}") for c in columns))


def halo(df: DataFrame, keys: list[str], order: str, reach: int, part_rows: int = 1 << 16) -> DataFrame:
    """df cut into parts of part_rows values of order, each with copies of the rows up to reach before and after it; OWN marks a part's own rows.

    order is a whole number. What a row needs from rows at most reach away can then be a window over keys and PART, however long a group.
    """
    size = max(part_rows, reach, 1)
    own = F.floor(F.col(order) / size)
    within = F.pmod(F.col(order), F.lit(size))
    parts = F.array_compact(F.array(own, F.when(within < reach, own - 1), F.when(within >= size - reach, own + 1)))
    return df.withColumn(PART, F.explode(parts)).withColumn(OWN, own == F.col(PART))
