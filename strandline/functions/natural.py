"""Natural order of names: digit runs that fit 64 bits by value, longer ones after them as text, other text without regard to case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sorts as natural order does. Text that sorts before digits, digits, and other text are classes 0, 1, 2; equal keys keep any tie-break that follows."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)

    def one(x: Column) -> Column:
        digits = F.rlike(x, F.lit("^[0-9]+$"))
        kind = F.when(digits, 1).when(F.lower(x) < "0", 0).otherwise(2)
        number = x.try_cast("bigint")
        return F.struct(kind.alias("kind"), F.when(digits, F.coalesce(number, F.lit((1 << 63) - 1))).alias("number"), F.when(digits & number.isNotNull(), F.lit("")).otherwise(F.lower(x)).alias("text"))

    return F.transform(parts, one)
