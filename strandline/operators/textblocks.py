"""Blocks of recognised text lines, and the rows they cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.operators.folds import fold_sorted


def blocks_of(lines: Iterator[tuple], factor: float = 5.0, overlap: float = 0.3, pad: int = 10, single: tuple[int, int] = (8, 40)) -> Iterator[tuple[int, int, int]]:
    """(first row, last row, lines) of blocks of lines (top, bottom, left, right), sorted by top; a divider is (row, null, null, null), before a line of its row.

    A line joins the block above if the gap is at most factor times the taller height, they overlap sideways by more than overlap of the narrower, and
    no divider lies between. Blocks of several lines are widened by pad; a single one by its height within bounds.
    """
    held: list | None = None  # top, bottom, left, right, tallest, count
    divider = -1  # the last one seen

    def done() -> tuple[int, int, int]:
        by = pad if held[5] > 1 else min(max(held[4], single[0]), single[1])
        return max(0, held[0] - by), held[1] + by, held[5]

    for top, bottom, left, right in lines:
        if bottom is None:
            divider = top
            continue
        high = max(1, bottom - top)
        if held:
            narrow = max(1, min(held[3] - held[2], right - left))
            close = top - held[1] <= int(factor * max(held[4], high))
            aligned = (min(held[3], right) - max(held[2], left)) / narrow > overlap
            if close and aligned and divider < held[1]:
                held = [held[0], max(held[1], bottom), min(held[2], left), max(held[3], right), max(held[4], high), held[5] + 1]
                continue
            yield done()
        held = [top, bottom, left, right, high, 1]
    if held:
        yield done()


def text_blocks(df: DataFrame, keys: list[str], top: str = "top", bottom: str = "bottom", left: str = "left", right: str = "right", dividers: DataFrame | None = None) -> DataFrame:
    """keys, first, last, lines: blocks of each group's text lines. dividers: keys and top of each group's divider rows.

    Lines with a null edge are left out.
    """
    d = df.select(*keys, F.col(top).alias("_t"), F.col(bottom).alias("_b"), F.col(left).alias("_l"), F.col(right).alias("_r")).dropna(subset=["_t", "_b", "_l", "_r"]).withColumn("_k", F.lit(1))
    if dividers is not None:
        d = d.unionByName(dividers.select(*keys, F.col(top).alias("_t"), F.lit(0).alias("_k")), allowMissingColumns=True)
    return fold_sorted(d, keys, ["_t", "_k"], ["_t", "_b", "_l", "_r"], blocks_of, "first long, last long, lines long")


def is_divider(structured: Column, longest: Column, width: Column) -> Column:
    """Whether a row is a level line that parts blocks: unstructured, with a dark run of a quarter of the width."""
    return ~F.coalesce(structured, F.lit(False)) & (longest >= F.floor(width / 4))


def text_rows(rows: DataFrame, lines: DataFrame, keys: list[str], order: str, structured: str = "structured", longest: str = "max_run", width: str = "width", out: str = "text") -> DataFrame:
    """rows (keys, order, the row's profile and width) with out: a block of text lines covers the row.

    lines: keys, top, bottom, left, right in the rows' coordinates. Divider rows come from the profiles. A block's ends are events, +1 where it begins
    and -1 after its last row, dealt among the rows: a row is covered if the events before it add up to more than 0. So nothing is joined by range,
    and a long group is worked on in parts. Blocks that reach beyond the rows cover what is there. Lines with a null edge count as none.
    """
    dividers = rows.where(is_divider(F.col(structured), F.col(longest), F.col(width))).select(*keys, F.col(order).cast("long").alias("top"))
    blocks = text_blocks(lines.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("top", "bottom", "left", "right"))), keys, dividers=dividers)
    ends = blocks.select(*keys, F.explode(F.array(F.struct(F.col("first").alias("_at"), F.lit(1).alias("_d")), F.struct((F.col("last") + 1).alias("_at"), F.lit(-1).alias("_d")))).alias("e"))
    # events stand before the row of their number
    events = ends.select(*keys, (2 * F.col("e._at")).cast("long").alias("_o"), F.col("e._d").alias("_d"))
    mine = rows.withColumn("_o", (2 * F.col(order) + 1).cast("long")).withColumn("_d", F.lit(0)).withColumn("_row", F.lit(True))
    both = mine.unionByName(events, allowMissingColumns=True)
    swept = ordered.running_sum(ordered.dealt(both, keys, "_o"), keys, "_o", F.col("_d"), "_n")
    return swept.where("_row").withColumn(out, F.col("_n") > 0).select(*rows.columns, out)


def covered(lines: np.ndarray, structured: np.ndarray, longest: np.ndarray, width: int) -> np.ndarray:
    """The rows of a patch that blocks of lines (top, bottom, left, right, cut to the patch) cover; the array form of text_rows() for one patch."""
    h = len(structured)
    out = np.zeros(h, dtype=bool)
    marks = [(int(y), None, None, None) for y in np.flatnonzero(~structured & (longest >= width // 4))]
    edges = np.clip(lines, [0, 0, 0, 0], [h - 1, h - 1, width - 1, width - 1]).tolist()
    for first, last, _ in blocks_of(iter(sorted([*marks, *map(tuple, edges)], key=lambda r: (r[0], r[1] is not None)))):
        out[first : last + 1] = True
    return out
