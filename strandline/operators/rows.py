"""Row profiles: how busy, inked and structured each row of pixels is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import pixels
from strandline.operators.masks import in_parts
from strandline.runtime import ship

DEVIATION, STRUCTURED_RUNS, STRUCTURED_RUN = 16, 3, 4


def dark_runs(lum: np.ndarray, low: int) -> tuple[int, int]:
    """(number, longest) of runs of values within DEVIATION of the darkest."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (lum <= low + DEVIATION).astype(np.int8), [0]])))
    sizes = edge[1::2] - edge[::2]
    return len(sizes), int(sizes.max(initial=0))


def profile_row(lum: np.ndarray, edge: int = 24, spread: int = 40, border: float = 0.02, noise: int = 1) -> tuple[bool, int, bool, int]:
    """(busy, ink, structured, longest dark run) of a row of luminances, without its borders.

    Busy: steps above edge, or a wide range with a step, or a faint population away from the median that is central or faces a
    dominant one.
    """
    w = len(lum)
    if not w:
        return False, 0, False, 0
    x0 = min(max(int(np.float32(w) * np.float32(border)), 0), w - 1)
    v = lum[x0 : min(max(w - x0, x0 + 1), w)].astype(np.int64)
    n = len(v)
    ink = int((np.abs(np.diff(v)) > edge).sum())
    low, high = int(v.min()), int(v.max())
    busy = ink > noise or (high - low > spread and ink > 0)
    if not busy:
        away = np.abs(v - np.sort(v)[n // 2]) > DEVIATION
        dev, central = int(away.sum()), int(away[n // 4 : n - n // 4].sum())
        busy = dev > max(2, n // 100) and (4 * central >= dev or 5 * int(np.bincount(v).max()) >= 2 * n)
    if not busy:
        return False, ink, False, 0
    count, longest = dark_runs(v, low)
    return True, ink, count >= STRUCTURED_RUNS and longest >= STRUCTURED_RUN, longest


def luma_of(px: np.ndarray) -> np.ndarray:
    return (((px >> 16) & 255) * 77 + ((px >> 8) & 255) * 150 + (px & 255) * 29) >> 8


def row_profile(df: DataFrame, lum: str, edge: int = 24, spread: int = 40, border: float = 0.02, noise: int = 1) -> DataFrame:
    """Adds busy, ink, structured, max_run for the array of luminances in column lum."""
    ship(df.sparkSession)

    @F.pandas_udf("busy boolean, ink int, structured boolean, max_run int")
    def scan(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profile_row(np.asarray([] if r is None else r, dtype=np.int64), edge, spread, border, noise) for r in rows], columns=["busy", "ink", "structured", "max_run"])

    return df.withColumn("_p", scan(lum)).select("*", "_p.*").drop("_p")


def _far(lum: str, other: Column, tau: int, margin: int = 0) -> Column:
    """Whether a pixel, margins aside, differs by more than tau from the row in other; not where there is no such row."""
    inner = lambda x: F.slice(x, F.lit(margin + 1), F.greatest(F.size(x) - 2 * margin, F.lit(0))) if margin else x
    return F.coalesce(F.exists(F.zip_with(inner(F.col(lum)), inner(other), lambda a, b: F.abs(a - b) > tau), lambda x: x), F.lit(False))


def vertical_safe(df: DataFrame, keys: list[str], order: str, lum: str, tau: int = 20, out: str = "safe", part_rows: int | None = None) -> DataFrame:
    """out: no pixel differs by more than tau from the rows above and below. part_rows: see masks."""
    if part_rows:
        return in_parts(df, keys, order, 1, part_rows, lambda d, k: vertical_safe(d, k, order, lum, tau, out))
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_up", F.lag(lum).over(w)).withColumn("_down", F.lead(lum).over(w))
    return d.withColumn(out, ~(_far(lum, F.col("_up"), tau) | _far(lum, F.col("_down"), tau))).drop("_up", "_down")


def level_safe(df: DataFrame, keys: list[str], order: str, lum: str, sensitivity: float = 0.9, margin: int = 5, step: int = 1, reach: int = 6, dark: int = 30, out: str = "safe", part_rows: int = 1 << 12) -> DataFrame:
    """out: the row and all within reach of it are smooth and not dark, and no pixel of theirs is further from the row's own than the threshold.

    order counts a group's rows from 0 without gaps. Only every step-th row can be safe. Rows near a group's ends have fewer neighbours; rows that margins leave nothing of, and null
    ones, are not safe. Each part of part_rows rows holds copies of its neighbours' edges, so a tall image is many tasks.
    """
    tau = pixels.threshold(sensitivity)
    usable = F.size(lum) > 2 * margin
    smooth = F.coalesce(usable & pixels.row_is_smooth(F.col(lum), sensitivity, margin) & (pixels.median(F.col(lum)) >= dark), F.lit(False))

    def work(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy(order)
        around = [f(lum, i).over(w) for i in range(1, reach + 1) for f in (F.lag, F.lead)]
        d = d.withColumn("_all", F.min("_smooth").over(w.rowsBetween(-reach, reach)) & (F.col(order) % step == 0)).withColumns({f"_n{i}": c for i, c in enumerate(around)})
        level = F.lit(True)
        for i in range(len(around)):
            level = level & ~_far(lum, F.col(f"_n{i}"), tau, margin)
        # the comparisons run only where the flags hold
        return d.withColumn(out, F.when(F.col("_all"), level).otherwise(F.lit(False))).drop("_all", *(f"_n{i}" for i in range(len(around))))

    return in_parts(df.withColumn("_smooth", smooth), keys, order, reach, part_rows, work).drop("_smooth")


def paper_safe(df: DataFrame, keys: list[str], order: str, lum: str, tau: int = 20, edge: int = 24, dark: int = 40, paper_range: int = 48, samples: int = 24, out: str = "safe", part_rows: int = 1 << 12) -> DataFrame:
    """out: the row is even, near the brightness of its group's paper, and like the rows above and below.

    The paper is estimated from about samples evenly spaced rows a group (the first samples of them), then every row is measured against it: two passes over the rows, the
    estimate being one value a group. order counts rows from 0 without gaps. Null rows are not safe.
    """
    heights = df.groupBy(*keys).agg((F.max(order) + 1).alias("_h"))
    spaced = F.greatest(F.lit(1), F.floor(F.col("_h") / samples))
    d = df.join(_renamed(heights, keys), _same(df, keys)).drop(*(f"_k{i}" for i in range(len(keys))))
    picked = d.where((F.col(order) % spaced == 0) & (F.col(order) < spaced * samples))
    paper = paper_estimate(picked, keys, lum, "_paper")
    d = d.drop("_h").join(_renamed(paper, keys), _same(df, keys), "left").drop(*(f"_k{i}" for i in range(len(keys))))
    even = pixels.row_is_safe(F.col(lum), edge, dark, F.coalesce("_paper", F.lit(255)), paper_range)
    d = vertical_safe(d.withColumn("_even", F.coalesce(even, F.lit(False))), keys, order, lum, tau, out, part_rows)
    return d.withColumn(out, F.col("_even") & F.col(out)).drop("_even", "_paper")


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in df.columns if c not in keys))


def _same(df: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def paper_estimate(df: DataFrame, keys: list[str], lum: str, out: str = "paper") -> DataFrame:
    """keys, paper: the middle of the commonest of 16 brightness bins, bright ones counted twice, of equal ones the brightest."""
    bins = df.select(*keys, F.explode(pixels.paper_bin(F.col(lum))).alias("_b")).groupBy(*keys, "_b").agg((F.count("*") * F.when(F.col("_b") >= 12, 2).otherwise(1)).alias("_n"))
    return bins.groupBy(*keys).agg((F.max(F.struct("_n", "_b"))["_b"] * 16 + 8).cast("int").alias(out))
