"""Cut plans over row profiles, thinning of cuts, exact partitions.

The plans depend on the last cut, so they fold over each group's rows. A fold keeps a group's profile as arrays of
a few bytes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.folds import fold_sorted


def near(mask: np.ndarray, margin: int) -> np.ndarray:
    """Rows within margin of a true row."""
    n = len(mask)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(mask)
    np.add.at(edge, np.maximum(0, at - margin), 1)
    np.add.at(edge, np.minimum(n, at + margin + 1), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """(start, end exclusive) of true runs of at least least rows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= max(1, least)]


class Tiers:
    """The next cut after any row, from the rows around it. A piece holds at most most rows, where that can be.

    The first tier that gives a row decides: the last row of the top fifth of the window with margin + 4 free rows around
    it; the free row that is nearest to the limit, ink counting half a row (forced); the middle of the widest free band; the first
    free row up to beyond rows past the limit; the row of least ink (forced).

    busy and ink may be a part of a group's rows, from row base of rows in all; then next() holds where the part has reach() rows on either side.
    """

    def __init__(self, busy: np.ndarray, ink: np.ndarray, most: int, least: int | None = None, beyond: int | None = None, margin: int = 8, band: int | None = None, base: int = 0, rows: int | None = None):
        self.most, self.least = most, most // 3 if least is None else least
        self.beyond = most // 4 if beyond is None else beyond
        self.band = margin if band is None else band
        if self.least < 1:
            raise ValueError("least must be 1 or more: a piece without rows never ends")
        self.ink, self.base, self.rows = ink, base, len(busy) if rows is None else rows
        self.blocked = near(busy, margin)
        self.bands = runs(~self.blocked, self.band)
        clearance = margin + 4
        self.clear = ~near(self.blocked, clearance)
        self.clear[: max(0, clearance - base)] = False
        self.clear[max(0, self.rows - clearance - base) :] = False

    @staticmethod
    def reach(most: int, beyond: int | None, margin: int, band: int | None) -> int:
        return most + (most // 4 if beyond is None else beyond) + 2 * margin + 4 + (margin if band is None else band) + 2

    def next(self, after: int) -> tuple[int, bool] | None:
        """(row, forced) of the cut that follows a cut at row after; None where the rest fits, or nothing can be cut."""
        if self.rows - after <= self.most:
            return None
        start = after - self.base
        target, lo = start + self.most, start + self.least
        hi = min(target, self.rows - 1 - self.base)
        at = max(lo, target - self.most // 5)
        good = np.flatnonzero(self.clear[at : target + 1])
        if len(good):
            return self.base + at + int(good[-1]), False
        y = np.arange(lo, hi + 1)
        free = y[~self.blocked[lo : hi + 1]]
        if len(free):
            return self.base + int(free[np.argmin(2 * (target - free) + self.ink[free])]), True
        inside = [(min(b, target + 1) - max(a, lo), max(a, lo) + min(b, target + 1)) for a, b in self.bands if a <= target and b > lo]
        wide = [x for x in inside if x[0] >= self.band]
        if wide:
            top = max(x[0] for x in wide)
            # the sum of two local rows: the middle of the whole rows
            return ([x[1] for x in wide if x[0] == top][-1] + 2 * self.base) // 2, False
        later = next(((a, b) for a, b in self.bands if b > target + 1 and a <= target + self.beyond), None)
        if later:
            return self.base + min(max(later[0], target + 1), later[1] - 1), False
        if not len(y):
            return None
        return self.base + int(y[np.argmin(self.ink[y].astype(np.int64) * 1000 + (target - y))]), True


def tiered(busy: np.ndarray, ink: np.ndarray, most: int, least: int | None = None, beyond: int | None = None, margin: int = 8, band: int | None = None) -> list[tuple[int, bool]]:
    """(row, forced) of the cuts of whole groups, by Tiers."""
    tiers, out = Tiers(busy, ink, most, least, beyond, margin, band), []
    found = tiers.next(0)
    while found:
        out.append(found)
        found = tiers.next(found[0])
    return out


def band_centres(safe: np.ndarray, limit: int, least: int | None = None, overflow: int = 0) -> tuple[list[int], bool]:
    """(cuts, whether the rest fits): each cut is the middle of the first safe run that meets the window, or else the overflow after it."""
    if limit <= 0 or len(safe) <= limit:
        return [], True
    least = max(1, limit // 2 if least is None else least)
    bands, cuts, at = runs(safe), [], 0

    def pick(a: int, b: int) -> int | None:
        for s, e in bands:
            x, y = max(a, s), min(b, e - 1)
            if x <= y:
                return (x + y) // 2
        return None

    while len(safe) - at > limit:
        cut = pick(at + least, at + limit)
        if cut is None and overflow > 0:
            cut = pick(at + limit + 1, at + limit + overflow)
        if cut is None or cut <= at:
            return cuts, False
        cuts.append(cut)
        at = cut
    return cuts, True


def search_up(safe: np.ndarray, limit: int, reach: float = 0.5, overflow: int = 0, hard: bool = False, ink: np.ndarray | None = None) -> tuple[list[int], bool]:
    """(cuts, whether the rest fits): each cut is the last safe row at or below the limit, not further back than reach * limit.

    overflow looks that much further back. With ink, the safe row of least distance + 10000 * ink is taken. hard: where no row is
    safe and there is no overflow, cut at the limit itself.
    """
    if limit <= 0 or len(safe) <= limit:
        return [], True
    back = max(1, int(limit * reach))
    cuts, at = [], 0
    while at + limit < len(safe):
        ideal = at + limit

        def choose(low: int) -> int | None:
            y = np.arange(max(at + 1, low), min(len(safe) - 1, ideal) + 1)
            y = y[safe[y]]
            if not len(y):
                return None
            return int(y[-1]) if ink is None else int(y[np.argmin(np.abs(y - ideal).astype(np.float32) + ink[y].astype(np.float32) * np.float32(10000))])

        cut = choose(ideal - back)
        if cut is None and overflow > 0:
            cut = choose(ideal - back - overflow)
        elif cut is None and hard:
            cut = ideal
        if cut is None:
            return cuts, False
        cuts.append(cut)
        at = cut
    return cuts, True


def _arrays(rows: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    busy, ink = bytearray(), []
    for b, i in rows:
        busy.append(bool(b))
        ink.append(i or 0)
    return np.frombuffer(bytes(busy), dtype=np.bool_), np.array(ink, dtype=np.int64)


def plan_cuts(df: DataFrame, keys: list[str], order: str, busy: str, ink: str, most: int | Column, least: int | Column | None = None, beyond: int | None = None, margin: int = 8, band: int | None = None) -> DataFrame:
    """keys, n (from 1), y, forced: the tiered plan of each group; y counts the group's rows in order from 0.

    most and least may be columns that hold one value in each group.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        limits: list[int] = []

        def profile() -> Iterator[tuple]:
            for b, i, m, low in rows:
                if not limits:
                    limits.extend((m, low))
                yield b, i

        b, i = _arrays(profile())
        if limits:
            for n, (y, forced) in enumerate(tiered(b, i, limits[0], limits[1], beyond, margin, band), 1):
                yield n, y, forced

    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    d = df.withColumn("_m", value(most)).withColumn("_l", value(least) if least is not None else F.floor(F.col("_m") / 3))
    return fold_sorted(d, keys, [order], [busy, ink, "_m", "_l"], fold, "n long, y long, forced boolean")


def plan_bands(df: DataFrame, keys: list[str], order: str, safe: str, limit: int, least: int | None = None, overflow: int = 0, how: str = "centre", reach: float = 0.5, ink: str | None = None) -> DataFrame:
    """keys, n, y, tail_safe: cuts by how: centre, up, hard or ink. A group without cuts has one row of null n and y."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        s, i = _arrays(rows)
        cuts, tail = band_centres(s, limit, least, overflow) if how == "centre" else search_up(s, limit, reach, overflow, how == "hard", i if how == "ink" else None)
        for n, y in enumerate(cuts, 1):
            yield n, y, tail
        if not cuts:
            yield None, None, tail

    return fold_sorted(df.withColumn("_i", F.col(ink) if ink else F.lit(0)), keys, [order], [safe, "_i"], fold, "n long, y long, tail_safe boolean")


def thin(df: DataFrame, keys: list[str], y: str, top: Column | int, bottom: Column | int | None, gap: Column | int) -> DataFrame:
    """keys, y: cuts at least gap after the last one kept (the first: after top), and before bottom - 1."""
    as_column = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for at, t, b, g in rows:
            if at - (t if last is None else last) >= g and (b is None or at < b - 1):
                yield (at,)
                last = at

    d = df.withColumn("_y", F.col(y).cast("long")).withColumn("_t", as_column(top)).withColumn("_e", as_column(bottom)).withColumn("_g", as_column(gap))
    return fold_sorted(d, keys, ["_y"], ["_y", "_t", "_e", "_g"], fold, f"`{y}` long")


def segments(cuts: DataFrame, bounds: DataFrame, keys: list[str], y: str, top: str = "top", bottom: str = "bottom") -> DataFrame:
    """keys, n (from 0), start, end, cut_top: consecutive pieces that cover [top, bottom) exactly, cut at y."""
    inner = cuts.join(bounds, keys).select(*keys, F.least(F.greatest(F.col(y), F.col(top) + 1), F.col(bottom)).alias("start"))
    starts = bounds.select(*keys, F.col(top).alias("start")).unionByName(inner).distinct()
    w = Window.partitionBy(*keys).orderBy("start")
    d = starts.withColumn("_e", F.lead("start").over(w)).withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    d = d.join(bounds.select(*keys, F.col(bottom).alias("_b")), keys).withColumn("end", F.coalesce("_e", "_b")).where(F.col("end") > F.col("start"))
    return d.select(*keys, "n", "start", "end", (F.col("n") > 0).alias("cut_top"))
