"""Bundles of ordered sheets: by height with linked neighbours, by number, whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.operators.folds import fold_sorted


class Sheet(NamedTuple):
    """name, height, and of the boundary before it: whether a break is safe there, and whether it is linked to the sheet above."""

    name: object
    height: int
    safe: bool
    linked: bool


@dataclass
class Pile:
    """The sheets of an open bundle, with the last boundary in it that no link crosses (0: none) and whether it began at a bad one."""

    sheets: list[Sheet] = field(default_factory=list)
    total: int = 0
    loose: int = 0
    bad: bool = False

    def put(self, sheet: Sheet) -> None:
        if self.sheets and not sheet.linked:
            self.loose = len(self.sheets)
        self.sheets.append(sheet)
        self.total += sheet.height

    def break_for(self, sheet: Sheet) -> tuple[Pile, Pile]:
        """(what is closed, what goes on) where sheet doesn't fit: at the boundary before it, or, as a link crosses that, at the last loose one."""
        at = (sheet.linked and self.loose) or len(self.sheets)
        rest = self.sheets[at:]
        first = (rest or [sheet])[0]
        bad = first.linked or not first.safe
        on = Pile(bad=bad)
        for s in rest:
            on.put(s)
        return Pile(self.sheets[:at], bad=self.bad or (bad and bool(rest))), on


def bundles_of(sheets: Iterable[tuple], limit: int) -> Iterator[tuple[list[Sheet], bool, bool]]:
    """(sheets, tall, seam cut) of bundles of sheets (tuples as Sheet) that hold what fits the limit (none, if 0 or less); a sheet above it stands alone, and starts anew what follows.

    A seam is cut where a bundle begins at a bad boundary, or was closed at one to keep a link.
    """
    pile = Pile()
    for sheet in map(Sheet._make, sheets):
        tall = 0 < limit < sheet.height
        if pile.sheets and (tall or 0 < limit < pile.total + sheet.height):
            done, pile = (pile, Pile()) if tall else pile.break_for(sheet)
            yield done.sheets, False, done.bad
        if tall:
            yield [sheet], True, False
            pile = Pile()
        else:
            pile.put(sheet)
    if pile.sheets:
        yield pile.sheets, False, pile.bad


def by_height(df: DataFrame, keys: list[str], order: str, height: str, limit: int, safe: str | None = None, linked: str | None = None) -> DataFrame:
    """keys, order, height, bundle (from 1), tall, seam_cut per sheet. safe and linked: boolean columns, true and false if not given or null; a null height is 0."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        for n, (sheets, tall, seam) in enumerate(bundles_of(rows, limit), 1):
            for s in sheets:
                yield s.name, s.height, n, tall, seam

    d = df.withColumn("_s", F.coalesce(F.col(safe), F.lit(True)) if safe else F.lit(True)).withColumn("_l", F.coalesce(F.col(linked), F.lit(False)) if linked else F.lit(False))
    kind = df.schema[order].dataType.simpleString()
    return fold_sorted(d.withColumn("_h", F.coalesce(F.col(height).cast("long"), F.lit(0))), keys, [order], [order, "_h", "_s", "_l"], fold, f"`{order}` {kind}, `{height}` long, bundle long, tall boolean, seam_cut boolean")


def by_number(df: DataFrame, keys: list[str], order: str, size: int, height: str | None = None, limit: int = 0) -> DataFrame:
    """bundle (from 1) of size sheets each; tall: whether the bundle holds a sheet above limit."""
    d = ordered.running_sum(ordered.dealt(df, keys, order), keys, order, F.lit(1), "_above").drop(ordered.PART)
    d = d.withColumn("bundle", (F.floor(F.col("_above") / max(1, size)) + 1).cast("long")).drop("_above")
    # a bundle has size rows, so this window is short
    tall = F.coalesce(F.max(F.col(height) > limit).over(Window.partitionBy(*keys, "bundle")), F.lit(False)) if height and limit > 0 else F.lit(False)
    return d.withColumn("tall", tall)


def whole(df: DataFrame) -> DataFrame:
    return df.withColumn("bundle", F.lit(1).cast("long")).withColumn("tall", F.lit(False))


def group(df: DataFrame, keys: list[str], order: str, height: str, rule: str = "MAX_HEIGHT", limit: int = 10_000, per_pack: int = 10, safe: str | None = None, linked: str | None = None) -> DataFrame:
    """Bundles by the rule MAX_HEIGHT, PAGES_PER_PACK or WHOLE."""
    if rule == "MAX_HEIGHT":
        return by_height(df, keys, order, height, limit, safe, linked)
    if rule == "PAGES_PER_PACK":
        return by_number(df, keys, order, per_pack, height, limit)
    if rule == "WHOLE":
        return whole(df)
    raise ValueError(f"unknown rule {rule}")


def flag_reason(tall: Column, forced: Column, seam: Column) -> Column:
    return F.when(tall, F.lit("tall")).when(forced, F.lit("forced")).when(seam, F.lit("seam"))


def manifest(bundled: DataFrame, keys: list[str], height: str, width: str | None = None, forced: Column | None = None) -> DataFrame:
    """One row per bundle: sheets, height, widest, flags and their reason. forced: whether a row's boundary was forced."""
    aggregates = [F.count("*").alias("sheets"), F.sum(height).alias("total_height"), F.max(width or height).alias("widest"), F.bool_or("tall").alias("tall"), F.bool_or("seam_cut").alias("seam_cut"), F.coalesce(F.bool_or(F.lit(False) if forced is None else forced), F.lit(False)).alias("_forced")]
    return bundled.groupBy(*keys, "bundle").agg(*aggregates).withColumn("reason", flag_reason(F.col("tall"), F.col("_forced"), F.col("seam_cut"))).drop("_forced")


def running_offset(df: DataFrame, keys: list[str], order: str, height: str, out: str = "offset") -> DataFrame:
    """out: the sum of the heights before the row, in two phases; null heights count 0."""
    return ordered.running_sum(ordered.dealt(df, keys, order), keys, order, F.col(height), out).drop(ordered.PART)
