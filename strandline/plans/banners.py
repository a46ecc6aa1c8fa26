"""Banners at the top and bottom of pages: known ones by templates, unknown ones by what the pages of a series share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import pixels
from strandline.operators import matching
from strandline.runtime import shared_table, ship
from strandline.sources import images
from strandline.sources.settings import PRESETS, Settings

Match = Callable[[Column, Column], Column]
SIDES = ("top", "bottom")


@dataclass(frozen=True)
class Policy:
    """How high a banner is, on how many pages of a series it has to recur, and by what share of its pixels."""

    strip: int = 200
    least_pages: int = 3
    least_share: float = 0.97
    least_height: int = 600

    @classmethod
    def of(cls, settings: Settings) -> Policy | None:
        """None where banners stay."""
        return cls(least_pages=PRESETS[settings.strictness][3]) if settings.banner_cut else None

    @property
    def rows(self) -> int:
        return min(400, max(1, self.strip))

    @property
    def tall(self) -> int:
        """The least height of a page that may lose its banners."""
        return max(self.least_height, 2 * self.rows + 100)


def tall_enough(pages: DataFrame, policy: Policy, height: str = "height") -> DataFrame:
    return pages.where(F.col(height) >= policy.tall)


def read_templates(files: DataFrame) -> DataFrame:
    """template (its path) and grid (luminances) of image files (path, content); files that can't be decoded, and images of one colour, are left out."""
    ship(files.sparkSession)

    @F.pandas_udf("array<int>")
    def decoded(raw: pd.Series) -> pd.Series:
        out = []
        for x in raw:
            try:
                out.append(images.grid(images.read_png(bytes(x))).ravel().tolist())
            except Exception:  # whatever a broken file makes a decoder raise
                out.append(None)
        return pd.Series(out, dtype=object)

    named = files.where(F.lower("path").rlike(r"\.(png|jpe?g)$"))
    return usable(named.select(F.col("path").alias("template"), decoded("content").alias("grid")), "grid")


def usable(templates: DataFrame, grid: str) -> DataFrame:
    """Templates that can match: not null, without null values, not flat."""
    return templates.where(F.col(grid).isNotNull() & F.forall(grid, lambda x: x.isNotNull()) & (F.array_max(grid) > F.array_min(grid)))


def edges(pages: DataFrame, policy: Policy) -> DataFrame:
    """series, page, and of both sides the strip's packed pixels and its grid of luminances; pages (series, page, px, width, height) that are tall enough."""
    ship(pages.sparkSession)
    n = (F.col("width") * policy.rows).cast("int")
    colours = lambda px: F.transform(px, lambda p: p.bitwiseAND(F.lit(0xFFFFFF)).cast("int"))  # without alpha they fit an int
    cut = tall_enough(pages, policy).select("series", "page", "width", colours(F.slice("px", F.lit(1), n)).alias("top"), colours(F.slice("px", (F.col("width") * (F.col("height") - policy.rows) + 1).cast("int"), n)).alias("bottom"))

    @F.pandas_udf("array<int>")
    def grid(px: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([images.grid(np.asarray(p, dtype=np.int64).reshape(-1, w)).ravel().tolist() for p, w in zip(px, width)])

    return cut.select("series", "page", "top", "bottom", grid("top", "width").alias("top_grid"), grid("bottom", "width").alias("bottom_grid"))


def compact(strips: DataFrame) -> DataFrame:
    """strips with the sampled pixels that a comparison would look at, where all strips of a series are of one size; then whole strips needn't travel."""
    sizes = strips.groupBy("series").agg((F.min(F.size("top")) == F.max(F.size("top"))).alias("_even"))
    d = strips.join(sizes, "series")
    return d.select("series", "page", *(F.when(F.col("_even"), pixels.strided(F.col(s), 512)).otherwise(F.col(s)).alias(s) for s in SIDES), *(f"{s}_grid" for s in SIDES))


def decide(strips: DataFrame, policy: Policy, matches: Match, templates: DataFrame | None = None, gated: bool | Column = True, digits: int | None = None) -> DataFrame:
    """strips (series, page, top, bottom, top_grid, bottom_grid) with <side>_by: template, gate, or null where the side stays.

    A strong template decides alone. The gate holds the pages that match the first of their series, or the last, if there are enough; it decides
    whatever templates say less of, in series whose source is known to have banners (gated). templates: template, grid.
    """
    d = strips
    for side in SIDES:
        if templates is None:
            d = d.withColumn(f"{side}_score", F.lit(0.0))
        else:
            d = matching.best_template(d, usable(templates, "grid"), f"{side}_grid", "template", "grid", digits).withColumnRenamed("best_score", f"{side}_score").drop("best_template")
        d = matching.gate(d, ["series"], "page", matches, side, policy.least_pages, f"{side}_gate")
        strong = pixels.tier(F.col(f"{side}_score")) == "strong"
        agreed = F.col(f"{side}_gate") & (gated if isinstance(gated, Column) else F.lit(gated))
        d = d.withColumn(f"{side}_by", F.when(strong, "template").when(agreed, "gate")).drop(f"{side}_gate", f"{side}_score")
    return d


def crops(pages: DataFrame, decided: DataFrame, policy: Policy) -> DataFrame:
    """series, page, crop_top, crop_bottom, reason of all pages (series, page, height): short pages aren't looked at, other reasons are template, gate, both, none."""
    by = decided.select("series", "page", "top_by", "bottom_by")
    d = pages.select("series", "page", "height").join(by, ["series", "page"], "left")
    rows = lambda s: F.when(F.col(f"{s}_by").isNotNull(), policy.rows).otherwise(0)
    ways = F.array_distinct(F.array_compact(F.array("top_by", "bottom_by")))
    reason = F.when(F.coalesce(F.col("height") < policy.tall, F.lit(True)), "short").when(F.size(ways) == 2, "both").otherwise(F.coalesce(F.get(ways, F.lit(0)), F.lit("none")))
    return d.select("series", "page", rows("top").alias("crop_top"), rows("bottom").alias("crop_bottom"), reason.alias("reason"), "top_by", "bottom_by")


def banner_crops(pages: DataFrame, policy: Policy | None, templates: DataFrame | None = None, gated: bool | Column = False) -> DataFrame:
    """crops() of pages (series, page, px, width, height). Without a policy only templates decide, at its default height."""
    rule = policy or Policy()
    if policy is None and templates is None:
        return pages.select("series", "page", F.lit(0).alias("crop_top"), F.lit(0).alias("crop_bottom"), F.lit("none").alias("reason"), F.lit(None).cast("string").alias("top_by"), F.lit(None).cast("string").alias("bottom_by"))
    strips = shared_table(compact(shared_table(edges(pages, rule))))
    close = lambda a, b: pixels.rows_continue(a, b, pixels.pixel_delta, least=rule.least_share)
    agreed = F.lit(False) if policy is None else gated
    return crops(pages, decide(strips, rule, close, templates, agreed), rule)


def report(found: DataFrame) -> DataFrame:
    """series, checked, tops, bottoms, pages, by_template, by_gate, note: what was cropped of each series, and why not."""
    sides = lambda way: F.count_if(F.col("top_by") == way) + F.count_if(F.col("bottom_by") == way)
    n = found.groupBy("series").agg(
        F.count_if(F.col("reason") != "short").alias("checked"),
        F.count_if(F.col("crop_top") > 0).alias("tops"),
        F.count_if(F.col("crop_bottom") > 0).alias("bottoms"),
        F.count_if((F.col("crop_top") > 0) | (F.col("crop_bottom") > 0)).alias("pages"),
        sides("template").alias("by_template"),
        sides("gate").alias("by_gate"),
    )
    return n.withColumn("note", F.when(F.col("checked") == 0, "no page is tall enough").when(F.col("pages") == 0, "no template matches and strips differ").otherwise("cropped"))
