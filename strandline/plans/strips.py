"""From pages to strips: scan rows, plan cuts over the whole series, verify, cut, link, bundle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions import pixels
from strandline.operators import grouping, masks, morphology, planner, transitions
from strandline.plans import banners
from strandline.runtime import shared_table, ship
from strandline.sources.images import resampled
from strandline.sources.settings import PRESETS, Settings

SCAN_WIDTH = 480
GAP = 64  # scan rows between cuts of a page
PART_ROWS = 1 << 16  # scan rows of a series in one task


def scan_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """pages (series, page, px, width) with arrays busy, ink, structured, keep, one value per row at scan width."""
    ship(pages.sparkSession)
    edge, spread, _, _ = PRESETS[settings.strictness]

    @F.pandas_udf("busy array<boolean>, ink array<int>, structured array<boolean>, keep array<boolean>")
    def scan(px: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for p, w in zip(px, width):
            small = resampled(np.asarray(p, dtype=np.int64)[: len(p) // w * w].reshape(-1, w), SCAN_WIDTH)
            busy, ink, structured, _ = morphology.scan(small, edge, spread)
            out.append((busy.tolist(), ink.tolist(), structured.tolist(), morphology.half_size_enclosed(small).tolist()))
        return pd.DataFrame(out, columns=["busy", "ink", "structured", "keep"])

    good = pages.where((F.col("width") > 0) & (F.size("px") >= F.col("width"))).withColumn("height", F.floor(F.size("px") / F.col("width")))
    return good.withColumn("s", scan("px", "width")).select("series", "page", "px", "width", "height", "s.*")


def windows(scanned: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """series, page, width, height; top and bottom of what is left without crop_top and crop_bottom rows; first and end of it in scan rows, scan_rows in all."""
    d = scanned.select("series", "page", "width", F.col("height").cast("long").alias("height"), F.size("busy").cast("long").alias("scan_rows"))
    zero = F.lit(0)
    d = d.withColumn("crop_top", zero).withColumn("crop_bottom", zero) if crops is None else d.join(crops.select("series", "page", "crop_top", "crop_bottom"), ["series", "page"], "left")
    top, bottom = pixels.effective_window(F.col("height"), F.coalesce("crop_top", zero), F.coalesce("crop_bottom", zero))
    d = d.where("scan_rows > 0").withColumn("top", top).withColumn("bottom", bottom)
    scaled = lambda c: F.floor(F.col(c) * F.col("scan_rows") / F.col("height"))
    d = d.withColumn("first", F.least(scaled("top"), F.col("scan_rows") - 1))
    return d.withColumn("end", F.least(F.greatest(scaled("bottom"), F.col("first") + 1), F.col("scan_rows"))).drop("crop_top", "crop_bottom")


def profile(scanned: DataFrame, within: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """series, y, busy, ink, structured, keep, zone, taken, page, start: the rows of all pages' windows as one long profile of each series; a page's rows begin at y = start."""
    pages = grouping.running_offset(within.withColumn("n", F.col("end") - F.col("first")), ["series"], "page", "n", "start").select("series", "page", "first", "end", "start")
    d = scanned.select("series", "page", "busy", "ink", "structured", "keep").join(pages, ["series", "page"])
    rows = d.select("series", "page", "start", "first", "end", F.posexplode(F.arrays_zip("busy", "ink", "structured", "keep")).alias("r", "x")).where((F.col("r") >= F.col("first")) & (F.col("r") < F.col("end")))
    rows = rows.select("series", "page", "start", (F.col("start") + F.col("r") - F.col("first")).alias("y"), "x.*")
    return masks.zones(rows, ["series"], "y", "structured", part_rows=part_rows).withColumn("taken", F.col("busy") | F.col("zone") | F.col("keep"))


def series_rows(scanned: DataFrame, crops: DataFrame | None = None, part_rows: int = PART_ROWS, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows(), profile()) of whole series, written."""
    within = shared_table(windows(scanned, crops))
    rows = profile(scanned, within, part_rows)
    if seen is not None:  # counted by the job that writes the rows
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(c) for c in ("taken", "zone", "keep")))
    return within, shared_table(rows)


def series_stats(rows: DataFrame) -> DataFrame:
    """series, busy_percent, zone_percent of the rows of series_rows()."""
    return rows.groupBy("series").agg(masks.percent_true("taken").alias("busy_percent"), masks.percent_true("zone").alias("zone_percent"))


def plan_series(scanned: DataFrame, settings: Settings, crops: DataFrame | None = None, part_rows: int = PART_ROWS, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(cuts: series, page, y, forced, gap, top, bottom, height; stats: series, busy and zone percent) of whole series.

    One plan goes over all pages of a series, so their ends are no cuts. Long series are planned in parts. Rows of a page are counted from its window's.
    """
    limit, margin = settings.max_height, PRESETS[settings.strictness][2]
    within, rows = series_rows(scanned, crops, part_rows, seen)
    stats = series_stats(rows)
    widest = within.groupBy("series").agg(F.max("width").alias("strip_width"))
    most = F.greatest(F.lit(16), F.floor(F.lit(limit) * SCAN_WIDTH / F.col("strip_width")))
    sized = rows.join(widest.select("series", most.alias("most")), "series")
    plans = transitions.plan_long(sized, ["series"], "y", "taken", "ink", F.col("most"), F.floor(F.col("most") * 4 / 5), 0, margin, part_rows=part_rows)
    placed = plans.select("series", "y", "forced").join(rows.select("series", "y", "keep", "page", "start"), ["series", "y"]).join(within, ["series", "page"]).join(widest, "series")
    scale = (F.col("bottom") - F.col("top")) / (F.col("end") - F.col("first"))
    over = F.floor((F.col("bottom") - F.col("top")) * F.col("strip_width") / F.col("width")) > limit
    # a forced cut inside a closed region is given up, unless the page alone is over the limit
    placed = placed.where(~(F.col("forced") & F.col("keep") & ~over))
    source = F.col("top") + F.floor((F.col("y") - F.col("start")) * scale).cast("long")
    return placed.select("series", "page", source.alias("y"), "forced", F.greatest(F.lit(1), F.floor(GAP * scale)).cast("int").alias("gap"), "top", "bottom", "height"), stats


def measured_plan(scanned: DataFrame, settings: Settings, crops: DataFrame | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(cuts of plan_series(), one row of metrics: pages, rows, busy, zone and keep percent, cuts, forced).

    The metrics are gathered by the jobs that write rows and cuts, so nothing is read for their sake. Without rows the percentages are 0.
    """
    pages, rows, cuts = Observation("pages"), Observation("rows"), Observation("cuts")
    counted = shared_table(scanned.observe(pages, F.count(F.lit(1)).alias("pages")))
    plan, _ = plan_series(counted, settings, crops, part_rows, rows)
    plan = shared_table(plan.observe(cuts, F.count(F.lit(1)).alias("cuts"), F.count_if("forced").alias("forced")))
    n = pages.get | rows.get | cuts.get
    percent = {f"{k}_percent": n[c] * 100 // max(1, n["rows"]) for k, c in (("busy", "taken"), ("zone", "zone"), ("keep", "keep"))}
    values = {"pages": n["pages"], "rows": n["rows"], **percent, "cuts": n["cuts"], "forced": n["forced"]}
    return plan, scanned.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))


def verify(cuts: DataFrame, pages: DataFrame, settings: Settings, text: DataFrame | None = None) -> DataFrame:
    """cuts with y moved to the nearest free row at full size, and bad where there is none. Only the rows around a cut are read.

    text: series, page, top, bottom, left, right of recognised text lines, in pixels of the page; rows that their blocks cover near a cut aren't free.
    """
    edge, spread, _, _ = PRESETS[settings.strictness]
    half, suspect = 320, 96
    if text is None:
        cuts = cuts.withColumn("lines", F.array().cast("array<array<int>>"))
    else:
        line = F.array(*(F.col(c).cast("int") for c in ("top", "bottom", "left", "right")))
        held = text.dropna(subset=["top", "bottom", "left", "right"]).groupBy("series", "page").agg(F.collect_list(line).alias("lines"))
        cuts = cuts.join(held, ["series", "page"], "left")
        cuts = cuts.withColumn("lines", F.filter("lines", lambda x: (x[0] <= F.col("y") + suspect) & (x[1] >= F.col("y") - suspect)))
    near = cuts.join(pages.select("series", "page", "px", "width"), ["series", "page"])
    near = near.withColumn("above", F.greatest(F.col("y") - half, F.lit(0))).withColumn("below", F.least(F.col("y") + half, F.col("height")))
    near = near.withColumn("px", F.expr("slice(px, int(above * width) + 1, int((below - above) * width))"))

    @F.pandas_udf("y long, bad boolean")
    def moved(px: pd.Series, width: pd.Series, at: pd.Series, first: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, a, t, found in zip(px, width, at, first, lines):
            found = np.array([list(x) for x in found], dtype=np.int64) - [t, t, 0, 0] if found is not None and len(found) else None
            out.append(morphology.verified_cut(np.asarray(p, dtype=np.int64).reshape(-1, w), int(a), edge, spread, half, lines=found, suspect=suspect))
        return pd.DataFrame(out, columns=["y", "bad"])

    d = near.withColumn("m", moved("px", "width", F.col("y") - F.col("above"), "above", "lines"))
    return d.select("series", "page", (F.col("m.y") + F.col("above")).alias("y"), (F.col("forced") | F.col("m.bad")).alias("forced"), "gap", "top", "bottom")


def build(pages: DataFrame, settings: Settings = Settings(), templates: DataFrame | None = None, gated: bool | Column = False, text: DataFrame | None = None) -> DataFrame:
    """series, bundle, segment, page, start, end, rendered, tall, seam_cut, forced, banner_cut: which rows of which page make up each strip.

    pages: series, page (its order), px (packed pixels, row by row), width. Pages that can't be read are left out. templates (banners.read_templates()) and
    gated (whether a series' source is known to put banners on its pages) say which pages lose their banners; settings.banner_cut lets them. text: text
    lines (see verify()).
    """
    scanned = shared_table(scan_pages(pages, settings))
    policy = banners.Policy.of(settings)
    looked_for = policy is not None and not (templates is None and gated is False)
    crops = shared_table(banners.banner_crops(scanned, policy, templates, gated)) if looked_for else None
    cuts, _ = plan_series(scanned, settings, crops)
    kept = shared_table(verify(cuts, scanned, settings, text))
    bounds = windows(scanned, crops).select("series", "page", "top", "bottom", (F.col("bottom") - F.col("top") < F.col("height")).alias("banner_cut"))
    spaced = planner.thin(kept, ["series", "page"], "y", F.col("top"), F.col("bottom"), F.col("gap"))
    pieces = planner.segments(spaced, bounds.drop("banner_cut"), ["series", "page"], "y")
    widest = scanned.groupBy("series").agg(F.max("width").alias("strip_width"))
    pieces = pieces.join(scanned.select("series", "page", "px", "width", "height"), ["series", "page"]).join(widest, "series")
    rendered = F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) * F.col("strip_width") / F.col("width"))).cast("long")

    @F.pandas_udf("top boolean, bottom boolean, head boolean, foot boolean")
    def edges(px: pd.Series, width: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        out = []
        for p, wd, s, e in zip(px, width, start, end):
            im = np.asarray(p, dtype=np.int64)[: len(p) // wd * wd].reshape(-1, wd)
            head, foot = im[s : s + 48], im[max(0, e - 48) : e]
            out.append((morphology.touches_edge(head, True), morphology.touches_edge(foot, False), morphology.has_content(head), morphology.has_content(foot)))
        return pd.DataFrame(out, columns=["top", "bottom", "head", "foot"])

    pieces = pieces.withColumn("edge", edges("px", "width", "start", "end")).withColumn("rendered", rendered).drop("px")
    order = Window.partitionBy("series").orderBy("page", "n")
    previous_page, previous_edge = F.lag("page").over(order), F.lag("edge.bottom").over(order)
    # blank margins that meet are no reason to keep pages together
    content = F.lag("edge.foot").over(order) | F.col("edge.head")
    linked = (previous_page != F.col("page")) & content & (previous_edge | F.col("edge.top"))
    pieces = pieces.withColumn("segment", F.row_number().over(order)).withColumn("linked", F.coalesce(linked, F.lit(False)))
    forced = kept.where("forced").select("series", "page").distinct().withColumn("forced", F.lit(True))
    pieces = shared_table(pieces.select("series", "segment", "page", "start", "end", "rendered", "linked"))
    bundled = grouping.group(pieces, ["series"], "segment", "rendered", settings.rule, settings.max_height, settings.pages_per_pack, linked="linked")
    if "seam_cut" not in bundled.columns:
        bundled = bundled.withColumn("seam_cut", F.lit(False))
    out = bundled.select("series", "segment", "bundle", "tall", "seam_cut").join(pieces, ["series", "segment"]).join(forced, ["series", "page"], "left")
    out = out.join(bounds.select("series", "page", "banner_cut"), ["series", "page"])
    return out.select("series", "bundle", "segment", "page", "start", "end", "rendered", "tall", "seam_cut", F.coalesce("forced", F.lit(False)).alias("forced"), "banner_cut")


def render(strips: DataFrame, pages: DataFrame) -> DataFrame:
    """series, bundle, height, png: each bundle's pieces scaled to the series' width and stacked."""
    from strandline.operators.folds import fold_sorted
    from strandline.sources.images import write_png

    widest = pages.groupBy("series").agg(F.max("width").alias("to_width"))
    d = strips.join(pages.select("series", "page", "px", "width"), ["series", "page"]).join(widest, "series")
    d = d.withColumn("px", F.expr("slice(px, int(start * width) + 1, int((end - start) * width))"))

    def fold(rows):
        parts = [p.reshape(-1, w)[np.arange(r) * (len(p) // w) // r][:, np.arange(to) * w // to] for p, w, r, to in ((np.asarray(p, dtype=np.int64), w, r, to) for p, w, r, to in rows)]
        image = np.vstack(parts)
        yield len(image), write_png(image)

    return fold_sorted(d, ["series", "bundle"], ["segment"], ["px", "width", "rendered", "to_width"], fold, "height long, png binary", batch=8)
