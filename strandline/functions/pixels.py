"""Rows of pixels as array expressions. A row is an array of packed ARGB integers, or of luminances 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(p: Column, shift: int) -> Column:
    return F.shiftright(p, shift).bitwiseAND(F.lit(255))


def luma(p: Column) -> Column:
    """77 r + 150 g + 29 b, divided by 256 and rounded down."""
    return F.shiftright(channel(p, 16) * 77 + channel(p, 8) * 150 + channel(p, 0) * 29, 8)


def lumas(px: Column) -> Column:
    return F.transform(px, luma)


def pixel_delta(a: Column, b: Column) -> Column:
    return F.abs(channel(a, 16) - channel(b, 16)) + F.abs(channel(a, 8) - channel(b, 8)) + F.abs(channel(a, 0) - channel(b, 0))


def threshold(sensitivity: float) -> int:
    """255 * (1 - s) rounded down, s as a 32-bit float."""
    import numpy as np

    return max(0, int(255.0 * (1.0 - float(np.float32(min(1.0, max(0.0, sensitivity)))))))


def stride(lum: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(lum) / most)).cast("int")


def strided(x: Column, most: int) -> Column:
    """Every n-th element, so that about most are left."""
    return F.filter(x, lambda _, i: i % stride(x, most) == 0)


def max_step(lum: Column) -> Column:
    """The largest difference of neighbours; 0 for fewer than two."""
    steps = F.zip_with(F.slice(lum, F.lit(1), F.greatest(F.size(lum) - 1, F.lit(0))), F.slice(lum, 2, F.greatest(F.size(lum), F.lit(1))), lambda a, b: F.abs(a - b))
    return F.coalesce(F.array_max(F.filter(steps, lambda x: x.isNotNull())), F.lit(0))


def median(lum: Column, most: int = 256) -> Column:
    """The upper middle of the sampled row; 255 of an empty one."""
    s = F.array_sort(strided(lum, most))
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(255))


def row_is_safe(lum: Column, edge: int = 24, dark: int = 40, paper: Column | None = None, paper_range: int = 48) -> Column:
    """No step above edge, and not dark; with paper, a median near it."""
    ok = (F.size(lum) < 2) | ((max_step(lum) <= edge) & (median(lum) >= dark))
    return ok if paper is None else ok & (F.abs(median(lum) - paper) <= paper_range)


def row_is_smooth(lum: Column, sensitivity: float, margin: int = 0) -> Column:
    inner = F.slice(lum, F.lit(margin + 1), F.greatest(F.size(lum) - 2 * margin, F.lit(0)))
    return (F.size(lum) < 2) | (max_step(inner) <= threshold(sensitivity))


def has_content(sums: Column, spread: int = 64) -> Column:
    """Whether sampled sums r + g + b differ by more than spread."""
    s = strided(sums, 512)
    return F.coalesce(F.array_max(s) - F.array_min(s) > spread, F.lit(False))


def channel_sums(px: Column) -> Column:
    return F.transform(px, lambda p: channel(p, 16) + channel(p, 8) + channel(p, 0))


def match_fraction(a: Column, b: Column, delta, tau: int = 24) -> Column:
    """Share of sampled positions, both rows centred on each other, that differ by at most tau; null if one is empty."""
    n = F.least(F.size(a), F.size(b))
    # positions first: a lambda that named the compared rows would compare them anew for each position
    at = F.sequence(F.lit(0), n - 1, F.greatest(F.lit(1), F.floor(n / 512)).cast("int"))
    left = lambda x: F.floor((F.size(x) - n) / 2).cast("int")
    hits = F.aggregate(at, F.lit(0), lambda t, i: t + F.when(delta(F.get(a, left(a) + i), F.get(b, left(b) + i)) <= tau, 1).otherwise(0))
    return F.when(n > 0, hits / F.size(at))


def rows_continue(a: Column, b: Column, delta, tau: int = 24, least: float = 0.9) -> Column:
    return F.coalesce(match_fraction(a, b, delta, tau) >= least, F.lit(False))


def seam_fraction(bottom: Column, bottom_width: Column, top: Column, top_width: Column, delta, rows: int = 4, tau: int = 24) -> Column:
    """Share of close pixels where one image stands on another: the last rows of bottom, upward, against the first of top, downward.

    The narrower width, both centred, is sampled at about 256 columns; the pair of touching rows counts twice. Null if a side holds no row.
    """
    w = F.least(bottom_width, top_width)
    high = lambda px, width: F.floor(F.size(px) / width).cast("int")
    n = F.least(F.lit(rows), high(bottom, bottom_width), high(top, top_width))
    step = F.greatest(F.lit(1), F.floor(w / 256)).cast("int")
    left = lambda width: F.floor((width - w) / 2).cast("int")

    def close(r: Column, x: Column) -> Column:
        a = F.get(bottom, (high(bottom, bottom_width) - 1 - r) * bottom_width + left(bottom_width) + x)
        b = F.get(top, r * top_width + left(top_width) + x)
        return F.when(delta(a, b) <= tau, F.when(r == 0, 2).otherwise(1)).otherwise(0)

    columns = F.sequence(F.lit(0), w - 1, step)
    hits = F.aggregate(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.transform(columns, lambda x: close(r, x)))), F.lit(0), lambda t, x: t + x)
    return F.when((w > 0) & (n > 0), hits / ((n + 1) * F.size(columns)))


def seam_continues(bottom: Column, bottom_width: Column, top: Column, top_width: Column, delta, least: float = 0.9) -> Column:
    return F.coalesce(seam_fraction(bottom, bottom_width, top, top_width, delta) >= least, F.lit(False))


def variance(lum: Column) -> Column:
    """Of all values of an image, over their number; 0 of an empty one. One pass over whole sums."""
    sums = F.aggregate(lum, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")), lambda t, v: F.struct((t["s"] + v).alias("s"), (t["q"] + v.cast("long") * v).alias("q")))
    n = F.size(lum)
    of = lambda t: F.coalesce(F.try_divide(n * t["q"] - t["s"] * t["s"], n.cast("double") * n), F.lit(0.0))
    return F.get(F.transform(F.array(sums), of), F.lit(0))


def paper_bin(lum: Column) -> Column:
    """Bins 0..15 of the sampled row, for paper_estimate."""
    return F.transform(strided(lum, 64), lambda v: F.least(F.lit(15), F.greatest(F.lit(0), F.shiftright(v * 16, 8))))


def ink_density(lum: Column, edge: int = 24) -> Column:
    """Share of neighbour steps above edge."""
    steps = F.zip_with(F.slice(lum, F.lit(1), F.greatest(F.size(lum) - 1, F.lit(0))), F.slice(lum, 2, F.greatest(F.size(lum), F.lit(1))), lambda a, b: F.when(F.abs(a - b) > edge, 1).otherwise(0))
    return F.when(F.size(lum) >= 2, F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(0), lambda t, x: t + x) / (F.size(lum) - 1)).otherwise(F.lit(0.0))


def proportional_height(top: Column, bottom: Column, width: Column, to_width: Column) -> Column:
    """Rows of a piece scaled to to_width, 1 at least."""
    return F.greatest(F.lit(1), F.floor((bottom - top) * to_width / F.greatest(width, F.lit(1)))).cast("long")


def effective_window(height: Column, cut_top: Column, cut_bottom: Column) -> tuple[Column, Column]:
    top = F.least(F.greatest(cut_top, F.lit(0)), height)
    return top, F.least(F.greatest(height - cut_bottom, top + 1), height)


def preview_scale(width: Column, height: Column, longest: int = 1280) -> Column:
    """By how much a preview is smaller, 1 at most."""
    return F.least(F.lit(1.0), longest / F.greatest(width, height, F.lit(1)))


def sample_size(count: Column, most: int = 16_000_000) -> Column:
    """The least power of two by which both sides are divided so that at most most pixels are left."""
    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda n: F.floor(count / (n.cast("long") * n)) <= most), F.lit(0))


def width_confidence(difference: Column, close: float = 0.2) -> Column:
    return F.when(difference <= close, 1.0).when(difference <= 0.5, 0.7).otherwise(0.4)


def combined_score(mask: Column, gray: Column, edge: Column, dark: Column, diff: Column, confidence: Column) -> Column:
    return (mask * 0.25 + gray * 0.30 + edge * 0.18 + dark * 0.25 + diff * 0.02) * confidence


def overlap_score(inter: Column, a: Column, b: Column) -> Column:
    """0.75 F1 + 0.25 IoU of two masks by their counts; 0 if either is empty."""
    f1 = F.try_divide(2.0 * inter, a + b)
    iou = F.try_divide(inter.cast("double"), a + b - inter)
    return F.when((a > 0) & (b > 0), F.coalesce(f1, F.lit(0.0)) * 0.75 + F.coalesce(iou, F.lit(0.0)) * 0.25).otherwise(F.lit(0.0))


def is_match(score: Column, mask: Column, gray: Column, edge: Column, dark: Column, width_difference: Column, least: float = 0.58) -> Column:
    normal = (score >= least) & ((gray >= 0.30) | (edge >= 0.18) | (dark >= 0.28)) & (width_difference <= 0.5)
    strong = (dark >= 0.42) & ((gray >= 0.22) | (edge >= 0.12) | (mask >= 0.88))
    return normal | strong | ((mask >= 0.93) & (gray >= 0.45))


def tier(score: Column) -> Column:
    return F.when(score >= 0.90, "strong").when(score >= 0.70, "medium").otherwise("none")
