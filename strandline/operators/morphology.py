"""Pixel regions closed off by lines, and structure at the edges of pages. Images come one per row."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.planner import near
from strandline.operators.rows import luma_of, profile_row
from strandline.operators.textblocks import covered
from strandline.runtime import ship


def erode(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    """3 x 3 erosion; what lies outside counts as false."""
    for _ in range(rounds):
        p = np.pad(mask, 1)
        rows = p[:-2] & p[1:-1] & p[2:]
        mask = rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:]
    return mask


def dilate(mask: np.ndarray, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        p = np.pad(mask, 1)
        rows = p[:-2] | p[1:-1] | p[2:]
        mask = rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]
    return mask


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components: labels from 1, and their number."""
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int64)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        out[y, x] = n
        due = deque([(y, x)])
        while due:
            a, b = due.pop()
            for p, q in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= p < h and 0 <= q < w and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    due.append((p, q))
    return out, n


def from_border(mask: np.ndarray) -> np.ndarray:
    """Cells of mask that are connected with the border."""
    label, n = labelled(mask)
    edge = np.zeros(n + 1, dtype=bool)
    for line in (label[0], label[-1], label[:, 0], label[:, -1]):
        edge[line] = True
    edge[0] = False
    return edge[label]


def paper(lum: np.ndarray) -> int:
    """Upper median of the four borders, corners counted twice."""
    s = np.sort(np.concatenate([lum[0], lum[-1], lum[:, 0], lum[:, -1]]))
    return int(s[len(s) // 2])


def enclosed(px: np.ndarray, tolerance: int = 28, share: float = 0.04, largest: float = 0.20, close: int = 3, darkest: int = 110) -> np.ndarray:
    """Rows of which more than share lies in bright regions that lines close off, without regions above largest of the image."""
    h, w = px.shape
    lum = luma_of(px.astype(np.int64))
    level = paper(lum) if h and w else 0
    if level < darkest:
        return np.zeros(h, dtype=bool)
    bright = lum >= level - tolerance
    thin = erode(bright, close)
    shut = dilate(thin & ~from_border(thin), close) & bright
    label, n = labelled(shut)
    area = np.bincount(label.ravel(), minlength=n + 1)
    small = area <= int(w * h * np.float32(largest))
    small[0] = False
    return (small[label].sum(axis=1) / np.float32(w)) > np.float32(share)


def zone_rows(mask: np.ndarray, gap: int = 16, expand: int = 12) -> np.ndarray:
    """The array form of masks.zones."""
    out = np.zeros(len(mask), dtype=bool)
    at = np.flatnonzero(mask)
    for part in np.split(at, np.flatnonzero(np.diff(at) - 1 > gap) + 1):
        if len(part):
            pad = expand if len(part) > 1 else 0
            out[max(0, part[0] - pad) : part[-1] + pad + 1] = True
    return out


def scan(px: np.ndarray, edge: int = 24, spread: int = 40, noise: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """busy, ink, structured, max_run of an image's rows."""
    rows = [profile_row(r, edge, spread, noise=noise) for r in luma_of(px.astype(np.int64))]
    b, i, s, m = zip(*rows) if rows else ((), (), (), ())
    return np.array(b, dtype=bool), np.array(i, dtype=np.int64), np.array(s, dtype=bool), np.array(m, dtype=np.int64)


def touches_edge(px: np.ndarray, top: bool, dark: int = 28, run: int = 10, rows: int = 16) -> bool:
    """Whether structure reaches the top (or bottom) of a patch: an upright stroke, or a long level line among unstructured rows."""
    h, w = px.shape
    if not w or h < rows:
        return False
    lum = luma_of(px.astype(np.int64))
    middle = np.sort(lum[h // 2][:: max(1, w // 200)])
    ground = middle[len(middle) // 2]
    edge = lum[:rows] if top else lum[::-1][:rows]
    off = (np.abs(edge - ground) > dark)[:, ::2]
    length = np.zeros(off.shape[1], dtype=np.int64)
    for line in off:
        length = np.where(line, length + 1, 0)
        if (length >= run).any():
            return True
    part = px[:8] if top else px[max(0, h - 8) :]
    _, _, structured, longest = scan(part)
    return bool((~structured & (longest >= w // 4)).any())


def has_content(px: np.ndarray, spread: int = 64) -> bool:
    """The array form of pixels.has_content for a patch of packed pixels."""
    flat = px.reshape(-1)
    if not len(flat):
        return False
    s = flat[:: max(1, len(flat) // 512)].astype(np.int64)
    sums = (s >> 16 & 255) + (s >> 8 & 255) + (s & 255)
    return bool(sums.max() - sums.min() > spread)


def verified_cut(px: np.ndarray, cut: int, edge: int = 24, spread: int = 40, half: int = 320, guard: int = 8, reach: int = 300, scan_width: int = 480, lines: np.ndarray | None = None, suspect: int = 96) -> tuple[int, bool]:
    """(row, bad): cut, or the nearest free row of its surroundings at full size (of equal distances the upper); bad where there is none.

    lines: text lines (top, bottom, left, right) in rows of px. Where a row within suspect of the cut is taken, rows there that blocks of lines cover are too.
    """
    h, w = px.shape
    top, bottom = max(0, cut - half), min(h, cut + half)
    if bottom - top < 8:
        return cut, False
    part = px[top:bottom]
    busy, _, structured, longest = scan(part, edge, spread, noise=3)
    scale = w / scan_width
    taken = busy | zone_rows(structured, max(8, int(16 * scale)), max(8, int(12 * scale))) | half_size_enclosed(part)
    centre = min(max(cut - top, 0), len(part) - 1)
    a, b = max(0, centre - suspect), min(len(part), centre + suspect + 1)
    if lines is not None and len(lines) and taken[a:b].any():
        seen = lines[(lines[:, 0] < top + b) & (lines[:, 1] >= top + a)] - [top + a, top + a, 0, 0]
        if len(seen):
            taken[a:b] |= covered(seen, structured[a:b], longest[a:b], w)
    blocked = near(taken, guard)
    free = np.flatnonzero(~blocked)
    if not blocked[centre]:
        return cut, False
    free = free[np.abs(free - centre) <= min(reach, len(part) // 2)]
    if not len(free):
        return cut, True
    return int(top + free[np.argmin(np.abs(free - centre) * 2 + (free > centre))]), False


def half_size_enclosed(px: np.ndarray) -> np.ndarray:
    h, w = px.shape
    if h < 4 or w < 4:
        return np.zeros(h, dtype=bool)
    hh, hw = h // 2, w // 2
    small = px[np.arange(hh) * h // hh][:, np.arange(hw) * w // hw]
    return enclosed(small)[np.minimum(np.arange(h) * hh // h, hh - 1)]


def keep_out(df: DataFrame, px: str, width: str, out: str = "enclosed_rows") -> DataFrame:
    """Adds out: array<boolean>, one value per row of the image in px (array of packed pixels, row by row)."""
    ship(df.sparkSession)

    @F.pandas_udf("array<boolean>")
    def run(images: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([enclosed(np.asarray(p, dtype=np.int64)[: len(p) // w * w].reshape(-1, w)).tolist() if p is not None and w and w > 0 else [] for p, w in zip(images, widths)])

    return df.withColumn(out, run(px, width))
