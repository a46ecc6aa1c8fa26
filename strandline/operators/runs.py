"""Regions of masks as graphs of runs: rows of an image, one a table row, in parts of any number of tasks.

A row's true stretches are runs; runs of adjacent rows that overlap are joined. A part labels its own runs in one pass over its rows, and only the
runs on either side of a part's edge take part in joining parts. So an image is worked on by as many tasks as it has parts, whatever its height.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.folds import fold_sorted
from strandline.operators.masks import in_parts
from strandline.runtime import shared_table, ship

PART_ROWS = 1 << 12


def _flat(masks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the arrays of a batch, one after the other; null arrays are empty, null values false."""
    return masks.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool), masks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.bool_()))


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of each flat value."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs_of(masks: pa.Array) -> pa.Array:
    v, n = _flat(masks)
    row, x = _places(n)
    starts = np.flatnonzero(v & ((x == 0) | ~np.r_[False, v[:-1]]))
    ends = np.flatnonzero(v & ((x == n[row] - 1) | ~np.r_[v[1:], False]))
    ofs = np.r_[0, np.cumsum(np.bincount(row[starts], minlength=len(n)))]
    return pa.ListArray.from_arrays(pa.array(ofs, pa.int32()), pa.StructArray.from_arrays([pa.array(x[starts], pa.int32()), pa.array(x[ends] + 1, pa.int32())], names=["x0", "x1"]))


def _all_of(masks: pa.Array, *others: pa.Array) -> pa.Array:
    """masks where all others of the row are true too; what they don't hold is false."""
    v, n = _flat(masks)
    row, x = _places(n)
    for o in others:
        w, m = _flat(o)
        there = x < m[row]
        at = (np.cumsum(m) - m)[row] + x
        v[~there] = False
        v[there] &= w[at[there]]
    return _rows(v, n)


def _within(masks: pa.Array, spans: pa.Array) -> pa.Array:
    """masks where one of the row's spans (x0, x1) holds the place."""
    v, n = _flat(masks)
    row, _ = _places(n)
    of = np.repeat(np.arange(len(n)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    a, b = (np.clip(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64), 0, n[of]) for i in (0, 1))
    # one place more a row, where what goes on to its end is closed
    first = np.cumsum(n + 1) - n - 1
    edge = np.zeros(int((n + 1).sum()) + 1, np.int64)
    np.add.at(edge, first[of] + a, 1)
    np.add.at(edge, first[of] + np.maximum(a, b), -1)
    return _rows(v & (np.cumsum(edge)[np.arange(len(v)) + row] > 0), n)


def _on_arrays(work: Callable[..., pa.Array], gives: str, *columns: Column) -> Column:
    """work on whole batches of arrays. Not to be moved or repeated: a filter on what it gives would run it twice."""
    return F.arrow_udf(work, gives).asNondeterministic()(*columns)


def row_runs(mask: Column) -> Column:
    """array<struct<x0, x1>>: the maximal stretches of true values, x1 exclusive; null and empty masks have none."""

    def work(masks: pa.Array) -> pa.Array:
        return _runs_of(masks)

    return _on_arrays(work, "array<struct<x0: int, x1: int>>", mask)


class Sets:
    """Disjoint sets of things that are added in order; the first of a set stands for it."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def part_labels(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(y, x0, x1, label's y, label's x0) of the runs of a part's rows (y, runs), in one pass from top to bottom."""
    sets, runs, above, above_y = Sets(), [], [], None
    for y, found in rows:
        now = []
        first = 0
        for r in found:
            a, b, i = r["x0"], r["x1"], sets.add()
            runs.append((y, a, b))
            if above_y == y - 1:
                while first < len(above) and above[first][1] <= a:
                    first += 1
                k = first
                while k < len(above) and above[k][0] < b:
                    sets.join(i, above[k][2])
                    k += 1
            now.append((a, b, i))
        above, above_y = now, y
    for i, (y, a, b) in enumerate(runs):
        y0, x0, _ = runs[sets.find(i)]
        yield y, a, b, y0, x0


def joined_labels(edges: Iterator[tuple]) -> Iterator[tuple]:
    """(label, the first label joined with it) of the labels of edges (y, x, y, x), where they differ."""
    sets, ids, names = Sets(), {}, []
    pairs = [((a, b), (c, d)) for a, b, c, d in edges]
    for name in sorted({n for p in pairs for n in p}):
        ids[name] = sets.add()
        names.append(name)
    for a, b in pairs:
        sets.join(ids[a], ids[b])
    for name, i in ids.items():
        to = names[sets.find(i)]
        if to != name:
            yield *name, *to


def labelled_runs(rows: DataFrame, keys: list[str], order: str, mask: str, part_rows: int = PART_ROWS) -> DataFrame:
    """keys, y, x0, x1, label_y, label_x: the runs of each image's mask, 4-connected ones with the label of their region, its first run.

    rows: keys, order (whole numbers; rows that aren't there part regions) and a boolean array. Only runs on part edges pass through one task an image.
    """
    ship(rows.sparkSession)
    d = rows.select(*keys, F.col(order).cast("long").alias("_y"), row_runs(F.col(mask)).alias("_r")).where(F.size("_r") > 0).withColumn("_part", F.floor(F.col("_y") / part_rows))
    local = fold_sorted(d, [*keys, "_part"], ["_y"], ["_y", "_r"], part_labels, "y long, x0 int, x1 int, label_y long, label_x int")
    local = shared_table(local.drop("_part"))
    names = [f"_k{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    low = local.where(F.pmod("y", F.lit(part_rows)) == part_rows - 1)
    high = local.where(F.pmod("y", F.lit(part_rows)) == 0).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(F.col(c).alias(f"_{c}") for c in ("y", "x0", "x1", "label_y", "label_x")))
    touching = low.join(high, same & (F.col("y") + 1 == F.col("_y")) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")))
    edges = touching.select(*keys, "label_y", "label_x", "_label_y", "_label_x").distinct()
    moved = fold_sorted(edges, keys, ["label_y"], ["label_y", "label_x", "_label_y", "_label_x"], joined_labels, "from_y long, from_x int, to_y long, to_x int")
    moved = moved.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), "from_y", "from_x", "to_y", "to_x")
    out = local.join(moved, same & (F.col("label_y") == F.col("from_y")) & (F.col("label_x") == F.col("from_x")), "left")
    return out.select(*keys, "y", "x0", "x1", F.coalesce("to_y", "label_y").alias("label_y"), F.coalesce("to_x", "label_x").alias("label_x"))


def sizes(rows: DataFrame, keys: list[str], order: str, values: str) -> DataFrame:
    """keys, rows, columns of each image, whose rows count from 0."""
    return rows.groupBy(*keys).agg((F.max(order) + 1).alias("rows"), F.max(F.size(values)).alias("columns"))


def regions(labelled: DataFrame, keys: list[str], images: DataFrame) -> DataFrame:
    """keys, label_y, label_x, area, top, bottom, left, right (both exclusive at the far end), border: each region of labelled_runs(); images: sizes()."""
    d = labelled.join(images, keys)
    border = (F.col("y") == 0) | (F.col("y") == F.col("rows") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("columns"))
    return d.groupBy(*keys, "label_y", "label_x").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.bool_or(border).alias("border"))


def paper_level(rows: DataFrame, keys: list[str], order: str, lum: str, images: DataFrame) -> DataFrame:
    """keys, level: the upper median of an image's four borders, corners counted twice, from a histogram of at most 256 values."""
    d = rows.join(images.select(*keys, "rows"), keys)
    ends = F.array(F.get(lum, F.lit(0)), F.get(lum, F.size(lum) - 1))
    across = F.when((F.col(order) == 0) & (F.col("rows") == 1), F.concat(lum, lum)).when((F.col(order) == 0) | (F.col(order) == F.col("rows") - 1), F.col(lum)).otherwise(F.array().cast(rows.schema[lum].dataType))
    counts = d.select(*keys, F.explode(F.concat(ends, across)).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    all_of = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("upto", upto).withColumn("half", F.floor(all_of / 2)).where(F.col("upto") > F.col("half")).groupBy(*keys).agg(F.min("v").alias("level"))


def thinned(rows: DataFrame, keys: list[str], order: str, mask: str, by: int, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """out: values all of whose neighbours up to by rows and columns away are true; what lies outside an image counts as false."""
    ship(rows.sparkSession)

    def across(masks: pa.Array) -> pa.Array:
        v, n = _flat(masks)
        row, x = _places(n)
        upto, at = np.r_[0, np.cumsum(v)], np.arange(len(v))
        inside = (x >= by) & (x + by < n[row])
        return _rows(inside & (upto[np.minimum(at + by + 1, len(v))] - upto[np.maximum(at - by, 0)] == 2 * by + 1), n)

    def down(masks: pa.Array, *others: pa.Array) -> pa.Array:
        return _all_of(masks, *others)

    d = rows.withColumn(out, _on_arrays(across, "array<boolean>", F.col(mask)))

    def work(e: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy(order)
        near = [f(out, i).over(w) for i in range(1, by + 1) for f in (F.lag, F.lead)]
        e = e.withColumns({f"_n{i}": c for i, c in enumerate(near)})
        # rows beyond the image are null, and so false
        return e.withColumn(out, _on_arrays(down, "array<boolean>", F.col(out), *(F.col(f"_n{i}") for i in range(len(near))))).drop(*(f"_n{i}" for i in range(len(near))))

    return in_parts(d, keys, order, by, part_rows, work)


def enclosed_rows(rows: DataFrame, keys: list[str], order: str, lum: str, tolerance: int = 28, share: float = 0.04, largest: float = 0.20, close: int = 3, darkest: int = 110, out: str = "enclosed", part_rows: int = PART_ROWS) -> DataFrame:
    """keys, order, out: more than share of the row lies in bright regions that lines close off, without regions above largest of the image.

    rows: keys, order (from 0 without gaps) and luminances, one row a row of pixels; the form of morphology.enclosed() for images of any height. Bright is what is
    within tolerance of the paper; dark paper (below darkest) encloses nothing. Bright parts are thinned by close, so that small gaps in lines
    shut; what is then cut off from the image's border is grown back. Keys without null.
    """
    images = shared_table(sizes(rows, keys, order, lum))
    level = paper_level(rows, keys, order, lum, images)
    d = rows.select(*keys, order, lum).join(level, keys)
    bright = F.transform(lum, lambda v: (v >= F.col("level") - tolerance) & (F.col("level") >= darkest))
    d = shared_table(d.select(*keys, order, bright.alias("bright")))
    thin = thinned(d, keys, order, "bright", close, "thin", part_rows)
    inner = labelled_runs(thin, keys, order, "thin", part_rows)
    cut_off = regions(inner, keys, images).where(~F.col("border")).select(*keys, "label_y", "label_x")
    seeds = inner.join(cut_off, [*keys, "label_y", "label_x"])
    # a run grows by close to all sides: into the rows around it, and in each of them
    grown = seeds.select(*keys, F.explode(F.sequence(F.col("y") - close, F.col("y") + close)).alias(order), F.struct((F.col("x0") - close).alias("x0"), (F.col("x1") + close).alias("x1")).alias("r"))
    grown = grown.groupBy(*keys, order).agg(F.collect_set("r").alias("grown"))

    def held(masks: pa.Array, spans: pa.Array) -> pa.Array:
        return _within(masks, spans)

    shut = d.join(grown, [*keys, order]).withColumn("shut", _on_arrays(held, "array<boolean>", F.col("bright"), F.col("grown")))
    found = labelled_runs(shut.select(*keys, order, "shut"), keys, order, "shut", part_rows)
    # 32-bit floats, as the limits are
    limit = F.floor(((F.col("rows") * F.col("columns")).cast("float").cast("double") * F.lit(largest).cast("float").cast("double")).cast("float"))
    small = regions(found, keys, images).join(images, keys).where(F.col("area") <= limit).select(*keys, "label_y", "label_x")
    kept = found.join(small, [*keys, "label_y", "label_x"]).groupBy(*keys, F.col("y").alias(order)).agg(F.sum(F.col("x1") - F.col("x0")).alias("_n"))
    back = rows.select(*keys, order, F.size(lum).alias("_w")).join(kept, [*keys, order], "left")
    return back.select(*keys, order, F.coalesce((F.col("_n") / F.col("_w")).cast("float") > F.lit(share).cast("float"), F.lit(False)).alias(out))
