"""Similarity of rows and templates: correlation, best template, gates by a reference row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import pixels
from strandline.runtime import ship


def ncc(a: Column, b: Column) -> Column:
    """Zero-mean correlation of two arrays of numbers, 0 if either is flat, between -1 and 1. One pass over sums, exact for whole numbers."""
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("n", "a", "b", "aa", "bb", "ab")))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))

    def add(t: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct((t["n"] + 1).alias("n"), (t["a"] + x).alias("a"), (t["b"] + y).alias("b"), (t["aa"] + x * x).alias("aa"), (t["bb"] + y * y).alias("bb"), (t["ab"] + x * y).alias("ab"))

    def end(t: Column) -> Column:
        va, vb = t["n"] * t["aa"] - t["a"] * t["a"], t["n"] * t["bb"] - t["b"] * t["b"]
        r = F.try_divide(t["n"] * t["ab"] - t["a"] * t["b"], F.sqrt(va) * F.sqrt(vb))
        return F.when((va <= 0) | (vb <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))

    return F.aggregate(pairs, zero, add, end)


def best_template(regions: DataFrame, templates: DataFrame, vec: str, template_id: str, template_vec: str, digits: int | None = None, most: int = 1000) -> DataFrame:
    """regions with best_template and best_score: the highest correlation above 0, of equal ones the least id; null and 0.0 if none is.

    The templates travel with the tasks as one matrix, so their number must be small: most is checked first. A batch of regions is
    one matrix product. Vectors of another length than a template's score 0 with it. digits: scores are rounded before they compete.
    """
    ship(regions.sparkSession)
    rows = templates.select(F.col(template_id).alias("i"), F.col(template_vec).alias("v")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    by_size: dict[int, list] = {}
    for r in sorted((r for r in rows if r["v"]), key=lambda r: r["i"]):
        by_size.setdefault(len(r["v"]), []).append(r)
    held = {n: ([r["i"] for r in rs], _unit(np.array([r["v"] for r in rs], dtype=np.float64))) for n, rs in by_size.items()}
    kind = templates.schema[template_id].dataType.simpleString()

    @F.pandas_udf(f"i {kind}, s double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        ids, scores = [None] * len(vectors), np.zeros(len(vectors))
        sizes = np.array([0 if v is None else len(v) for v in vectors])
        for n, (names, unit) in held.items():
            at = np.flatnonzero(sizes == n)
            if len(at):
                s = np.clip(_unit(np.stack(vectors.iloc[at]).astype(np.float64)) @ unit.T, -1, 1)
                s = s if digits is None else np.round(s, digits)
                top = s.argmax(axis=1)
                for row, k in zip(range(len(at)), top):
                    if s[row, k] > 0:
                        ids[at[row]], scores[at[row]] = names[k], s[row, k]
        return pd.DataFrame({"i": pd.Series(ids, dtype=object), "s": scores})

    d = regions.withColumn("_b", best(vec))
    return d.withColumn("best_template", F.col("_b.i")).withColumn("best_score", F.col("_b.s")).drop("_b")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and length 1; flat rows are 0."""
    x = x - x.mean(axis=1, keepdims=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-9)


def equalised(df: DataFrame, key: str, lum: str, out: str = "gray") -> DataFrame:
    """Adds out: luminances spread over 0 to 255 by their rank, from each row's cumulative histogram; an image of one value stays as it is.

    key names a row. The histograms are aggregates of at most 256 values a row; null and empty arrays give null and empty ones.
    """
    counts = df.select(key, F.explode(lum).alias("_v")).groupBy(key, "_v").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    upto, least = F.sum("_n").over(w.orderBy("_v")), F.first("_n").over(w.orderBy("_v"))
    counts = counts.withColumn("_u", upto - least).withColumn("_all", F.sum("_n").over(w) - least)
    level = F.when(F.col("_all") == 0, F.col("_v")).otherwise(F.rint(F.col("_u") * 255 / F.col("_all")).cast("int"))
    tables = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_v", level))).alias("_t")).withColumnRenamed(key, "_k")
    return df.join(tables, F.col(key) == F.col("_k"), "left").withColumn(out, F.transform(lum, lambda v: F.element_at("_t", v))).drop("_k", "_t")


def _kept(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def likeness(region: Column, template: Column, least_edge: int = 60, least_dark: int = 20) -> Column:
    """struct<score, gray, edge, dark, mask, diff, width_difference> of a region and a template, structs of width, raw, gray, edge, dark and, for templates, mask.

    All arrays are on one grid: raw and gray hold luminances, the others flags. Edges and dark parts count where both have more than the least of them. Differences are
    looked at within the template's mask, and all over.
    """
    apart = lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    alike = lambda mean: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - mean / 255.0))
    share = lambda r: F.greatest(F.lit(0.0), r)
    ink = lambda flags: F.transform(flags, lambda x: x.cast("int"))

    def scored(d: Column) -> Column:
        masked = F.zip_with(d, template["mask"], lambda x, m: F.when(m, x).otherwise(0.0))
        mask = alike(F.coalesce(F.try_divide(total(masked), _kept(template["mask"])), F.lit(0.0)))
        diff = alike(F.coalesce(F.try_divide(total(d), F.size(d)), F.lit(0.0)))
        gray = share(ncc(region["gray"], template["gray"]))
        edge = F.when((_kept(region["edge"]) > least_edge) & (_kept(template["edge"]) > least_edge), share(ncc(ink(region["edge"]), ink(template["edge"])))).otherwise(0.0)
        a, b = _kept(region["dark"]), _kept(template["dark"])
        inter = _kept(F.zip_with(region["dark"], template["dark"], lambda x, y: x & y))
        dark = F.when((a > least_dark) & (b > least_dark), pixels.overlap_score(inter, a, b)).otherwise(0.0)
        width = F.abs(region["width"] - template["width"]) / region["width"]
        parts = F.struct(gray.alias("gray"), edge.alias("edge"), dark.alias("dark"), mask.alias("mask"), diff.alias("diff"), width.alias("width_difference"))
        whole = lambda p: F.struct(pixels.combined_score(p["mask"], p["gray"], p["edge"], p["dark"], p["diff"], pixels.width_confidence(p["width_difference"])).alias("score"), *(p[c].alias(c) for c in ("gray", "edge", "dark", "mask", "diff", "width_difference")))
        return F.get(F.transform(F.array(parts), whole), F.lit(0))

    # bound once: a lambda computes what it names for each element
    return F.get(F.transform(F.array(apart(region["raw"], template["raw"])), scored), F.lit(0))


def best_match(regions: DataFrame, templates: DataFrame, region: str, template_id: str, template: str, most_bytes: int = 8 << 20, digits: int | None = None, **least: int) -> DataFrame:
    """regions with best_template, is_match and the parts of its likeness: the template of the highest score above 0, of equal ones the first by id; null if none.

    The templates go along as one row, whose size is checked first; a region's scores are one pass over it, so no row is multiplied. digits: scores are rounded before they compete.
    """
    size = templates.agg(F.sum(F.octet_length(F.to_json(template).cast("binary")))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates; {most_bytes} go along at most")
    held = templates.agg(F.array_sort(F.collect_list(F.struct(F.col(template_id).alias("i"), F.col(template).alias("t")))).alias("_all"))
    kind = templates.schema[template_id].dataType.simpleString()
    parts = "score double, gray double, edge double, dark double, mask double, diff double, width_difference double"
    none = F.lit(None).cast(f"struct<i:{kind},s:struct<{parts.replace(' double', ':double')}>>")
    near = lambda x: x if digits is None else F.round(x, digits)

    def better(best: Column, x: Column) -> Column:
        now = F.struct(x["i"].alias("i"), likeness(F.col(region), x["t"], **least).alias("s"))
        return F.get(F.transform(F.array(now), lambda n: F.when(near(n["s"]["score"]) > F.coalesce(near(best["s"]["score"]), F.lit(0.0)), n).otherwise(best)), F.lit(0))

    d = regions.crossJoin(F.broadcast(held)).withColumn("_b", F.aggregate("_all", none, better)).drop("_all")  # one row
    s = F.col("_b.s")
    hit = F.coalesce(pixels.is_match(s["score"], s["mask"], s["gray"], s["edge"], s["dark"], s["width_difference"]), F.lit(False))
    return d.withColumn("best_template", F.col("_b.i")).withColumn("is_match", hit).select("*", "_b.s.*").drop("_b")


def gate(df: DataFrame, keys: list[str], order: str, matches, vec: str, least: int = 3, out: str = "grouped") -> DataFrame:
    """out: the row matches its group's first row, if least rows or more do, or else its last row, if least rows or more do.

    matches: (column, column) -> boolean column.
    """
    need = max(2, least)
    refs = df.groupBy(*keys).agg(F.min_by(vec, order).alias("_f"), F.max_by(vec, order).alias("_l"))
    d = df.join(refs, keys).withColumn("_mf", matches(F.col("_f"), F.col(vec))).withColumn("_ml", matches(F.col("_l"), F.col(vec))).drop("_f", "_l")
    # counted before the shuffle, so a large group isn't gathered in one task as a window would
    counts = d.groupBy(*keys).agg(F.count_if("_mf").alias("_nf"), F.count_if("_ml").alias("_nl"))
    hit = F.when(F.col("_nf") >= need, F.col("_mf")).when(F.col("_nl") >= need, F.col("_ml")).otherwise(F.lit(False))
    return d.join(counts, keys).withColumn(out, hit).drop("_mf", "_ml", "_nf", "_nl")


def crop_decision(score_tier: Column, in_gate: Column) -> Column:
    """Crop at once on a strong template; on a medium one only if the gate agrees; without a template if the gate holds the page."""
    return F.when(score_tier == "strong", F.lit(True)).when(score_tier == "medium", in_gate).otherwise(in_gate)


def side_crops(df: DataFrame, keys: list[str], order: str, side: str, matches, least: int = 3, out: str = "crop") -> DataFrame:
    """out: whether this side of a page is cropped, from the columns <side> (its edge's vector) and <side>_score (of its best template)."""
    d = gate(df, keys, order, matches, side, least, "_gate")
    return d.withColumn(out, crop_decision(pixels.tier(F.coalesce(f"{side}_score", F.lit(0.0))), F.col("_gate"))).drop("_gate")
