"""Plans over whole series: banners, text, long profiles, safe masks and regions, each against a plain version."""

import random
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import lookup, masks, matching, morphology, ordered, planner, rows, runs, textblocks, transitions
from strandline.plans import banners, strips
from strandline.sources import images
from strandline.sources.settings import Settings

WHITE, BLACK = 0xFFFFFFFF, 0xFF000000


def noise(rng, h, w):
    return rng.integers(0, 256, (h, w)).astype(np.int64) * 65793


def page(rng, h=700, w=64, top=None, bottom=None):
    im = noise(rng, h, w)
    if top is not None:
        im[: len(top)] = top
    if bottom is not None:
        im[-len(bottom) :] = bottom
    return im


def as_pages(spark, data):
    rows_ = [(s, p, im.ravel().tolist(), im.shape[1], im.shape[0]) for s, p, im in data]
    return spark.createDataFrame(rows_, "series string, page int, px array<long>, width int, height int")


def found(df):
    return {(r["series"], r["page"]): (r["crop_top"], r["crop_bottom"], r["reason"]) for r in df.collect()}


def test_banners_by_gate_and_by_template(spark):
    rng = np.random.default_rng(1)
    a, b = noise(rng, 200, 64), noise(rng, 200, 64)
    data = [("top only", i, page(rng, top=a)) for i in range(4)] + [("top only", 4, page(rng))]
    data += [("cover", 0, page(rng))] + [("cover", i, page(rng, top=a, bottom=b)) for i in range(1, 4)]  # the last page is the reference
    data += [("few", i, page(rng, top=a)) for i in range(2)] + [("short", i, page(rng, h=599, top=a)) for i in range(5)]
    data += [("widths", i, page(rng, w=64 if i else 48)) for i in range(3)]
    pages = as_pages(spark, data)
    policy = banners.Policy(least_pages=3)
    by_gate = found(banners.banner_crops(pages, policy, gated=True))
    assert [by_gate["top only", i] for i in range(5)] == [(200, 0, "gate")] * 4 + [(0, 0, "none")]
    assert [by_gate["cover", i] for i in range(4)] == [(0, 0, "none")] + [(200, 200, "gate")] * 3
    assert {by_gate["few", i] for i in range(2)} == {(0, 0, "none")} and {by_gate["short", i] for i in range(5)} == {(0, 0, "short")}
    assert set(found(banners.banner_crops(pages, policy)).values()) <= {(0, 0, "none"), (0, 0, "short")}  # the source isn't known to have banners
    files = [("banners/a.png", images.write_png(a)), ("banners/broken.png", b"\x89PNG\r\n\x1a\nx"), ("banners/flat.png", images.write_png(np.full((20, 20), WHITE))), ("banners/note.txt", b"x"), ("banners/none.jpg", None)]
    templates = banners.read_templates(spark.createDataFrame(files, "path string, content binary"))
    assert [r["template"] for r in templates.collect()] == ["banners/a.png"]
    by_template = banners.banner_crops(pages, policy, templates, gated=F.col("series") == "cover")
    got = found(by_template)
    assert [got["few", i] for i in range(2)] == [(200, 0, "template")] * 2
    assert [got["cover", i] for i in range(4)] == [(0, 0, "none")] + [(200, 200, "both")] * 3
    notes = {r["series"]: (r["checked"], r["tops"], r["bottoms"], r["by_template"], r["by_gate"], r["note"]) for r in banners.report(by_template).collect()}
    assert notes["cover"] == (4, 3, 3, 3, 3, "cropped") and notes["short"] == (0, 0, 0, 0, 0, "no page is tall enough")
    assert notes["widths"][-1] == "no template matches and strips differ"
    assert banners.banner_crops(pages.where("false"), policy, templates, gated=True).count() == 0


def test_build_crops_banners_and_covers_the_rest(spark):
    rng = np.random.default_rng(4)
    banner = noise(rng, 200, 480)

    def comic():
        im = np.full((1500, 480), WHITE, dtype=np.int64)
        im[:200] = banner
        for a, b in ((300, 600), (900, 1450)):
            im[a:b, 40:440] = np.where(rng.random((b - a, 400)) < 0.5, BLACK, WHITE)
        return im

    data = [("s", i, comic()) for i in range(4)]
    pages = as_pages(spark, data).drop("height")
    out = strips.build(pages, Settings(max_height=1000, strictness="LOOSE"), gated=True).orderBy("segment").collect()
    for i in range(4):
        parts = [(r["start"], r["end"]) for r in out if r["page"] == i]
        assert parts[0][0] == 200 and parts[-1][1] == 1500 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(r["banner_cut"] for r in out)
    kept = strips.build(pages, Settings(max_height=1000, strictness="LOOSE", banner_cut=False), gated=True).collect()
    assert min(r["start"] for r in kept) == 0 and not any(r["banner_cut"] for r in kept)


def test_text_moves_a_cut(spark):
    im = np.full((800, 480), WHITE, dtype=np.int64)
    im[380:384, 100:140] = BLACK  # something that makes the surroundings suspect
    lines = np.array([[396, 404, 50, 200], [410, 420, 50, 200]])
    plain, guarded = morphology.verified_cut(im, 400), morphology.verified_cut(im, 400, lines=lines)
    assert plain == (400, False) and not guarded[1] and abs(guarded[0] - 400) > 10
    pages = as_pages(spark, [("s", 0, im)])
    cuts = spark.createDataFrame([("s", 0, 400, False, 64, 0, 800, 800)], "series string, page int, y long, forced boolean, gap int, top long, bottom long, height long")
    text = spark.createDataFrame([("s", 0, *map(int, r)) for r in lines] + [("s", 0, None, 3, 4, 5), ("t", 0, 1, 2, 3, 4)], "series string, page int, top int, bottom int, left int, right int")
    assert [r["y"] for r in strips.verify(cuts, pages, Settings()).collect()] == [plain[0]]
    assert [(r["y"], r["forced"]) for r in strips.verify(cuts, pages, Settings(), text).collect()] == [guarded]


def test_text_rows_equal_their_array_form(spark):
    rng = random.Random(3)
    data, lines, want = [], [], {}
    for k in ("a", "b", None):
        h = 400
        structured = np.array([rng.random() < 0.9 for _ in range(h)])
        longest = np.array([rng.randrange(40) for _ in range(h)])
        mine = [[t := rng.randrange(h - 20), t + rng.randrange(15), x := rng.randrange(60), x + rng.randrange(1, 40)] for _ in range(12 if k else 0)]
        data += [(k, y, bool(structured[y]), int(longest[y]), 100) for y in range(h)]
        lines += [(k, *m) for m in mine]
        cover = textblocks.covered(np.array(mine), structured, longest, 100) if mine else np.zeros(h, bool)
        want |= {(k, y): bool(cover[y]) for y in range(h)}
    profiles = spark.createDataFrame(data, "k string, y int, structured boolean, max_run int, width int")
    boxes = spark.createDataFrame(lines + [("a", None, 1, 2, 3), ("z", 1, 2, 3, 4)], "k string, top int, bottom int, left int, right int")
    got = textblocks.text_rows(profiles, boxes, ["k"], "y").collect()
    assert {(r["k"], r["y"]): r["text"] for r in got} == want and 0 < sum(want.values()) < 800
    assert not any(r["text"] for r in textblocks.text_rows(profiles, boxes.where("false"), ["k"], "y").collect())


@pytest.mark.parametrize("part_rows", [50, 1 << 16])
def test_long_plans_equal_whole_ones(spark, part_rows):
    rng = random.Random(9)
    data = [(k, y, rng.random() < share, rng.randrange(9), most) for k, n, share, most in (("long", 3000, 0.1, 24), ("dark", 700, 0.9, 30), ("free", 500, 0.01, 20), ("short", 9, 0.5, 20), (None, 260, 0.2, 20)) for y in range(n)]
    df = spark.createDataFrame(data, "k string, y long, busy boolean, ink int, most int").repartition(5)
    for least, beyond in ((None, None), (F.floor(F.col("most") * 4 / 5), 0)):
        how = (["k"], "y", "busy", "ink", F.col("most"), least, beyond, 3)
        want = sorted(map(str, planner.plan_cuts(df, *how).collect()))
        assert sorted(map(str, transitions.plan_long(df, *how, part_rows=part_rows).collect())) == want and len(want) > 100
    assert transitions.plan_long(df.where("false"), *how, part_rows=part_rows).count() == 0


def test_one_long_series_is_planned_by_many_tasks(spark):
    df = spark.range(4000).select(F.lit("s").alias("k"), F.col("id").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).alias("busy"), F.lit(0).alias("ink"))
    d = ordered.halo(df, ["k"], "y", 60, 200).repartition(16, "k", ordered.PART).withColumn("task", F.spark_partition_id())
    assert d.select("task").distinct().count() > 2 and d.select(ordered.PART).distinct().count() >= 20
    assert d.where(ordered.OWN).count() == 4000


def test_halo_masks_equal_whole_ones(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, y, rng.random() < 0.08) for k in ("a", None) for y in range(600)], "k string, y long, m boolean")
    for whole, parts in ((masks.zones(df, ["k"], "y", "m"), masks.zones(df, ["k"], "y", "m", part_rows=31)), (masks.dilate(df, ["k"], "y", "m", 5), masks.dilate(df, ["k"], "y", "m", 5, part_rows=7))):
        assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(*whole.columns).collect()))


def gray_image(rng):
    im = np.full((80, 40), 250)
    im[20:24, 5:30] = 0
    im[40:60] = 180  # a wash of grey, even but not paper
    return np.clip(im + rng.integers(-2, 3, im.shape), 0, 255)


def test_paper_aware_rows_reject_a_gray_wash(spark):
    im = gray_image(np.random.default_rng(3))
    df = spark.createDataFrame([("k", y, r.tolist()) for y, r in enumerate(im)], "k string, y long, lum array<int>")
    even = [np.abs(np.diff(r)).max() <= 24 for r in im]
    near_paper = [abs(int(np.sort(r)[len(r) // 2]) - 248) <= 48 for r in im]
    like = lambda y, z: not 0 <= z < len(im) or np.abs(im[y] - im[z]).max() <= 20
    want = [even[y] and near_paper[y] and like(y, y - 1) and like(y, y + 1) for y in range(80)]
    for part_rows in (8, 1 << 12):
        got = rows.paper_safe(df, ["k"], "y", "lum", part_rows=part_rows).orderBy("y").collect()
        assert [r["safe"] for r in got] == want and not any(want[40:60]) and any(want)
    assert rows.paper_safe(df.where("false"), ["k"], "y", "lum").count() == 0


@pytest.mark.parametrize("margin,step", [(0, 1), (5, 3)])
def test_level_bands(spark, margin, step):
    im = gray_image(np.random.default_rng(3))
    df = spark.createDataFrame([("k", y, r.tolist()) for y, r in enumerate(im)] + [("narrow", 0, [200] * 10), ("none", 0, None)], "k string, y long, lum array<int>")
    tau = 25
    inner = im[:, margin : 40 - margin]
    smooth = [np.abs(np.diff(r)).max() <= tau for r in inner]
    want = [y % step == 0 and all(smooth[z] and np.abs(inner[y] - inner[z]).max() <= tau for z in range(max(0, y - 6), min(80, y + 7))) for y in range(80)]
    for part_rows in (8, 1 << 12):
        got = {(r["k"], r["y"]): r["safe"] for r in rows.level_safe(df, ["k"], "y", "lum", 0.9, margin, step, part_rows=part_rows).collect()}
        assert [got["k", y] for y in range(80)] == want and any(want)
        assert got["narrow", 0] == (margin == 0) and not got["none", 0]


def flooded(mask):
    """[(first cell, cells)] of the 4-connected regions of a mask."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            seen[y, x], cells, due = True, [], deque([(y, x)])
            while due:
                a, b = due.popleft()
                cells.append((a, b))
                for p, q in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        due.append((p, q))
            out.append(((int(y), int(x)), cells))
    return out


@pytest.mark.parametrize("part_rows", [1, 3, 1 << 12])
def test_regions_equal_a_flood(spark, part_rows):
    rng = np.random.default_rng(6)
    pictures = {"half": rng.random((40, 30)) < 0.55, "full": np.ones((25, 4), bool), "none": np.zeros((5, 5), bool), "sparse": rng.random((30, 30)) < 0.2}
    spiral = np.zeros((21, 21), bool)
    for i in range(0, 21, 2):
        spiral[i] = True
        spiral[i : i + 2, 0 if i % 4 else 20] = True
    pictures["spiral"] = spiral
    df = spark.createDataFrame([(k, y, r.tolist(), [1] * len(r)) for k, m in pictures.items() for y, r in enumerate(m)] + [("null", 0, None, [1])], "k string, y int, m array<boolean>, v array<int>")
    got = runs.regions(runs.labelled_runs(df, ["k"], "y", "m", part_rows), ["k"], runs.sizes(df, ["k"], "y", "v"))
    want = set()
    for k, m in pictures.items():
        for first, cells in flooded(m):
            ys, xs = zip(*cells)
            border = min(ys) == 0 or max(ys) == m.shape[0] - 1 or min(xs) == 0 or max(xs) == m.shape[1] - 1
            want.add((k, *first, len(cells), int(min(ys)), int(max(ys)) + 1, int(min(xs)), int(max(xs)) + 1, border))
    assert set(map(tuple, got.collect())) == want


def test_enclosed_rows_equal_their_array_form(spark):
    rng = np.random.default_rng(8)
    boxes = np.full((60, 50), 240)
    for y, x, h, w in ((5, 5, 20, 18), (30, 10, 14, 30), (8, 30, 9, 9)):
        boxes[y : y + h, x], boxes[y : y + h, x + w - 1], boxes[y, x : x + w], boxes[y + h - 1, x : x + w] = 0, 0, 0, 0
    boxes[12, 5] = 240  # a gap in a line, small enough to shut
    pictures = {"boxes": boxes, "noise": rng.integers(0, 256, (40, 50)), "dark": np.full((20, 20), 50), "one": np.full((1, 9), 200), "open": np.where(rng.random((40, 50)) < 0.03, 0, 250)}
    df = spark.createDataFrame([(k, y, r.tolist()) for k, m in pictures.items() for y, r in enumerate(m)], "k string, y int, lum array<int>")
    want = {(k, y): bool(v) for k, m in pictures.items() for y, v in enumerate(morphology.enclosed(m.astype(np.int64) * 65793))}
    assert any(want[k] for k in want if k[0] == "boxes")
    for part_rows in (8, 1 << 12):
        got = {(r["k"], r["y"]): r["enclosed"] for r in runs.enclosed_rows(df, ["k"], "y", "lum", part_rows=part_rows).collect()}
        assert got == want


def test_two_phase_masks_on_one_long_key(spark):
    rng = random.Random(12)
    flags = [rng.random() < 0.3 for _ in range(3000)]
    df = spark.createDataFrame([("k", y, f) for y, f in enumerate(flags)] + [(None, 0, True), (None, 1, False)], "k string, y long, m boolean").repartition(7)
    assert ordered.dealt(df, ["k"], "y", 8).where("k = 'k'").select(ordered.PART).distinct().count() > 2
    true, free = [y for y in range(3000) if flags[y]], [y for y in range(3000) if not flags[y]]
    groups = [[true[0]]]
    for y in true[1:]:
        groups[-1].append(y) if y - groups[-1][-1] - 1 <= 3 else groups.append([y])
    assert sorted((r["first"], r["last"]) for r in masks.sessionise(df, ["k"], "y", "m", 3).where("k = 'k'").collect()) == [(g[0], g[-1]) for g in groups]
    runs_ = [(a, b) for a, b in planner.runs(np.array(flags), 2)]
    assert sorted((r["start"], r["end"]) for r in masks.islands(df, ["k"], "y", F.col("m"), 2).where("k = 'k'").collect()) == runs_
    near = {r["y"]: r["nearest"] for r in masks.nearest_free(df, ["k"], "y", "m", 9).where("k = 'k'").collect()}
    assert near == {y: min((z for z in free if abs(z - y) <= 9), key=lambda z: (abs(z - y), z), default=None) for y in range(3000)}
    last = {r["y"]: r["v"] for r in lookup.as_of(df, ["k"], ["y"], F.col("m"), F.col("y"), "v").where("k = 'k'").collect()}
    assert last == {y: max((z for z in true[: y + 1] if z <= y), default=None) for y in range(3000)}


def test_best_match_equals_a_plain_version(spark):
    rng = np.random.default_rng(14)

    def picture(i):
        raw = rng.integers(0, 256, 40)
        return {"width": int(rng.integers(30, 90)), "raw": raw.tolist(), "gray": raw[::-1].tolist(), "edge": (raw > 100).tolist(), "dark": (raw < 140).tolist(), "mask": (raw < 230).tolist() if i else [False] * 40}

    def ncc(a, b):
        a, b = np.asarray(a, float) - np.mean(a), np.asarray(b, float) - np.mean(b)
        n = np.sqrt((a * a).sum() * (b * b).sum())
        return max(0.0, float((a * b).sum() / n)) if n > 0 else 0.0

    def plain(r, t):
        d = np.abs(np.array(r["raw"]) - np.array(t["raw"]))
        m = np.array(t["mask"])
        mask, diff = 1 - (d[m].mean() if m.any() else 0) / 255, 1 - d.mean() / 255
        edge = ncc(r["edge"], t["edge"]) if sum(r["edge"]) > 10 and sum(t["edge"]) > 10 else 0
        a, b, i = sum(r["dark"]), sum(t["dark"]), sum(x and y for x, y in zip(r["dark"], t["dark"]))
        dark = 0.75 * 2 * i / (a + b) + 0.25 * i / (a + b - i) if a > 20 and b > 20 else 0
        w = abs(r["width"] - t["width"]) / r["width"]
        return (mask * 0.25 + ncc(r["gray"], t["gray"]) * 0.3 + edge * 0.18 + dark * 0.25 + diff * 0.02) * (1.0 if w <= 0.2 else 0.7 if w <= 0.5 else 0.4)

    kind = "struct<width:int,raw:array<int>,gray:array<int>,edge:array<boolean>,dark:array<boolean>,mask:array<boolean>>"
    regions, templates = [(i, picture(i)) for i in range(60)], [(i, picture(i)) for i in range(7)]
    regions.append((60, templates[3][1]))
    templates.append((9, templates[3][1]))  # of equal templates the first
    r, t = spark.createDataFrame(regions, f"id int, p {kind}"), spark.createDataFrame(templates, f"t int, p {kind}")
    got = {x["id"]: (x["best_template"], round(x["score"], 9)) for x in matching.best_match(r, t, "p", "t", "p", digits=9, least_edge=10).collect()}
    want = {i: max(((k, round(plain(p, q), 9)) for k, q in templates), key=lambda x: (x[1], -x[0])) for i, p in regions}
    assert got == want and got[60][0] == 3
    assert {x["best_template"] for x in matching.best_match(r, t.where("false"), "p", "t", "p").collect()} == {None}
    with pytest.raises(ValueError):
        matching.best_match(r, t, "p", "t", "p", most_bytes=10)


def test_equalised(spark):
    df = spark.createDataFrame([(1, [10, 10, 20, 30]), (2, [7, 7]), (3, []), (4, None)], "id int, lum array<int>")
    got = {r["id"]: r["gray"] for r in matching.equalised(df, "id", "lum").collect()}
    assert got == {1: [0, 0, 128, 255], 2: [7, 7], 3: [], 4: None}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_zones_look_ahead_without_frames_that_grow_with_the_part(spark):
    """A frame that ends with the part is gone through anew for each row, so the work of a part was its square."""
    df = spark.createDataFrame([("a", y, y in (100, 110, 400)) for y in range(500)], "k string, y long, m boolean")
    found = masks.zones(df, ["k"], "y", "m", part_rows=64)
    assert "unboundedfollowing" not in _plan(found)
    assert sorted(r["y"] for r in found.where("zone").collect()) == [*range(88, 123), 400]


def test_thinned_rows_have_no_work_by_element(spark):
    """Lambdas that name a row's thinned values computed them anew for each element."""
    df = spark.createDataFrame([("a", y, [True] * 9) for y in range(9)], "k string, y long, m array<boolean>")
    thin = runs.thinned(df, ["k"], "y", "m", 2, "t", 4)
    assert not {"zip_with", "transform(", "exists("} & set(re.findall(r"zip_with|transform\(|exists\(", _plan(thin.select(runs.row_runs(F.col("t"))))))
    assert {(r["y"], x) for r in thin.collect() for x, v in enumerate(r["t"]) if v} == {(y, x) for y in range(2, 7) for x in range(2, 7)}
