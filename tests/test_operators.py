"""The operators against the values their rules imply, and against plain Python on random input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import runtime
from strandline.functions import names, pixels
from strandline.functions.natural import natural_key
from strandline.operators import folds, grouping, lookup, masks, matching, morphology, ordered, planner, rows, textblocks
from strandline.plans import library, strips
from strandline.sources import archives, images
from strandline.sources.settings import Settings
from strandline.streaming.sessions import sessions

WHITE, BLACK = 0xFFFFFFFF, 0xFF000000


def flags(heights, limit, links=(), unsafe=()):
    sheets = [(i, h, i not in unsafe, (i - 1, i) in links) for i, h in enumerate(heights)]
    found = list(grouping.bundles_of(sheets, limit))
    return [[s[0] for s in b] for b, _, _ in found], [t for _, t, _ in found], [x for _, _, x in found]


@pytest.mark.parametrize(
    "heights, limit, links, unsafe, bundles, seams",
    [
        ([400, 400, 300, 500], 1000, (), (), [[0, 1], [2, 3]], [False] * 2),
        ([400] * 4, 1000, {(1, 2)}, (), [[0], [1, 2], [3]], [False] * 3),
        ([400] * 4, 1000, {(1, 2)}, {2}, [[0], [1, 2], [3]], [False] * 3),
        ([600] * 3, 1000, {(0, 1)}, (), [[0], [1], [2]], [False, True, False]),
        ([3000, 3000, 3000, 8000, 8000], 10000, {(2, 3)}, (), [[0, 1], [2, 3], [4]], [False] * 3),
        ([600] * 3, 1000, (), {1}, [[0], [1], [2]], [False, True, False]),
        ([600, 900], 1000, (), {1}, [[0], [1]], [False, True]),
        ([100, 9000, 300], 0, (), (), [[0, 1, 2]], [False]),
        ([100, 900, 200], 1000, {(1, 2)}, (), [[0], [1, 2]], [False] * 2),
    ],
)
def test_bundles(heights, limit, links, unsafe, bundles, seams):
    got, _, flagged = flags(heights, limit, links, unsafe)
    assert got == bundles and flagged == seams


def test_tall_sheets_stand_alone():
    assert flags([400, 2500, 300], 1000)[:2] == ([[0], [1], [2]], [False, True, False])


def test_grouping_frames(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randrange(1, 1400), rng.random() > 0.2, rng.random() < 0.3) for g in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(data, "g string, i long, h long, safe boolean, linked boolean")
    got = {(r["g"], r["i"]): (r["bundle"], r["tall"], r["seam_cut"]) for r in grouping.by_height(df, ["g"], "i", "h", 1000, "safe", "linked").collect()}
    for g in ("a", "b", None):
        sheets = [(i, h, s, x) for k, i, h, s, x in data if k == g]
        for n, (b, tall, seam) in enumerate(grouping.bundles_of(sheets, 1000), 1):
            for s in b:
                assert got[g, s[0]] == (n, tall, seam)
    assert [r["bundle"] for r in grouping.by_number(df.where("g = 'a'"), ["g"], "i", 25).orderBy("i").collect()] == [1] * 25 + [2] * 25 + [3] * 10
    assert grouping.group(df, ["g"], "i", "h", "WHOLE").select("bundle").distinct().count() == 1
    with pytest.raises(ValueError):
        grouping.group(df, ["g"], "i", "h", "NONE")


def busy(n, *spans):
    out = np.zeros(n, dtype=bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


def test_cut_plans():
    none = np.zeros(600, dtype=np.int64)
    assert planner.tiered(busy(400, (150, 260)), none, 200, 40, margin=4) == [(145, True), (345, False)]
    assert planner.tiered(~busy(400, (100, 109), (250, 399)), none, 200, 40, margin=4) == [(105, True), (305, False)]
    plan = planner.tiered(busy(400, (95, 115)), np.where(busy(400, (95, 115)), 50, 0), 200, 40, 50, 10)
    assert plan and not any(f for _, f in plan) and not any(85 <= y <= 125 for y, _ in plan) and 400 - plan[-1][0] <= 200
    plan = planner.tiered(busy(300, (0, 299)), none, 100, 40, margin=4)
    assert plan and all(f for _, f in plan)
    plan = planner.tiered(busy(600), none, 100, 40, margin=4)
    assert plan and not any(f for _, f in plan) and [y for y, _ in plan] == sorted(y for y, _ in plan) and 600 - plan[-1][0] <= 100
    with pytest.raises(ValueError):
        planner.tiered(busy(300), none, 100, 0)


def test_band_plans():
    assert planner.band_centres(busy(500), 100) == ([], False)
    cuts, tail = planner.band_centres(~busy(350), 100)
    assert tail and all(50 <= b - a <= 100 for a, b in zip([0, *cuts], cuts)) and 350 - cuts[-1] <= 100
    safe = busy(350, (0, 60), (330, 349))
    cuts, tail = planner.band_centres(safe, 100, 50, 250)
    assert tail and len(cuts) == 2 and 4 <= cuts[0] <= 60 and 334 <= cuts[1] <= 349
    assert planner.band_centres(safe, 100, 50)[1] is False and len(planner.band_centres(safe, 100, 50)[0]) == 1
    assert planner.search_up(busy(250, (90, 95), (170, 180)), 100) == ([95, 180], True)
    assert planner.search_up(busy(250, (90, 95)), 100) == ([95], False)
    assert planner.search_up(busy(250), 100, hard=True) == ([100, 200], True)
    assert planner.search_up(~busy(250), 100, ink=np.arange(250) % 7) == ([98, 196], True)


def test_masks_against_plain_python(spark):
    rng = random.Random(4)
    data = [(g, y, rng.random() < p) for g, p in (("a", 0.05), ("b", 0.3), ("c", 0.9), ("d", 0.0)) for y in range(150)]
    df = spark.createDataFrame(data, "g string, y long, m boolean")
    wide = {(r["g"], r["y"]): r["b"] for r in masks.dilate(df, ["g"], "y", "m", 3, "b").collect()}
    zone = {(r["g"], r["y"]): r["zone"] for r in masks.zones(df, ["g"], "y", "m", 6, 4).collect()}
    bands = {(r["g"], r["start"], r["end"]) for r in masks.safe_bands(df, ["g"], "y", "m", 3, 5).collect()}
    free = {(r["g"], r["y"]): r["nearest"] for r in masks.nearest_free(df, ["g"], "y", "m", 5).collect()}
    for g in "abcd":
        m = np.array([x for k, _, x in data if k == g])
        near = planner.near(m, 3)
        assert [wide[g, y] for y in range(150)] == near.tolist()
        assert [zone[g, y] for y in range(150)] == morphology.zone_rows(m, 6, 4).tolist()
        assert {b for b in bands if b[0] == g} == {(g, a, b) for a, b in planner.runs(~near, 5)}
        at = np.flatnonzero(~m)
        for y in range(150):
            best = min(at, key=lambda f: (abs(f - y), f))
            assert free[g, y] == (best if abs(best - y) <= 5 else None)
    with pytest.raises(ValueError):
        masks.dilate(df, [], "y", "m", 1)


def test_zone_values():
    m = busy(100, (10, 12), (20, 21), (70, 71))
    assert planner.runs(morphology.zone_rows(m, 20, 20)) == [(0, 42), (50, 92)]
    assert planner.runs(morphology.zone_rows(busy(100, (50, 50)), 20, 20)) == [(50, 51)]


def test_thin_and_segments(spark):
    cuts = spark.createDataFrame([("a", y) for y in (3, 6, 9, 10, 20, 29, 30)] + [("b", 5)], "g string, y long")
    assert [r["y"] for r in planner.thin(cuts, ["g"], "y", 0, 30, 5).where("g = 'a'").orderBy("y").collect()] == [6, 20]
    bounds = spark.createDataFrame([("a", 2, 25), ("b", 0, 9), ("c", 0, 4)], "g string, top long, bottom long")
    got = [tuple(r) for r in planner.segments(cuts, bounds, ["g"], "y").orderBy("g", "n").collect()]
    assert got == [("a", 0, 2, 3, False), ("a", 1, 3, 6, True), ("a", 2, 6, 9, True), ("a", 3, 9, 10, True), ("a", 4, 10, 20, True), ("a", 5, 20, 25, True), ("b", 0, 0, 5, False), ("b", 1, 5, 9, True), ("c", 0, 0, 4, False)]


def test_row_predicates(spark):
    white, stroke, black, gray = [WHITE] * 64, [WHITE] * 30 + [BLACK] + [WHITE] * 33, [BLACK] * 64, [0xFF808080] * 64
    fade = [0xFF000000 | (0xE0 - i) * 0x010101 for i in range(64)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate((white, stroke, black, gray, fade, []))], "i int, px array<long>").withColumn("l", pixels.lumas(F.col("px")))
    got = df.select(pixels.row_is_safe(F.col("l")).alias("a"), pixels.row_is_safe(F.col("l"), paper=F.lit(255)).alias("b"), pixels.row_is_smooth(F.col("l"), 0.98).alias("c"), pixels.has_content(pixels.channel_sums(F.col("px"))).alias("d"), pixels.median(F.col("l")).alias("m")).orderBy("i").collect()
    assert [r["a"] for r in got] == [True, False, False, True, True, True]
    assert [r["b"] for r in got][:4] == [True, False, False, False]
    assert [r["c"] for r in got] == [True, False, True, True, True, True]
    assert [r["d"] for r in got][:3] == [False, True, False] and got[5]["m"] == 255
    assert pixels.threshold(0.98) == 5 and pixels.threshold(0.5) == 127
    pairs = spark.createDataFrame([([WHITE] * 64, [WHITE] * 64), ([WHITE] * 64, [BLACK] * 64), ([WHITE] * 64, [0xFFF0F0F0 if i % 16 == 0 else WHITE for i in range(64)]), ([], [WHITE])], "a array<long>, b array<long>")
    assert [r[0] for r in pairs.select(pixels.rows_continue(F.col("a"), F.col("b"), pixels.pixel_delta)).collect()] == [True, False, True, False]


def test_row_profiles():
    white = np.full(120, 255)
    assert rows.profile_row(white) == (False, 0, False, 0)
    line = white.copy()
    line[20:80] = 128
    assert rows.profile_row(line)[0]
    faint = white.copy()
    faint[20:80] = 235
    assert rows.profile_row(faint)[0]
    strokes = white.copy()
    for a, b in ((10, 16), (30, 42), (60, 66)):
        strokes[a:b] = 0
    assert rows.profile_row(strokes)[0] and rows.profile_row(strokes)[2] and rows.profile_row(strokes)[3] == 12
    dots = np.where(np.arange(120) // 2 % 2, 0, 255)
    assert rows.profile_row(dots)[0] and not rows.profile_row(dots)[2]


def test_enclosed():
    def box(gap=None, open_=False):
        px = np.full((80, 120), WHITE, dtype=np.int64)
        px[8, 10:51] = px[30, 10:51] = BLACK
        px[8:31, 10] = px[8:31, 50] = BLACK
        if gap:
            px[30, gap[0] : gap[1]] = WHITE
        if open_:
            px[30, 11:50] = WHITE
        return morphology.enclosed(px)

    assert box()[19] and not box()[2] and not box()[35]
    assert box(gap=(28, 33))[19]
    assert not box(open_=True).any()
    assert not morphology.enclosed(np.full((40, 40), WHITE)).any() and not morphology.enclosed(np.full((40, 40), BLACK)).any()


def test_matching(spark):
    rng = random.Random(7)
    a = [rng.randrange(256) for _ in range(200)]
    data = [(1, a, a), (2, a, [255 - x for x in a]), (3, a, [9] * 200), (4, a, [rng.randrange(256) for _ in range(200)])]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(data, "i int, a array<int>, b array<int>").select("i", matching.ncc(F.col("a"), F.col("b")).alias("s")).collect()}
    assert abs(got[1] - 1) < 1e-9 and abs(got[2] + 1) < 1e-9 and got[3] == 0 and abs(got[4] - np.corrcoef(data[3][1], data[3][2])[0, 1]) < 1e-9
    vec = spark.createDataFrame([("g", 0, [9]), ("g", 1, [1]), ("g", 2, [1]), ("g", 3, [1]), ("h", 0, [1]), ("h", 1, [5])], "g string, i int, v array<int>")
    hit = {(r["g"], r["i"]): r["grouped"] for r in matching.gate(vec, ["g"], "i", lambda x, y: x == y, "v").collect()}
    assert hit == {("g", 0): False, ("g", 1): True, ("g", 2): True, ("g", 3): True, ("h", 0): False, ("h", 1): False}
    best = matching.best_template(spark.createDataFrame([(1, a)], "i int, v array<int>"), spark.createDataFrame([(7, a), (5, a), (9, a[::-1])], "t int, w array<int>"), "v", "t", "w")
    assert [(r["best_template"], round(r["best_score"], 6)) for r in best.collect()] == [(5, 1.0)]


def test_lookups(spark):
    offsets = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("b", 5, 9)], "g string, at long, page int")
    points = spark.createDataFrame([("a", 0), ("a", 9), ("a", 10), ("a", 99), ("b", 4), ("b", 5)], "g string, y long")
    assert sorted(((r["g"], r["y"], r["page"]) for r in lookup.page_at(offsets, points, ["g"], "at", "y", "page").collect())) == [("a", 0, 1), ("a", 9, 1), ("a", 10, 3), ("a", 99, 3), ("b", 4, None), ("b", 5, 9)]
    x = spark.createDataFrame([(1, "u"), (2, "v"), (3, "u")], "i int, k string")
    assert sorted((r["i"] for r in lookup.first_of_each(x, ["k"], "i").collect())) == [1, 2]
    assert sorted((r["i"] for r in lookup.latest_by_key(x, "k", "i").collect())) == [2, 3]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in ("komik.zip", "dir/komik.cbr", "komik.7z", "hal.jpg", ".zip", "x\\y.CBZ", "noext", "a/b:c.png", "   .  ")], "n string")
    n = F.col("n")
    got = [tuple(r) for r in df.select(names.base_name(n), names.archive_kind(n), names.is_picture(n), names.sanitise(n), names.pack_name(n, F.lit("CBZ"))).collect()]
    assert got[:6] == [("komik", "ZIP", False, "komik.zip", "komik.cbz"), ("komik", "RAR", False, "dir_komik.cbr", "komik.cbz"), ("komik", "SEVEN", False, "komik.7z", "komik.cbz"), ("hal", None, True, "hal.jpg", "hal.cbz"), (".zip", "ZIP", False, "zip", ".zip.cbz"), ("y", "ZIP", False, "x_y.CBZ", "y.cbz")]
    assert got[7][3] == "a_b_c.png" and got[8][3] == "halaman"
    one = spark.range(1).select(names.numbered(F.lit("{series}_ch{chapter}_{n}"), F.lit("S"), F.lit("02"), F.lit(7), 3), names.pack_name(F.lit("k.cbz"), F.lit("ZIP"), F.lit("99")), names.format_size(F.lit(2048)), names.format_size(F.lit(3 * 1048576)), names.display_name(F.lit(None).cast("string"), F.lit("a/b.zip")))
    assert tuple(one.first()) == ("S_ch02_007", "k_99.zip", "2 KB", "3.0 MB", "b.zip")
    order = spark.createDataFrame([("p10.png",), ("p2.png",), ("P1.png",), ("p002.png",), ("p",), ("9",), ("",), ("p99999999999999999999.png",)], "n string").orderBy(natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in order] == ["", "9", "p", "P1.png", "p002.png", "p2.png", "p10.png", "p99999999999999999999.png"]


def test_archives(spark):
    data = [("k", 1, "b02.png", b"two"), ("k", 2, "folder/b01.jpg", b"one"), ("k", 3, "skip.txt", b"no"), ("k", 4, "b10.png", b"")]
    packed = archives.pack(spark.createDataFrame(data, "g string, i int, name string, content binary"), ["g"], ["i"], "name", "content").withColumn("file", F.lit("k.cbz"))
    assert [(r["entries"], r["bytes"]) for r in packed.collect()] == [(4, 8)]
    got = archives.numbered_entries(archives.unpack(packed, "file", "archive", keep=("g",)), ["g"]).orderBy("n").collect()
    assert [(r["file"], bytes(r["content"])) for r in got] == [("001_b01.jpg", b"one"), ("002_b02.png", b"two"), ("003_b10.png", b"")]
    bad = spark.createDataFrame([("x.rar", b"1"), ("y.zip", b"junk"), ("z.zip", None)], "file string, archive binary")
    assert all(r["error"] for r in archives.unpack(bad, "file", "archive").collect()) and archives.unpack(bad, "file", "archive").count() == 3


def test_images(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 1 << 24, (20, 31), dtype=np.int64) | 0xFF << 24
    raw = images.write_png(px)
    assert np.array_equal(images.read_png(raw), px) and images.bounds(raw) == (31, 20) and images.bounds(b"no") == (0, 0) and images.bounds(None) == (0, 0)
    assert (images.grid(np.full((40, 200), 0xFF808080)) == 128).all() and images.grid(px).shape == (16, 96)
    assert images.sample_size(16_000_000) == 1 and images.sample_size(64_000_001) == 2 and images.preview_scale(2560, 10) == 0.5
    assert images.resampled(px, 62).shape == (40, 62)
    got = images.probe(spark.createDataFrame([(raw,), (b"x",)], "content binary"), "content").collect()
    assert [(r["width"], r["height"]) for r in got] == [(31, 20), (0, 0)]


def test_settings():
    s = Settings()
    assert (s.image_format, s.pack, s.rule, s.max_height, s.theme) == ("JPG", "ZIP", "MAX_HEIGHT", 10000, "SYSTEM")
    changed = Settings(image_format="PNG", jpg_quality=5, strictness="STRICT", matte="CLEAR", banner_cut=False)
    assert Settings.from_json(changed.to_json()) == changed and Settings.from_json('{"strictness": "BALANCED"}') == s
    assert Settings.from_json('{"image_format": "TIFF", "jpg_quality": "x", "new": 1}') == s == Settings.from_json("broken") == Settings.from_json(None)
    assert Settings(image_format="PNG").encode_quality == 100 and Settings(jpg_quality=3).encode_quality == 10 and Settings(image_format="WEBP", webp_quality=70).encode_quality == 70


def test_text_blocks():
    lines = [(10, 20, 0, 100), (30, 40, 10, 90), (200, 210, 0, 50), (215, 225, 500, 600)]
    assert list(textblocks.blocks_of(iter(lines))) == [(0, 50, 2), (190, 220, 1), (205, 235, 1)]
    assert list(textblocks.blocks_of(iter([lines[0], (25, None, None, None), lines[1]])))[0][2] == 1


def test_dividers_belong_to_their_group(spark):
    lines = spark.createDataFrame([(g, t, t + 10, 0, 100) for g in ("a", "b") for t in (10, 30)] + [("b", None, 1, 1, 1)], "g string, top int, bottom int, left int, right int")
    got = textblocks.text_blocks(lines, ["g"], dividers=spark.createDataFrame([("a", 25)], "g string, top int")).collect()
    assert sorted((r["g"], r["lines"]) for r in got) == [("a", 1), ("a", 1), ("b", 2)]


def test_folds_keep_long_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, 1, 5), (None, 1, None), (None, 2, 7), (big, 2, 4)], "k long, i long, h long")
    got = grouping.by_height(df, ["k"], "i", "h", 8).collect()
    assert sorted((r["k"] or 0, r["i"], r["h"], r["bundle"]) for r in got) == [(0, 1, 0, 1), (0, 2, 7, 1), (big, 1, 5, 1), (big, 2, 4, 2)]


def test_natural_order_of_long_digit_runs(spark):
    names = ["p" + "9" * 45, "p5", "p" + "1" * 45, "p9223372036854775807", "pa", "p0000000000000000000000000000012"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()]
    assert got == ["p5", "p0000000000000000000000000000012", "p9223372036854775807", "p" + "1" * 45, "p" + "9" * 45, "pa"]


def test_two_phase_windows_over_one_long_group(spark):
    rng = random.Random(4)
    rows = [(None if i % 7 == 0 else "g", i * 3 // 2, rng.choice([None, *range(9)])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, h long").repartition(6)
    parts = ordered.dealt(df, ["g"], "i", 6)
    assert parts.where("g = 'g'").select(ordered.PART).distinct().count() > 2
    summed = ordered.running_sum(parts, ["g"], "i", F.col("h"), "above").collect()
    known = ordered.last_known(parts, ["g"], ["i", "h"], F.when(F.col("h") > 6, F.col("h")), "known").collect()
    for g in (None, "g"):
        mine = sorted((i, h or 0) for k, i, h in rows if k == g)
        twice = {i for i, n in Counter(i for i, _ in mine).items() if n > 1}
        above = dict(zip((i for i, _ in mine), np.cumsum([0] + [h for _, h in mine]).tolist()))
        got = {r["i"]: r["above"] for r in summed if r["g"] == g and r["i"] not in twice}
        assert got == {i: a for i, a in above.items() if i not in twice} and sum(r["g"] == g for r in summed) == len(mine)
        last, want = None, {}
        for i, h in mine:
            last = h if h > 6 else last
            want[i] = last
        assert {r["i"]: r["known"] for r in known if r["g"] == g and r["i"] not in twice} == {i: v for i, v in want.items() if i not in twice}
    few = df.where("g = 'g'").dropDuplicates(["i"])
    order = sorted(r["i"] for r in few.collect())
    nexts = ordered.next_values(ordered.dealt(few, ["g"], "i", 5), ["g"], "i", ["i", "h"]).collect()
    assert sorted((r["i"], r["next_i"]) for r in nexts if r["next_i"] is not None) == list(zip(order, order[1:]))
    assert [r["bundle"] for r in grouping.by_number(few, ["g"], "i", 25, "h", 8).orderBy("i").collect()] == [n // 25 + 1 for n in range(len(order))]


def test_a_shared_folder_is_needed_where_executors_are_apart(spark):
    assert runtime.one_process("local") and runtime.one_process("local[8]") and not runtime.one_process("local-cluster[2,1,1024]") and not runtime.one_process("yarn")

    class Away:
        class sparkContext:
            master, applicationId = "yarn", "x"
            getCheckpointDir = staticmethod(lambda: Away.there)

        class conf:
            get = staticmethod(lambda k, d=None: Away.set)

    Away.there, Away.set = None, None
    with pytest.raises(RuntimeError):
        runtime.shared_dir(Away)
    Away.there = "hdfs://a/b"
    assert runtime.shared_dir(Away) == "hdfs://a/b"
    Away.set = "hdfs://c/d/"
    assert runtime.shared_dir(Away) == "hdfs://c/d"


def test_seams(spark):
    side = lambda a, b: [0xFF000000 if a <= i % 64 <= b else 0xFFFFFFFF for i in range(512)]
    inner = [v if i < 64 * 6 else 0xFFFFFFFF for i, v in enumerate(side(10, 17))]
    df = spark.createDataFrame([(side(10, 17), side(10, 17)), (side(10, 17), side(40, 47)), ([0xFFFFFFFF] * 512, [0xFFFFFFFF] * 256 + inner[:256]), ([], [1])], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(pixels.seam_continues(F.col("a"), F.lit(64), F.col("b"), F.lit(64), pixels.pixel_delta)).collect()]
    assert got == [True, False, True, False]
    assert morphology.has_content(np.array([[0xFFFFFF, 0]])) and not morphology.has_content(np.full((4, 4), 0xF0F0F0)) and not morphology.has_content(np.zeros((0, 4), np.int64))


def test_series_of_pages_become_strips(spark):
    rng = np.random.default_rng(2)

    def page(blank):
        im = np.full((1500, 480), WHITE, dtype=np.int64)
        for a, b in ((100, 500), (700, 1200)):
            im[a:b, 40:440] = np.where(rng.random((b - a, 400)) < 0.5, BLACK, WHITE)
        return (im if not blank else np.full((300, 480), WHITE, dtype=np.int64)).ravel().tolist()

    data = [("s", 1, page(False), 480), ("s", 2, page(False), 480), ("s", 3, page(True), 480), ("t", 1, page(False), 480), ("t", 2, [], 480)]
    pages = spark.createDataFrame(data, "series string, page int, px array<long>, width int")
    out = strips.build(pages, Settings(max_height=1000)).orderBy("series", "segment").collect()
    for s, p, px, w in data:
        parts = [(r["start"], r["end"]) for r in out if (r["series"], r["page"]) == (s, p)]
        if px:
            assert parts[0][0] == 0 and parts[-1][1] == len(px) // w and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(sum(r["rendered"] for r in out if (r["series"], r["bundle"]) == k) <= 1000 or any(r["tall"] for r in out if (r["series"], r["bundle"]) == k) for k in {(r["series"], r["bundle"]) for r in out})
    inked = lambda r: any(x != WHITE for x in data[r["page"] - 1 if r["series"] == "s" else 3][2][(r["start"] - 1) * 480 : r["start"] * 480])
    assert not any(inked(r) for r in out if r["start"] > 0 and not r["forced"])
    drawn = strips.render(strips.build(pages, Settings(max_height=1000)), pages).collect()
    assert sum(r["height"] for r in drawn) == sum(r["rendered"] for r in out) and all(images.bounds(bytes(r["png"])) == (480, r["height"]) for r in drawn)


def test_sessions(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:04:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["k"], r["events"]) for r in sessions(e, ["k"], "t", "5 minutes").collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_library(spark):
    lib = spark.createDataFrame([("a", "a.zip", None, ["u1", "u2", "u3"], ["one", None]), ("b", None, "CBZ", ["u1"], [])], "series string, origin string, pack string, uris array<string>, titles array<string>")
    pages = library.pages_of(lib)
    assert [tuple(r) for r in pages.orderBy("series", "page").collect()] == [("a", 0, "u1", "one"), ("a", 1, "u2", "Halaman 2"), ("a", 2, "u3", "Halaman 3"), ("b", 0, "u1", "Halaman 1")]
    packs = lambda d: {r["series"]: r["pack"] for r in d.collect()}
    assert packs(library.set_pack(lib, "a", "CBZ")) == {"a": "CBZ", "b": "CBZ"} and packs(library.set_pack(lib, "b", "CBZ")) == {"a": None, "b": None}
    assert packs(library.remove(lib, "a")) == {"b": "CBZ"}
    order = lambda d: [r["uri"] for r in d.where("series = 'a'").orderBy("page").collect()]
    assert order(library.move(pages, ["series"], "page", F.lit(1), -1)) == ["u2", "u1", "u3"] and order(library.move(pages, ["series"], "page", F.lit(2), 1)) == ["u1", "u2", "u3"]
    fresh = library.new_uris(spark.createDataFrame([("x", 1), ("u1", 2), ("x", 3)], "uri string, n int"), pages, "uri", "n")
    assert [tuple(r) for r in fresh.collect()] == [("x", 1)]
    packed = archives.pack(spark.createDataFrame([("k", 1, "p10.png", b"a"), ("k", 2, "p2.png", b"b")], "g string, i int, name string, content binary"), ["g"], ["i"], "name", "content").select(F.lit("in/k.cbz").alias("path"), F.col("archive").alias("content"))
    got, failed = library.import_archives(packed.unionByName(spark.createDataFrame([("x.7z", b"z"), ("y.zip", b"z")], "path string, content binary")))
    assert [(r["series"], r["page"], r["title"]) for r in got.orderBy("page").collect()] == [("k", 0, "p2.png"), ("k", 1, "p10.png")]
    assert library.failures(failed, "archive", "error")() == "x.7z, y.zip" and library.failures(failed, "archive", "error", 1)() == "x.7z (+1)"
    strip = spark.createDataFrame([("a", 1, 1, 100, True, False, False), ("a", 1, 2, 50, False, False, False), ("a", 2, 3, 70, False, False, False)], "series string, bundle int, segment int, rendered long, tall boolean, seam_cut boolean, forced boolean")
    assert [tuple(r) for r in library.outcomes(lib, Settings(), strip).orderBy("series").collect()] == [("a", "a.zip", 2, 1, None), ("b", "b.cbz", 0, 0, "no readable page")]
    assert [(r["segment"], r["y"]) for r in library.cut_marks(strip, 1, 2).orderBy("segment").collect()] == [(1, 50), (2, 75), (3, 35)]
    files = spark.createDataFrame([("f1", 10), ("f2", 5)], "path string, length long")
    gone, report = library.swept(files, files.where("path = 'f1'"))
    assert [r["path"] for r in gone.collect()] == ["f2"] and tuple(report.first()) == (2, 15, 1, 10)


def test_probe_finds_a_late_jpeg_header(spark):
    segment = b"\xff\xe2" + (65000).to_bytes(2, "big") + bytes(64998)
    frame = b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x03" + bytes(9)
    rows = [(b"\xff\xd8" + segment * n + frame + b"\xff\xd9",) for n in (0, 2)] + [(b"\xff\xd8" + segment * 2,), (None,)]
    got = images.probe(spark.createDataFrame(rows, "content binary"), "content").collect()
    assert sorted((r["width"], r["height"]) for r in got) == [(0, 0), (0, 0), (40, 30), (40, 30)]


def test_a_fold_sees_whole_groups_of_a_union(spark):
    """Both halves are dealt by k already, in shuffles that adaptive execution reads apart."""
    adaptive = {"advisoryPartitionSizeInBytes": "4000", "coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1"}
    wide, narrow = spark.range(4000).selectExpr("id % 10 k", "id y", "repeat(md5(string(id)), 9) v"), spark.range(40).selectExpr("id % 10 k", "id y", "'' v")
    numbered = [d.withColumn("y", F.row_number().over(Window.partitionBy("k").orderBy("y", "v"))) for d in (wide, narrow)]
    try:
        for k, v in adaptive.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
        got = folds.fold_sorted(numbered[0].unionByName(numbered[1]), ["k"], ["y"], ["y"], lambda rows: [(sum(1 for _ in rows),)], "n long").collect()
    finally:
        for k in adaptive:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert sorted(map(tuple, got)) == [(k, 404) for k in range(10)]
