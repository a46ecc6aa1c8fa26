"""Operators over the corpus, against brute force on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, components, linededup, minhash, mixing, shingles, topk, toxicity

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def truth(rows, width, percent=80):
    def of(t):
        w = [x.decode() for x in (t or "").encode().lower().split()]
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])

    sets = [(i, of(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    rows = [(0, ""), (1, None), (2, "   \n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "a b c d"), (7, "a b c d e")]
    for g in range(12):
        base = text(rng, rng.choice([30, 120, 400]))
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 14)) if k else base) for k in range(rng.randrange(2, 25))]
    chain = text(rng, 200)
    for _ in range(30):  # each near the one before, the ends far apart
        rows.append((len(rows), chain))
        chain = edited(rng, chain, 3)
    rows += [(len(rows) + k, text(rng, 50) + " " + "common words here " * 40) for k in range(40)]
    rows.append((len(rows), text(rng, 30000)))
    shuffled = list(rows)
    rng.shuffle(shuffled)
    return [(1000 + i if i % 3 else 5000 - i, t) for i, t in shuffled]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, near_rows, width):
    df = spark.createDataFrame([(*r, 1) for r in [*near_rows, near_rows[5], (None, "no id")]], "doc_id long, text string, rep int").toDF("doc_id", "text", "TEXT")
    got = minhash.near_duplicates(df, width=width).collect()
    assert len(got) == df.count()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == truth(near_rows, width)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (7, "a b c d e f"), (2, "g h i j k l"), (9, "m n o p")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {(5, 2), (7, 2), (2, 2), (9, 9)}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_join_what_brute_force_joins(spark):
    rng = random.Random(3)
    texts = [edited(rng, " ".join(WORDS[:100]), rng.randrange(3, 12)) for _ in range(700)]
    sets = [shingles.shingle_set(t, 2) for t in texts]
    rows = [(1, 0, i, i) for i in range(700)]
    classes = spark.createDataFrame([(i, len(s), bytearray(minhash.sketch(s).tobytes())) for i, s in enumerate(sets)], "rep long, n long, sig binary")
    packed = minhash._packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r["a"], r["b"]) for r in minhash._across(spark.createDataFrame(rows, "key long, band int, rep long, component long"), classes, packed, 2, 0.8).collect()}
    sig = np.array([minhash.sketch(s) for s in sets])
    of = [set(s.tolist()) for s in sets]

    def groups(links):
        parent = list(range(700))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(700)]

    want = {(i, j) for i, j in itertools.combinations(range(700), 2) if (sig[i][:4] == sig[j][:4]).all() and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j])}
    assert groups(got) == groups(want) and got <= want and 0 < len(got) < len(want)


def test_estimate_is_unbiased_for_compressed_registers():
    rng = random.Random(4)
    for share in (0.0, 0.3, 0.8):
        got = []
        for _ in range(40):
            common = [rng.getrandbits(64) for _ in range(int(300 * share))]
            a, b = (np.array(common + [rng.getrandbits(64) for _ in range(300 - len(common))], dtype=np.uint64) for _ in range(2))
            j = len(common) / (600 - len(common))
            got.append(minhash.estimate(np.array([(minhash.sketch(a) == minhash.sketch(b)).mean()]), np.array([300]), np.array([300]))[0] - j)
        assert abs(np.mean(got)) < 0.02


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def recurring_lines(rows, min_docs=10):
    """{line: rows that hold its template} by a tree of dictionaries in one place, for lines of less than 20 words."""

    def fields(line):
        t = ["<*>" if re.search("[0-9]", w) else w for w in line.split()]
        return tuple(t) if 2 * t.count("<*>") < len(t) else tuple(line.split())

    groups, clusters = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for at, (_, t, _) in enumerate(rows):
        for line in (t or "").split("\n"):
            f = fields(line)
            if f:
                groups[f].add((at, line))
            if len(f) >= 4 and 2 * sum(bool(re.search("[0-9]", w)) for w in line.split()) < len(f):
                rest = len(f) - 2
                n = min(3, rest)
                for i in range(n):
                    clusters[len(f), f[:2], i, f[2 + rest * i // n : 2 + rest * (i + 1) // n]][f].add((at, line))
    found = [members for members in groups.values()]
    for lines in clusters.values():
        size = Counter()
        copies = Counter(fields(x) for _, t, _ in rows for x in (t or "").split("\n") if fields(x) in lines)
        total = sum(copies[f] for f in lines)
        template = []
        for i in range(len(next(iter(lines)))):
            size = Counter()
            for f in lines:
                size[f[i]] += copies[f]
            w, n = size.most_common(1)[0]
            template.append(w if 2 * n > total else None)
        found.append({m for f, ms in lines.items() if sum(a == b for a, b in zip(f, template)) >= 0.75 * len(f) for m in ms})
    return [m for m in found if len({at for at, _ in m}) >= min_docs]


def test_line_templates_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "l")]
    text = lambda rng, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    fixed = [text(rng, 14) for _ in range(6)] + ["All rights reserved.", "short one"]
    rows = []
    for i in range(120):
        lines = [text(rng, rng.randrange(1, 18)) for _ in range(4)] + [rng.choice(fixed) for _ in range(3)] + [f"Page {i} of 120 in the printed book", "", "17 23"]
        w = fixed[0].split()
        w[8] = rng.choice(vocabulary)
        lines += [" ".join(w), f"hello dear {rng.choice(vocabulary)}a from us"]
        if i % 5 == 0:
            lines.append(f"welcome back to our site dear {rng.choice(vocabulary)}b please enjoy and {rng.choice(vocabulary)}c again")
        rng.shuffle(lines)
        rows.append((rng.randrange(10**6) if i else None, "\n".join(lines), "clash"))
    rows += [(1, None, "c"), (2, "", "c"), (3, "\n\n", "c"), rows[7], (4, " ".join(f"v{rng.randrange(10**9)}x" for _ in range(60_000)), "very long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string").toDF("doc_id", "text", "LINE")
    holds, firsts = defaultdict(set), defaultdict(set)
    for members in recurring_lines(rows[:-1]):
        least = min((i for at, _ in members if (i := rows[at][0]) is not None), default=None)
        for at, line in members:
            holds[at].add(line)
            if rows[at][0] == least:
                firsts[at].add(line)

    def cut(at):
        return None if rows[at][1] is None else "\n".join(x for x in rows[at][1].split("\n") if x not in holds[at] or x in firsts[at])

    got = linededup.drop_lines(df, marks=("n", "gone", "recurring")).collect()
    assert Counter((r["doc_id"], r["text"], r["LINE"]) for r in got) == Counter((rows[at][0], cut(at), rows[at][2]) for at in range(len(rows)))
    assert sum(r["gone"] for r in got) > 500 and sum(r["recurring"] for r in got) > sum(r["gone"] for r in got)
    assert not any("hello dear" in (r["text"] or "") or "welcome back" in (r["text"] or "") for r in got if r["gone"] == r["recurring"])
    assert linededup.drop_lines(df.where("false")).count() == 0


def test_recurring_passages_inside_lines_are_cut(spark):
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**9)}"
    some = lambda n: " ".join(word() for _ in range(n))
    shared = some(45)
    inserted = shared.split()
    inserted.insert(22, "unheard")
    own = [(some(3 + i), some(12 - i)) for i in range(12)]
    rows = [(i, f"first line\n{a} {' '.join(inserted) if i == 11 else shared} {b}\n\nlast") for i, (a, b) in enumerate(own)]
    got = {r["doc_id"]: r for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), marks=("n", "gone", "recurring")).collect()}
    assert got[0]["text"] == rows[0][1]
    for i in range(1, 12):
        a, b = own[i]
        line = next(x for x in got[i]["text"].split("\n") if a in x)
        rest = set(line.split()) - set(a.split()) - set(b.split())
        assert line.startswith(a) and line.endswith(b) and got[i]["n"] == 4
        # at most REACH - 1 words on either side of a passage stay
        assert len(rest - {"unheard"}) <= 2 * (linededup.REACH - 1) * (1 if i < 11 else 2)
        assert ("unheard" in rest) == (i == 11)


def test_slices_of_few_words(spark):
    for n in range(2 * linededup.REACH + 3):
        key, line, at = linededup.runs(linededup.Words.of([b" ".join(b"w%d" % i for i in range(n))]))
        assert len(key) == len(line) == len(at) == int(n >= linededup.RUN) * len(at)
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in range(2 * linededup.REACH + 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (5,):
        assert linededup.drop_lines(df.where(F.col("doc_id") == n)).collect()[0]["text"] == rows[n][1]
    assert {(r["doc_id"], r["text"]) for r in linededup.drop_lines(df.repartition(len(rows), "doc_id")).collect()} == set(rows)


def test_long_passages_recur_in_two_documents(spark):
    rng = random.Random(32)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(n))
    line, short, inside = some(60), some(30), some(75)
    # in the numbers a long line may differ
    number = [f"Item {i} of {inside.split()[0]} " + " ".join(line.split()[::-1]) for i in (4, 5)]
    a, b = (some(9), some(8)), (some(7), some(6))
    rows = [(1, f"{line}\n{short}\n{a[0]} {inside} {a[1]}\n{number[0]}"), (2, f"{line}\n{short}\n{b[0]} {inside} {b[1]}\n{number[1]}"), (3, some(60)), (4, line)]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), marks=("n", "gone", "recurring")).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0) and got[4] == ("", 1)
    kept = got[2][0].split("\n")
    assert len(kept) == 2 and kept[0] == short and got[2][1] == 3
    assert kept[1].startswith(b[0]) and kept[1].endswith(b[1]) and len(kept[1].split()) <= 13 + 2 * (linededup.REACH - 1)
    # one threshold for all lengths finds none of them
    same = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), long_docs=10).collect()
    assert {r["doc_id"]: r["text"] for r in same} == dict(rows)


def test_lines_that_differ_in_two_fields_share_a_block():
    lines = [b"welcome back to our site dear ann please enjoy and read again", b"welcome back to our site dear bob please enjoy and write again", b"Page 3 of the book", b"Page 17 of the  book", b"17 23", b"17 24", b"I am he", b" "]
    key, line, kind, has = linededup.line_ids(linededup.Words.of(lines))
    whole = {i: k for k, i, x in zip(key, line, kind) if x == linededup.LINE}
    blocks = {i: {k for k, j, x in zip(key, line, kind) if x == linededup.CLUSTER and i == j} for i in range(8)}
    assert whole[0] != whole[1] and blocks[0] & blocks[1] and len(blocks[0]) == 3
    assert whole[2] == whole[3] and whole[4] != whole[5] and blocks[6] == set() and 7 not in whole
    assert has.tolist() == [True, True, True, True, False, False, False, False]


def greedy_mix(rows, weights=(1, 2, 3)):
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * size[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        free -= over
    return size, target


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "é", "z", "", None] + ["hot"] * 6)) for i in range(600)]
    rows += [(None, "x y", "a"), (None, None, None), (3, rows[3][1], rows[3][2]), (9999, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    size, target = greedy_mix(rows)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    repeated = mixing.repeat_rows(df)
    assert repeated.columns == df.columns
    assert repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.repeat_rows(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["null ids", "equal ids", "equal rows"])
def test_mix_meets_its_targets_whatever_the_ids(spark, kind):
    rows = [(None if kind == "null ids" else 7, "a b c d e" if kind == "equal rows" else f"a b c d e{s}{i}", s) for s in "xyz" for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - {"x": 250, "y": 500, "z": 750}[r["source"]]) < 1e-6
    assert taken == {"x": 250, "y": 500, "z": 750}
    assert mixing.repeat_rows(df).count() == 300


@pytest.mark.parametrize("block", [16384, 40])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    v = {i: (rng.normal(size=8) * 0.4).astype(np.float32).tolist() for i in range(0, 400)}
    for i in range(100, 160):
        v[i] = v[50]  # ties
    v[7], v[9], v[350], v[11], v[0] = None, [0.1, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8, [0.25] * 3
    v[-3], v[-50] = [-1.0] * 8, [2.0] * 8
    df = spark.createDataFrame([(i, x, 1) for i, x in v.items()], "vec_id long, embedding array<float>, id int").toDF("vec_id", "embedding", "ID")
    got = [tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, query_block=block, row_block=block).collect()]
    ints = {i: np.pad(np.floor(256 * np.array(x, dtype=np.float64)), (0, 8 - len(x))).astype(int) for i, x in v.items() if x and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("vec_id in (50, 51)"), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 1
    assert topk.top_k(df.where("false"), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    bad = ["vilex", "grumbo", "snarf", "blotto"]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(rng.randrange(20, 200))]
        y = int(i % 8 == 0)
        for _ in range(y * rng.randrange(2, 8)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, y))
    rows += [(10_000, "", "c"), (10_001, None, "c"), (None, "w1 w2", "c"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit_on(docs, spark.createDataFrame(labels + [(77_777, 1), (5, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 1500]
    assert 200 < len(held) < 500
    right = sum(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held)
    assert right / len(held) > 0.97
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.fit_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
        assert toxicity.keep_ordinary(docs, model).count() == 2
    assert toxicity.score(docs.where("false"), model).count() == 0
    # only toxic labels: the score says so, but nothing is rejected for want of a model
    model = toxicity.fit_on(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [1.0, 1.0] and toxicity.keep_ordinary(docs, model).count() == 2


def test_toxicity_windows_hold_every_byte():
    w = toxicity.words(b"a " + b"x" * 1000 + b" b")
    assert b"".join(w) == b"a" + b"x" * 1000 + b"b" and max(map(len, w)) == toxicity.PIECE
    assert toxicity.windows([b"a", b"b", b"c"], 2) == [b" a b ", b" c "]


def test_gain_is_located_at_the_word_that_makes_it():
    plain = b" ".join(w.encode() for w in WORDS)
    pair = toxicity.compressors(plain, b" vilexgrumbo ", 4)
    w = b"w1 w2 w3 w4 w5 vilexgrumbo w6 w7 w8 w9 w10".split()
    g = toxicity.gains(toxicity.windows(w, toxicity.PART), pair)
    assert [x[2] for x in toxicity.gaining(w, g, pair, narrow=True)] == [b" vilexgrumbo "]


def test_quotes_are_linked_and_cut(spark):
    rows = [
        (1, 0, "user", "Hello there,\nhow do I bake bread?"),
        (1, 1, "assistant", "Use flour.\nAnd time."),
        (1, 2, "user", "On Monday Ann wrote:\n> Use  FLOUR!\n>> how do I bake bread?\n\nWhich flour?"),
        (1, 3, "assistant", "> Hello there,\n> how do I bake bread?\nAlso see this."),
        (2, 0, "user", "> Use flour.\nnot in this conversation"),
        (2, 1, None, None),
        (None, 5, "user", "> x"),
        (2, None, "user", ""),
        (1, 1, "assistant", "Use flour.\nAnd time."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("clash")).withColumn("depth", F.lit("c"))
    got = chat.link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 2]["reply_to"] == 1 and by[1, 2]["text"] == "Which flour?" and by[1, 2]["depth"] == 2 and by[1, 2]["quoted"] == 2
    assert by[1, 3]["reply_to"] == 0 and by[1, 3]["matched"] == 2 and by[1, 3]["text"] == "Also see this."
    assert by[2, 0]["reply_to"] is None and by[2, 0]["text"] == "not in this conversation"
    assert by[2, 1]["text"] == "" and by[1, 0]["text"] == rows[0][3]
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [0, 3, 1, 1, 2] and sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3, 4]
    assert [(x["level"], x["source"]) for x in by[1, 2]["links"]] == [(1, 1), (2, 0)]
    assert chat.link_quotes(df.where("false")).count() == 0


def test_quotes_of_repeated_lines_and_wrapped_passages(spark):
    rows = [
        (1, 0, "user", "Hello\nregards"),
        (1, 1, "user", "Hello\nregards\nUse flour"),
        (1, 2, "user", "> Hello\n> regards\n> Use flour\nYes"),
        (1, 3, "user", "Hello\nregards"),
        (1, 4, "user", "> Hello\n> regards\nWhich?"),
        (2, 0, "user", "one two three four\nfive six seven\n\nbye"),
        (2, 1, "user", "five six"),
        (2, 2, "user", "> one two three\n> four five six\n> seven\nYes"),
    ]
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == 1 and got[2, 2] == 0
    assert got[1, 4] == 3  # of equals the latest


def plain_links(rows):
    """{(conv, turn): (text, quoted, depth, {level: source})} by comparing every message with every earlier one."""

    def parsed(t):
        out = []
        for x in (t or "").replace("\r\n", "\n").split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", x)
            out.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
        return out

    def normal(x):
        return re.sub(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", " ", x.lower()).strip(" ")

    def held(parts, level):
        lines = {n for d, x in parts if d == level and (n := normal(x))}
        passages, now, size, before = {}, [], 0, None
        for d, x in [*parts, (-1, "")]:
            if before is not None and (d != before[0] or not normal(x) or not normal(before[1])):
                if before[0] == level and normal(" ".join(now)):
                    n = normal(" ".join(now))
                    passages[n] = max(size, passages.get(n, 0))
                now, size = [], 0
            now.append(x)
            size += 1
            before = (d, x)
        return lines, passages

    out, seen = {}, defaultdict(list)
    for conv, turn, _, t in sorted(rows, key=lambda r: r[:2]):
        parts = parsed(t)
        links = {}
        for level in sorted({d for d, _ in parts if d}):
            lines, passages = held(parts, level)
            votes = [(max(len(lines & l0), sum(n for x, n in passages.items() if x in p0)), other) for other, (l0, p0) in seen[conv]]
            best = max((v for v in votes if v[0]), default=None)
            if best:
                links[level] = best[1]
        seen[conv].append((turn, held(parts, 0)))
        out[conv, turn] = (sum(d > 0 for d, _ in parts), max(d for d, _ in parts), links)
    return out


def test_generated_conversations_against_a_plain_version(spark):
    rng = random.Random(77)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    rows = []
    for conv in range(400):
        bodies, quotes = [], []
        for turn in range(rng.randrange(3, 14)):
            own = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.2:
                own.append("Best regards")
            lines = []
            if bodies and rng.random() < 0.8:
                at = rng.randrange(len(bodies))
                body = [*quotes[at], *bodies[at]]
                if rng.random() < 0.3:  # wrapped anew by a mailer
                    flat = " ".join(bodies[at]).split()
                    body = [*quotes[at], *(" ".join(flat[i : i + 5]) for i in range(0, len(flat), 5))]
                lines = [("> " if not x.startswith(">") else ">") + (x.upper() if rng.random() < 0.2 else x) for x in body]
            quotes.append(lines)
            bodies.append(own)
            rows.append((conv, turn, "user", "\n".join([*(["On Monday Ann wrote:"] if lines else []), *lines, *own])))
    rows.append((1000, 0, "user", "One\u2028two\u0085three"))
    rows.append((1000, 1, "user", "> One\u2028two\u0085three\nYes"))
    rows.append((1000, 2, "user", " ".join(rng.choice(words) for _ in range(100_000))))
    assert len(rows) > 3000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_links(rows)
    got = chat.link_quotes(df).collect()
    assert {(r["conv_id"], r["turn"]): (r["quoted"], r["depth"], {x["level"]: x["source"] for x in r["links"]}) for r in got} == want
    assert sum(len(w[2]) > 1 for w in want.values()) > 300
    by = defaultdict(list)
    for r in got:
        by[r["conv_id"]].append(r)
        assert not any(x.startswith(">") for x in r["text"].split("\n")) and r["message"].endswith(r["text"] + "\n<|end|>\n")
    for conv in by.values():
        place = {r["turn"]: r["position"] for r in conv}
        assert sorted(place.values()) == list(range(len(conv)))
        assert all(place[r["reply_to"]] < r["position"] for r in conv if r["reply_to"] is not None)
    assert {r["turn"]: r["text"] for r in by[1000]}[1] == "Yes" and next(r for r in by[1000] if r["turn"] == 1)["reply_to"] == 0
