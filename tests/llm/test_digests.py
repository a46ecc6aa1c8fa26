"""Merkle manifest, vector codes and personal data, each against a plain version, and their SQL on odd rows."""

import math
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import codes, merkle, pii, sql


def digest(text):
    return sha256(text.encode()).hexdigest()


def as_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def plain_manifest(rows):
    def leaf(doc_id, text, lang, source, n):
        return digest("".join(map(as_field, (doc_id, source, lang, n, text))))

    def lowered(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = {}
    for doc_id, text, lang, source, n in rows:
        h = leaf(doc_id, text, lang, source, n)
        t = leaf(doc_id, lowered(text), lang, source, n) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else h
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, h), t))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([o[2] for o, _ in sorted(groups[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for j, (o, t) in enumerate(sorted(groups[x])):
            path = siblings(trees[x], j) + siblings(top, k)
            for before, after in path:
                t = digest(before + t + after)
            out.append((o[1] if o[0] else None, o[2], trees[x][-1][0], top[-1][0], digest("".join(b + a for b, a in path)), t, t == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def doc_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice(["Some Text ", "ünï Çode A", "", "plain"]) * rng.randrange(4), rng.choice(["en", "en", "en", "fr"]), rng.choice(["a", "b:1", None]), rng.choice([None, 7])) for i in range(700)]
    rows += [(i, "One Of Many", f"lang{i:02}", "s", 1) for i in range(700, 720)]  # more groups than the fanout
    return [*rows, rows[3], rows[3], (None, "No Id", "en", None, None), (None, None, None, None, None), (9, None, "", "s", 0), (12, "Ä" * 200_000, None, "s", -1)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest_equals_plain_version(spark, doc_rows, depth):
    df = spark.createDataFrame(doc_rows, DOCS).repartition(3).withColumn("TEXT2", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("i", F.lit(3))
    got = merkle.manifest(df, depth=depth).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(doc_rows)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_of_exact_sizes(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS), depth=1).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_one_lone_leaf(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert merkle.manifest(df.where("false")).count() == 0
    r = merkle.manifest(df).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == digest("") and r["verified"]


def test_rows_chosen_for_tampering(spark):
    df = spark.createDataFrame([(1, "A", "en", "s", 1), (2, "A", "en", "s", 1)], DOCS)
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(df, tampered=F.col("id") == 2).collect()}
    assert got == {1: True, 2: False}


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for *_, v in kept) // parts) * parts
    step = width // parts
    x = np.array([v + [0] * (width - len(v)) for *_, v in kept], dtype=object)
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [x[first][:, p * step : (p + 1) * step].copy() for p in range(parts)]

    def assigned():
        out = []
        for p in range(parts):
            d = ((x[:, None, p * step : (p + 1) * step] - books[p][None]) ** 2).sum(axis=2)
            at = [min(range(len(r)), key=lambda j: (r[j], j)) for r in d]
            out.append((np.array(at), [r[j] for r, j in zip(d, at)]))
        return out

    for _ in range(rounds):
        for p, (at, _d) in enumerate(assigned()):
            for e in set(at):
                m = at == e
                books[p][e] = [int(t) // int(m.sum()) for t in x[m][:, p * step : (p + 1) * step].sum(axis=0)]
    found = assigned()
    errors = [int(sum(found[p][1][r] for p in range(parts))) for r in range(len(kept))]
    totals = {}
    for (_, label, _v), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    book = digest(",".join(str(int(y)) for b in books for row in b for y in row))
    return sorted([(i, "".join(f"{found[p][0][r]:02x}" for p in range(parts)), errors[r], totals[label], book) for r, (i, label, _v) in enumerate(kept)], key=str)


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(rng, n, width, scale=1.0, grid=None):
    make = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, scale))
    return [(i, [make() for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("case", ["spread", "ties", "few", "huge"])
def test_codes_equal_plain_version(spark, case):
    rng = random.Random(case)
    rows = {"spread": lambda: vectors(rng, 400, 8, 0.2), "ties": lambda: vectors(rng, 500, 8, grid=[-1.0, 0.0, 1.0]), "few": lambda: vectors(rng, 5, 7), "huge": lambda: vectors(rng, 60, 8, 1e12)}[case]()
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 7, 1), (1002, [float("nan")] * 8, 2), (1003, [float("inf")] * 8, 2), (None, [0.25] * 4, None), rows[2], (2, [0.5] * 8 if case != "few" else [0.5], None)]
    got = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("entry", F.lit("clash")).withColumn("v", F.lit(1)))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    clip = lambda e: min(e, 2**63 - 1)
    want = [(i, c, clip(e), t if t < 2**63 and e < 2**63 else None, b) for i, c, e, t, b in plain_codes(rows)]
    have = sorted(map(tuple, got.drop("label").collect()), key=str)
    if case == "huge":  # sums beyond a long are null
        want, have = ([(*r[:3], r[4]) for r in x] for x in (want, have))
    assert sorted(have, key=str) == sorted(want, key=str)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], VECTORS)
    assert codes.compress(df).count() == 0
    assert [tuple(r)[2:5] for r in codes.compress(spark.createDataFrame([(1, [], 1)], VECTORS)).collect()] == [("00000000", 0, 0)]


def test_bounds_spare_scans_and_give_what_full_scans_give():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (64, 8))
    x = np.floor(centres[rng.integers(0, 64, 3000)] + rng.normal(0, 20, (3000, 8)))
    book = codes.Book.of(x[:64].copy(), 8)
    at, low, _, full = codes.assign(x, book, None, None, None)
    for _ in range(3):
        entries = book.entries.copy()
        for e in np.unique(at):
            entries[e] = np.floor(x[at == e].sum(axis=0) / (at == e).sum())
        book, drift = book.moved(entries)
        at, low, best, n = codes.assign(x, book, at, low, drift)
        d = codes.squared(x, book.entries)
        assert (d.argmin(axis=1) == at).all() and (d.min(axis=1) == best).all()
        for g in range(book.groups):  # no entry of a group but the row's own is nearer than its bound
            others = np.where((book.group == g)[None, :] & (np.arange(64)[None, :] != at[:, None]), np.sqrt(d), np.inf)
            assert (low[:, g] <= others.min(axis=1) * (1 + 1e-9)).all()
    assert n < full / 2


def passes_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        total += int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and passes_luhn(d) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PLANTED = [
    "mail ann.b+c@x-y.example.org_d@e.f or a@b a@b. @c.d x@y..z",
    "at 10.0.0.1, 1.2.3.4.5.6.7.8, 300.1.1.1 000255.1.1.1 1.2.3",
    "4111 1111 1111 1111-4111111111111111 and 4111-1111-1111-1111, 0000000000000, 4111111111111112",
    "+1 (555) 555-0123 ++49 30 12345678. +12 +1...... +1 234 (567) 89.01-23-45-67",
    "tel 555-123-4567; call (555) 123 4567, 555.123.4567 alone, order 555-123-4567 phone",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 GB82 WEST 1234 5698 7654 33",
    "😀 ann@x.org 😀 é 10.0.0.1 𝟙𝟚 +1 555 555 0123",
    "card 7536784127813050 4845168114407329 end",
]


def texts():
    rng = random.Random(8)
    pieces = ["a@b.c", "1.2.3.4", "4111111111111111", " ", "-", ".", "+", "(", "@", "tel ", "card ", "é", "😀", "555-123-4567", "DE89370400440532013000", "x", "7", "order "]
    rows = [*PLANTED, *("".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(400))]
    return list(enumerate([*rows, None, "", "a" * 3000, "1" * 3000, "1 " * 3000, "a.b" * 1000, "+1." + "." * 3000, "a@b.c " * 2000, "x@" + "a." * 2000, "1.2.3.4 " * 1500]))


def test_very_long_texts(spark):
    """Lengths that a matcher which gives back, or a stack of groups, would not survive."""
    long = ["a" * 2_000_000, "1" * 500_000, "1 " * 300_000, "a.b" * 500_000, "+1." + "." * 1_000_000, "x@" + "a." * 300_000, "a@b.c " * 20_000, "1.2.3.4 " * 20_000]
    got = pii.report(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(8)).orderBy("doc_id").collect()
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got] == [(0, 0, 0, 0)] * 5 + [(1, 0, 0, 0), (20_000, 0, 0, 0), (0, 20_000, 0, 0)]
    assert got[6]["spans"].startswith("email:0:5,email:6:11,") and got[7]["spans"].endswith("ip:159992:159999")


def test_personal_data_equals_plain_version_and_sql(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("clash")).withColumn("Email", F.lit("x")).repartition(8)
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        spans = base_spans(t or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert by[i]["base_sha256"] == digest(",".join(listed)), t
        assert [by[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(listed) <= set(by[i]["spans"].split(",")) | {""}
    added = lambda i: [rows[i][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in by[i]["spans"].split(",")) if (k, int(a), int(b)) not in base_spans(rows[i][1])]
    assert added(4) == ["555-123-4567", "(555) 123 4567", "555-123-4567"]
    assert added(5) == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert added(7) == [w for w in ("7536784127813050", "4845168114407329") if passes_luhn(w)] and added(7)
    con = duckdb.connect()
    small = rows
    documents = spark.createDataFrame(small, "doc_id long, text string").toPandas()  # noqa: F841
    con.register("documents", documents)
    want = sorted(con.execute(sql.private()).fetchall(), key=lambda r: r[0])
    assert want == [tuple(by[i]) for i, _ in small]


def test_scores_and_nothing(spark):
    df = spark.createDataFrame([(1, "card 4111111111111111"), (2, "order 4111111111111111"), (None, "a@b.c"), (None, None)], "doc_id long, text string")
    got = pii.find(df).collect()
    assert [r["card"][0]["score"] for r in got[:2]] == [90, 30] and all(r["card"][0]["base"] for r in got[:2])
    assert [len(r["email"]) for r in got] == [0, 0, 1, 0]
    assert pii.report(df.where("false")).count() == 0
