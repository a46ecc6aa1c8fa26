"""Operators that judge row by row: media, BPE, URLs, pages."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe, htmltext, queries, tiff, urlfilter

ODD = ["", None, " ", "  a  b ", "a\n\n b\t", "It's we'LL don't", "<|endoftext|>x<|endoftext|> <|endo", "naïve ß 漢字かな 🙂👩‍👩‍👧", "1234 5.6e7", "\x1c\x1d \x85\xa0\u2003x", "a" * 5000, "=" * 3000, "0" * 777, "\u0000\ufeff", "²½Ⅷ٣"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    pool = "abcdefghij  \n'stre.,!ABC01é漢🙂\t\u3000"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", None), (3, "again", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n", F.lit(1)).toDF("doc_id", "text", "ids", "TEXT")


def test_bpe_equals_tokenizer(odd, spark):
    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    text = {r["doc_id"]: r[1] for r in odd.toDF("doc_id", "t", "x", "y").collect() if r["doc_id"] != 3}
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] != 3:
            want = t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == want
            assert r["text"] == t.decode(want, skip_special_tokens=False)
    key = lambda r: (r["doc_id"] or -1, r["ids"], r["text"])
    assert sorted(map(key, got)) == sorted(map(key, bpe.round_trip(odd, path).collect()))


def test_pretokens_agree_on_every_character():
    t = Tokenizer.from_file(queries.tokenizer_path())
    c = bpe.codec(queries.tokenizer_path())
    rng = random.Random(1)
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    rng.shuffle(chars)
    for i in range(0, len(chars), 100):
        s = "".join(x + rng.choice(["a", "1", " ", "!", "  b"]) for x in chars[i : i + 100])
        assert c.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_bpe_empty_table_and_unknown_ids(spark):
    path = queries.tokenizer_path()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    got = bpe.decode(spark.createDataFrame([(1, [72, 999999]), (2, None)], "doc_id long, ids array<int>"), path).collect()
    assert [r["text"] for r in got] == [bpe.codec(path).decode([72]), ""]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("coding", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(order, coding, predictor, tile):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, (50, 37), dtype=np.uint8), rng.integers(0, 60000, (33, 20, 3), dtype=np.uint16), np.repeat(np.arange(250, dtype=np.uint8)[:, None], 64, 1)]
    data = tiff.write_tiff(pages, coding, predictor, rows_per_strip=7, tile=tile, order=order)
    got = [tiff.read_page(data, o, f) for o, f in tiff.directories(data)]
    assert len(got) == 3
    for a, b in zip(pages, got):
        assert np.array_equal(a if a.ndim == 3 else a[:, :, None], b)


def test_lzw_and_packbits_round_trip():
    rng = random.Random(2)
    for n in [0, 1, 2, 100, 5000, 70000]:
        for top in (1, 3, 255):
            data = bytes(rng.randrange(top + 1) for _ in range(n))
            assert tiff.unlzw(tiff.lzw(data)) == data
            assert tiff.unpackbits(tiff.packbits(data)) == data


def test_tiff_pages_bad_files(spark):
    good = tiff.write_tiff([np.zeros((2, 3), np.uint8), np.ones((1, 1), np.uint8)])
    broken = good[:10] + b"\xff" * 4 + good[14:]
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0"), (5, good[:-20]), (6, broken), (1, good)]
    df = spark.createDataFrame(rows, "id long, content binary").withColumn("page", F.lit("clash"))
    got = tiff.tiff_pages(df, "content", keep=("id",)).collect()
    assert sorted((r["id"], r["page"]) for r in got if r["id"] == 1 and r["error"] is None) == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r["id"] for r in got if r["error"]} >= {2, 3, 4, 5}
    assert all(r["pixels"] is None for r in got if r["error"])
    assert len([r for r in got if r["id"] == 1]) == 4


def test_op2_contract(odd, spark, tmp_path):
    texts = {r[0]: r[1] for r in odd.toDF("a", "b", "c", "d").collect() if r[0] != 3}
    odd.toDF("doc_id", "text", "ids", "TEXT_").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_tiff_media(spark, str(tmp_path)).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] == 3:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, 64)])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_urls(spark):
    rows = ["http://www.example.com/en/1", "http://m.example.com/en/1", "http://example.com/fr/", "http://a.net/es/x?y", "http://net/fr/", "http://net/fr", "http://xnet/fr/", "nothing", None, "https://EXAMPLE.com#/en/", "http://example.com", "http://u@example.com:80/en/", "http://www.www.example.com/en/", "", "a://b://c/en/", "http://example.com?x=/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, queries.URL_RULES).collect()}
    for i, u in enumerate(rows):
        host, path = urlfilter.split_url(u)
        fits = [(len(x.label), x.label, x.verdict) for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict)
    assert urlfilter.filter_urls(df.where("false"), queries.URL_RULES).count() == 0


def test_rules_are_filed_under_the_rarest_token():
    index = urlfilter.RuleIndex(queries.URL_RULES, {"com": 100, "example": 50, "en": 40, "www": 3, "net": 9, "es": 1, "fr": 2})
    assert {t: sorted(c[1] for c in v) for t, v in index.by_token.items()} == {"com": ["com/"], "en": ["example.com/en/"], "www": ["www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"]}
    own = urlfilter.RuleIndex([urlfilter.Rule("track.io", "/", "block", pattern=r".*track\.io/p\d+", name="p")])
    assert own.decide("x.track.io", "/p12") == ("p", "block") and own.decide("x.track.io", "/q") == (None, None)


def test_rules_of_one_host_and_path_are_all_tried():
    rules = [urlfilter.Rule("example.com", "/", "block", pattern=r".*example\.com/ads\d+"), urlfilter.Rule("example.com", "/", "allow", pattern=r".*example\.com/news"), urlfilter.Rule("example.com", "/ads12", "allow")]
    index = urlfilter.RuleIndex(rules)
    assert index.decide("example.com", "/ads1") == ("example.com/", "block") and index.decide("example.com", "/news") == ("example.com/", "allow")
    assert index.decide("m.example.com", "/ads12") == ("example.com/ads12", "allow") and index.decide("example.com", "/x") == (None, None)


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (page("<nav><ul><li><a href='/x'>x</a></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three&nbsp;four\n five.</p></article><footer>&copy; me</footer>"), "A & B\n\nOne two.\n\nThree four five."),
    (page("<article><p>Text.<script>var t='</p>';</script> More.<!-- <p>no</p> --></p><section class='comments'><p>First!</p></section><form><p>Name</p></form><p class='cookie-notice'>We use</p><p>End</p></article><p>Outside.</p>"), "Text. More.\n\nEnd"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<article><p>&amp;lt; &#65;&#x42; <a title='>'>c</a></p><p>unclosed<p>next</article><script>never closed", "&lt; AB c\n\nunclosed\n\nnext"),
    ("", ""),
    (None, ""),
    ("plain words", ""),
    (page("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Body.</p><aside>side</aside></main>"), "Title\n\nBody."),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_blocks_without_article_inherit_labels():
    long = "This is the text of a page that has no article element and it is long enough to be taken by the rules for stop words. " * 2
    body = f"<div><a href=/>Home</a> <a href=/>News</a></div><h2>Heading</h2><div>{long}</div><div>Short one.</div><div>{long}</div><div>Tiny</div><div><a href=/>Contact us here</a></div>"
    # Tiny stands as near to the text before it as to the menu after it, and goes with the text.
    assert htmltext.main_text(page(body)) == f"Heading\n\n{long.strip()}\n\nShort one.\n\n{long.strip()}\n\nTiny"
