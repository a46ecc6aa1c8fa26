"""Block rules against a plain version that looks at every pair of blocks, on generated pages, and on the pages table with article tags taken away."""

import random
import re
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.llm import htmltext, queries

TABLE = Path("/root/testdata/sf0.01/pages.parquet")
SENTENCE = "This is the text of the article, and it has a number of words that are common in it for the test."


class Plain(HTMLParser):
    """Blocks of well-formed pages: (text, characters in links, level, inside, heading, container)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text, self.linked, self.count = [], [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            level = max([o[1] for o in self.open], default=0)
            inside = any(o[0] in ("article", "main") for o in self.open)
            container = next((o[2] for o in reversed(self.open) if o[2]), 0)
            self.found.append([text, self.linked, level, inside, bool(self.open) and self.open[-1][0] in ("h1", "h2"), container])
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b"):
            self.open.append((tag, 0, 0))
            return
        self.flush()
        named = [w for k, v in attrs if k in ("class", "id") and tag not in ("article", "main") for w in (v or "").split()]
        level = 2 if tag in ("nav", "footer", "form", "aside") else 1 if any(w in ("ad", "comments", "sidebar") for w in named) else 0
        self.count += 1
        self.open.append((tag, level, self.count if tag not in ("p", "li", "h1", "h2") else 0))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        while self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.text.append(data)
        if any(o[0] == "a" for o in self.open):
            self.linked += len(data)


def plain_text(page):
    p = Plain()
    p.feed(page)
    p.flush()
    for trusted in (1, 2):
        first = []
        for text, linked, level, inside, _, _ in p.found:
            words = re.findall(r"\w+", text.lower())
            share = sum(w in htmltext.STOP_WORDS for w in words) / max(1, len(words))
            if level >= trusted or linked > 0.33 * len(text):
                first.append(False)
            elif len(text) < (35 if inside else 70):
                first.append("short")
            else:
                first.append(True if share >= (0.075 if inside else 0.15) else "near")
        if True not in first:
            article = any(x and b[3] for x, b in zip(first, p.found))
            first = [bool(x and b[3]) if article else True if x == "near" or (x == "short" and b[5]) else x for x, b in zip(first, p.found)]
        if True in first:
            break
    out = []
    for i, x in enumerate(first):
        if isinstance(x, str):
            decided = [(j, y) for j, y in enumerate(first) if not isinstance(y, str)]
            home = [(j, y) for j, y in decided if p.found[j][5] == p.found[i][5]]
            pool = home or [(-1, False), *decided, (len(first), False)]
            below, above = [d for d in pool if d[0] < i][-1:], [d for d in pool if d[0] > i][:1]
            if not below or not above:
                x = (below or above)[0][1]
            elif p.found[i][4]:
                x = above[0][1]
            elif below[0][1] == above[0][1]:
                x = below[0][1]
            else:
                near, far = i - below[0][0], above[0][0] - i
                x = True if x == "near" or near == far else below[0][1] if near < far else above[0][1]
        if x:
            out.append(p.found[i][0])
    return "\n\n".join(out)


def generated(rng):
    words = "the of and is it mora telu sipa gano rife lopu vane".split()

    def text():
        return " ".join(rng.choice(words[: rng.choice([5, 12])] if rng.random() < 0.7 else words[5:]) for _ in range(rng.choice([2, 5, 12, 30, 60])))

    def part(depth):
        kind = rng.random()
        if kind < 0.5 or depth > 3:
            return f"<p>{text()}</p>" if rng.random() < 0.7 else f"<p>{text()} <a href='/x'>{text()}</a> {text()} &amp; <b>{text()}</b></p>"
        if kind < 0.6:
            return f"<h2>{text()}</h2>"
        tag = rng.choice(["div", "div", "section", "article", "nav", "footer", "aside", "ul"])
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        name = rng.choice(["", "", " class='ad'", " id='comments'", " class='has-sidebar'", " class='text'"])
        return f"<{tag}{name}>" + "".join(part(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><body>" + "".join(part(0) for _ in range(rng.randrange(1, 7))) + "</body></html>"


def test_generated_pages_against_a_plain_version():
    rng = random.Random(12)
    pages = [generated(rng) for _ in range(600)]
    got = [htmltext.main_text(p) for p in pages]
    assert [g for g, p in zip(got, pages) if g != plain_text(p)] == []
    assert sum(map(bool, got)) > 450


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'><article><p>{SENTENCE}</p></article></div>",
        f"<article class='post share-enabled'><p>{SENTENCE}</p></article>",
        f"<main class='search'><p>{SENTENCE}</p></main>",
        f"<main id='page-notice'><p>{SENTENCE}</p></main>",
        f"<article><p title='A hidden gem'>{SENTENCE}</p></article>",
        f"<article><p data-state='hidden'>{SENTENCE}</p></article>",
        f"<div class='sidebar'><p>{SENTENCE}</p></div><nav><a href='/'>Home and the rest of it</a></nav>",
        f"<article><a href='/x'>Teaser of something else</a></article><div><p>{SENTENCE}</p></div><div class='ad'><p>{SENTENCE} Buy.</p></div>",
        f"<article><p>{SENTENCE}</p><p hidden>{SENTENCE}</p><p style='display: none'>{SENTENCE}</p></article>",
    ],
)
def test_names_and_values_do_not_cost_the_article(page):
    assert htmltext.main_text(page) == SENTENCE


def test_an_apostrophe_in_a_bare_value_ends_with_it():
    assert htmltext.main_text("<article><p title=it's>First para.</p><p>Second don't lose.</p></article>") == "First para.\n\nSecond don't lose."


def test_long_and_broken_pages():
    long = "<article>" + f"<p>{SENTENCE}</p>" * 20_000 + "</article>"
    assert htmltext.main_text(long).count(SENTENCE) == 20_000
    for broken in ("<p title='" * 50_000, "<p " + "a='" * 50_000, "<" * 100_000, "<p a=" * 50_000):
        assert isinstance(htmltext.main_text(broken), str)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{SENTENCE}</p>", "x")] * 2 + [(None, None, None, None)], "page_id long, url string, html string, TEXT string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()) == [(0, "", 0)] + [(1, SENTENCE, len(SENTENCE))] * 2
    assert htmltext.extract(df.where("false")).count() == 0


@pytest.mark.skipif(not TABLE.exists(), reason="the pages table is not here")
def test_pages_without_article_tags(spark):
    """The rules decide as the tags would: blocks of the pages whose article and main tags are made div."""
    pages = spark.read.parquet(str(TABLE))
    bare = pages.withColumn("html", F.regexp_replace("html", r"(</?)(article|main)\b", "$1div"))
    hit = said = there = 0
    got = {r["page_id"]: Counter(r["text"].split("\n\n")) for r in htmltext.extract(bare).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)
        want = Counter(b.text for b in htmltext.blocks(f"<article>{inner[1]}</article>") if not b.out)
        hit, said, there = hit + (want & got[r["page_id"]]).total(), said + got[r["page_id"]].total(), there + want.total()
    assert hit / said >= 0.98 and hit / there >= 0.98 and queries.op7_main_text(spark, str(TABLE.parent)).count() == pages.count()


PROSE = "The history of the harbour is long, and it was known to all of the people who lived there in those days. " * 2


@pytest.mark.parametrize("name", ["comments-container", "left-sidebar", "sidebar-wrapper", "top-menu", "cookie-banner-bottom", "relatedPosts right", "newsletter_signup wrapper"])
def test_words_of_place_do_not_hide_what_an_element_holds(name):
    other = "This is what some of the readers have said of it, and it is not a part of the article that they were reading. " * 2
    assert htmltext.main_text(f"<article><p>{PROSE}</p></article><div class='{name}'><p>{other}</p></div>") == PROSE.strip()


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "with-menu", "menu-open"])
def test_modifiers_do(name):
    assert htmltext.main_text(f"<div class='{name}'><article><p>{PROSE}</p></article></div>") == PROSE.strip()


def test_an_item_that_is_a_link_stays_in_an_article_s_list():
    page = f"<article><p>{PROSE}</p><ul><li>{PROSE[:100]}</li><li><a href='/x'>Linked item</a></li><li>{PROSE[:90]}</li></ul><p>{PROSE}</p><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></article>"
    got = htmltext.main_text(page).split("\n\n")
    assert "Linked item" in got and "One" not in got and len(got) == 5
