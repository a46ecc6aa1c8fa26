"""Main text of web pages by two-pass block rules.

Pass 1 cuts the page into blocks and decides those it can by length, share of stop words and share of link text. Markup is one
more feature: what stands in menus, footers, forms or elements named like them is bad, and inside an article less length and fewer stop words are
asked for. Pass 2 gives each block still open (short, or with few stop words) the label of its nearest decided neighbours, those in the
same container first.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.llm.shingles import slices
from strandline.runtime import own, ship

#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be because but by can could for from had has have he her his i if in into is it its more not of on one or other our she so some than that the their them there they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous y "
    "als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "al como con del el ella ellos era es esta este han hay las lo los más me muy no nos o para pero por qué se si sin sobre son su sus también tiene todo una uno ya yo".split()
)
#: Elements whose content is never main text.
OUT = frozenset("nav aside footer form button select textarea dialog menu noscript template svg iframe object canvas audio video".split())
#: Parts of class, id and role that mark such content.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies related recommended share sharing social widget toolbar pagination pager login signup search contentinfo complementary dialog".split()
)
HEAD_NAMES = frozenset("header masthead topbar".split())
IN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = frozenset("p dt dd li h1 h2 h3 h4 h5 h6 option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small strike strong sub sup time tt u var".split())

#: Parts of a class that say what a page has or does, not what the element holds (has-sidebar, share-enabled). Words of place (left, wrapper) don't: a sidebar's wrapper holds a sidebar.
LAYOUT = frozenset("has no with without is not enabled disabled open closed active layout".split())

#: Attributes as browsers read them: a quote opens a value only right after the equals sign. Possessive, so that no page costs more than its length.
_ATTRIBUTE = r"""[^\s>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
_REST = rf"(?>[\s/]++|{_ATTRIBUTE}|=)*+"
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style|title|xmp|noembed|noframes)\b{_REST}>(?:.*?</(?P=raw)\s*>|.*\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_REST})>", re.S | re.I)
_ATTR = re.compile(r"""([^\s>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"\w+")
NAMED, OUTSIDE = 1, 2  # bad by the name of an element, by the element itself


@dataclass
class Block:
    text: str
    links: int  # characters of it inside links
    out: int  # 0, NAMED or OUTSIDE
    inside: bool  # of an article
    heading: bool
    container: int
    item: bool = False  # of a list
    label: str = ""


def _mark(name: str, attributes: str, in_article: bool) -> int:
    """0, NAMED or OUTSIDE of an element by its attributes. An article or main element isn't out by its name; hidden elements are."""
    out = 0
    for key, *values in _ATTR.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return OUTSIDE
        if key in ("class", "id", "role") and name not in IN:
            for token in value.split():
                parts = {x.lower() for x in _PARTS.findall(token)}
                if not parts & LAYOUT and (parts & OUT_NAMES or (parts & HEAD_NAMES and not in_article)):
                    out = NAMED
    return out


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, out, inside, container
    text: list[str] = []
    links = anchor = containers = 0

    def close() -> None:
        nonlocal links
        if text:
            squeezed = " ".join(htmllib.unescape("".join(text)).split())
            if squeezed:
                _, is_out, inside, container = stack[-1] if stack else ("", 0, False, 0)
                out.append(Block(squeezed, links, is_out, inside, any(s[0] in HEADINGS for s in stack[-2:]), container, any(s[0] == "li" for s in stack[-3:])))
            text.clear()
        links = 0

    def add(s: str) -> None:
        nonlocal links
        text.append(s)
        if anchor:
            links += len(s)

    # a tag that is cut off at the end of the page is none
    last = page.rfind(">") + 1
    if cut := re.search(r"<[a-zA-Z/!?]", page[last:]):
        page = page[: last + cut.start()]
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            anchor = 0 if m["end"] else 1
            continue
        if name in INLINE:
            continue
        is_block = name in BLOCK
        if is_block or name in OUT:
            close()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in OUT:
                        close()
                    del stack[i:]
                    break
            continue
        if is_block:
            while stack and stack[-1][0] in CLOSED_BY_BLOCK and not (stack[-1][0] in ("li", "dd") and name in ("p", "ul", "ol", "div")):
                stack.pop()
        if name in VOID or m["rest"].endswith("/"):
            continue
        _, was_out, was_in, container = stack[-1] if stack else ("", 0, False, 0)
        is_out = max(was_out, OUTSIDE if name in OUT or (name == "header" and not was_in) else 0, _mark(name, m["rest"], was_in) if name not in ("body", "html") else 0)
        if name == "main" and is_out == NAMED:
            is_out = 0  # a page has one, whatever its wrappers are called
        if is_block and name not in CLOSED_BY_BLOCK:
            containers += 1
            container = containers
        stack.append((name, is_out, was_in or name in IN, container))
    if page[at:]:
        add(page[at:])
    close()
    return out


def linked(found: list[Block]) -> list[float]:
    """Each block's share of characters inside links; items of an article's list share that of their list, as one item may well be a link."""
    whole: dict[int, list[int]] = {}
    for b in found:
        if b.item and b.inside:
            held = whole.setdefault(b.container, [0, 0])
            held[0], held[1] = held[0] + b.links, held[1] + len(b.text)
    return [whole[b.container][0] / whole[b.container][1] if b.item and b.inside else b.links / len(b.text) for b in found]


def decide(b: Block, trusted: int, links: float, short: int = 70, few: float = 0.15, most_links: float = 0.33) -> str:
    """Pass 1: good, bad, or open: short, or near (longer, with few stop words: tables, other languages). links: its share of them."""
    if b.out >= trusted or links > most_links:
        return "bad"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if b.inside:
        short, few = short // 2, few / 2
    if len(b.text) < short:
        return "short"
    return "good" if stops >= few else "near"


def inherit(found: list[Block], first: list[str]) -> list[str]:
    """Pass 2: labels of the open blocks from the nearest decided ones on either side, in their own container if it has any; the page's ends count as bad."""
    n = len(found)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        near: list[tuple[int, str] | None] = [None] * n
        home: list[tuple[int, str] | None] = [None] * n
        seen, by = None, {}
        for i in order:
            near[i], home[i] = seen, by.get(found[i].container)
            if first[i] in ("good", "bad"):
                seen = by[found[i].container] = (i, first[i])
        sides.append((near, home))
    (before, home_before), (after, home_after) = sides
    out = list(first)
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        p, q = (home_before[i], home_after[i]) if home_before[i] or home_after[i] else (before[i] or (-1, "bad"), after[i] or (n, "bad"))
        if p is None or q is None:
            out[i] = (p or q)[1]
        elif b.heading:
            out[i] = q[1]  # a heading goes with what follows it
        elif p[1] == q[1]:
            out[i] = p[1]
        else:
            out[i] = "good" if first[i] == "near" or q[0] - i == i - p[0] else p[1] if i - p[0] < q[0] - i else q[1]
    return out


def classify(found: list[Block]) -> list[Block]:
    """Labels good or bad by the two passes.

    Where no block is decided good, the open ones of an article are, or else all of the page but short ones that stand in no element; where there is none of these either, names of
    elements are not trusted and the rules judge what they had put aside.
    """
    density = linked(found)
    for trusted in (NAMED, OUTSIDE):
        first = [decide(b, trusted, x) for b, x in zip(found, density)]
        if "good" not in first:
            if any(x != "bad" and b.inside for b, x in zip(found, first)):
                first = ["good" if x != "bad" and b.inside else "bad" for b, x in zip(found, first)]
            else:
                first = ["good" if x == "near" or (x == "short" and b.container) else x for b, x in zip(found, first)]
        if "good" in first:
            break
    for b, label in zip(found, inherit(found, first)):
        b.label = label
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of each whole page, blocks joined by two line feeds; empty if there is none.

    Character references are decoded once, white space inside a block becomes one space. A null page counts as empty.
    Every row gives one row, repeated rows too; an empty table gives none.
    """
    ship(df.sparkSession)
    d = own(df, id_col, url_col, html_col)
    schema = T.StructType([d.schema[0], d.schema[1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2):
                texts = [main_text(x.as_py()) for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return d.mapInArrow(run, schema)
