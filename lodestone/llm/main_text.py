"""Main text of HTML pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags.  The first pass judges each block by
itself: blocks in menus, headers, footers, side bars, notices, adverts, forms and
readers' comments (by element, ``role``, or words of ``class`` and ``id``) and blocks
made of links are bad; long blocks dense in stop words are good; shorter ones are nearly
good; headings, short blocks and, inside an article, blocks without stop words are
ambiguous; the rest is bad.  The second pass gives every block that is not decided the
label of the nearest decided one in its scope; of two as near, good wins.

Where a page has an ``article`` or ``main`` element, that is the scope, the rest is bad,
and blocks that have no decided neighbour are good.  Elsewhere all blocks are the scope,
and without a decided neighbour nearly good ones are good and the others bad.

The rules need one page at a time, so the pages are read once, without a shuffle.

Defined results: null html counts as empty; an empty or unfinished page gives what it
holds, an empty text if that is none; character references are decoded once, after the
markup is gone; white space (also no-break spaces) inside a block is one space; elements
that are never closed end with the page; rows that repeat each get their own; very long
pages are read whole, in one pass; other columns are kept, and a clash of names gives
the new column underscores in front; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .workspace import fresh, slices

#: Characters below which a block is short, and from which it can be good by itself.
SHORT, LONG = 70, 200
#: Shares of stop words of a good and of a nearly good block; share of linked characters of a bad one.
DENSE, SOME, LINKED = 0.30, 0.15, 0.33

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "a an and are as at be been but by can for from had has have he her his i if in into is it its not of on or our she so that the their them then there these they this to was we were what when which who will with would you your",
    "de": "als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war wenn werden wie wir zu zum zur",
    "fr": "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses si son sont sur tu un une vous y été être",
    "es": "a al como con de del desde donde el ella en entre era es esta este fue ha hasta la las le lo los más me mi muy no nos o para pero por que se sin sobre son su sus también tan todo un una uno y ya",
}
#: Elements of which nothing is read, those that never hold main text, those
#: that hold it, those that start a block, and words of class and id that say the same.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "canvas", "object")
ASIDE = frozenset("nav footer aside form menu dialog fieldset button head".split())
HOME = frozenset("article main".split())
HOLDS = frozenset("div section header center ul ol dl table figure blockquote details body html".split()) | ASIDE | HOME
STARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr caption figcaption summary address legend".split()) | HOLDS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACES = frozenset("br td th img wbr".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent notice popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead related recommended recommendations share sharing social newsletter subscribe subscription comment comments reply replies discussion disqus widget toolbar pagination pager login signup "
    "search copyright disclaimer navigation contentinfo complementary alert alertdialog dialog".split()
)
TOP_WORDS = frozenset(("header", "topbar"))
HOME_WORDS = frozenset(("articlebody",))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = [frozenset(words.split()) for words in STOP_WORDS.values()]
_ANY_STOP = frozenset().union(*_STOPS)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    """Text between two block-level tags, and what the rules say of it."""

    tag: str
    text: str
    place: int  # -1: in a part that is never main text, 1: in an article, 0: elsewhere
    stop_density: float = 0.0
    link_density: float = 0.0
    first: str = "bad"
    label: str = "bad"


def _place(tag: str, attributes: str, around: int) -> int:
    """Where the inside of an element is, by the element and by where it stands."""
    if around < 0 or tag in ASIDE or (tag == "header" and around < 1):
        return -1
    home = around == 1 or tag in HOME
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return -1
        if name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one.lower() if one.isupper() else one))]
                if one.lower() in HOME_WORDS or (name == "role" and words in (["main"], ["article"])):
                    home = True
                elif words and words[0] not in ("with", "has", "no", "without") and (not ASIDE_WORDS.isdisjoint(words) or (not home and not TOP_WORDS.isdisjoint(words))):
                    return -1
    return int(home)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order, without labels."""
    out: list[Block] = []
    held: list[tuple[str, int]] = []  # open elements that hold blocks, with their places
    parts: list[str] = []
    linked, in_link, tag, place, own = 0, False, "", 0, 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tag, text, own, link_density=min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing = bool(m[2] or m[5])
        if name == "a":
            in_link = not closing
        elif name in SPACES:
            parts.append(" ")
        elif name in STARTS:
            end()
            if name in HOLDS:
                if not closing:
                    place = _place(name, m[4] or m[7] or "", place)
                    held.append((name, place))
                else:
                    for k in range(len(held) - 1, -1, -1):
                        if held[k][0] == name:
                            del held[k:]
                            place = held[-1][1] if held else 0
                            break
                in_link = False
            tag, own = ("", place) if closing or name in HOLDS else (name, _place(name, m[4] or m[7] or "", place))
            if own == 1 and tag not in HEADINGS and any(h == "header" for h, _ in held):
                own = -1  # by-lines and dates above an article
    say(page[at:])
    end()
    return out


def classify(page: str, short: int = SHORT, long: int = LONG, dense: float = DENSE, some: float = SOME, linked: float = LINKED) -> list[Block]:
    """The blocks of a page with the labels of both passes: ``first`` is good, near, short or
    bad, ``label`` good or bad."""
    found = blocks(page)
    home = any(b.place == 1 for b in found)
    scope = []
    for b in found:
        if b.place < 0 or (home and b.place < 1):
            continue
        scope.append(b)
        words = _WORD.findall(b.text.lower())
        stops = list(filter(_ANY_STOP.__contains__, words))
        b.stop_density = max(sum(map(own.__contains__, stops)) for own in _STOPS) / len(words) if stops else 0.0
        if b.link_density > linked:
            b.first = "bad"
        elif b.tag in HEADINGS or len(b.text) < short:
            b.first = "short"
        elif b.stop_density >= dense:
            b.first = "good" if len(b.text) >= long else "near"
        elif b.stop_density >= some:
            b.first = "near"
        else:
            b.first = "short" if home else "bad"
    _inherit(scope, home)
    return found


def _inherit(scope: list[Block], home: bool) -> None:
    """The second pass: labels from the nearest decided neighbours, found from both sides."""
    decided = ("good", "bad")
    near: list[tuple[int, str]] = [(len(scope) + 1, "")] * len(scope)
    for places in (range(len(scope)), range(len(scope) - 1, -1, -1)):
        far, label = len(scope) + 1, ""
        for k in places:
            far, label = (0, scope[k].first) if scope[k].first in decided else (far + 1, label)
            if label and (far < near[k][0] or (far == near[k][0] and label == "good")):
                near[k] = far, label
    for b, (_, label) in zip(scope, near, strict=True):
        b.label = b.first if b.first in decided else label or ("good" if home or b.first == "near" else "bad")


def main_text(page: str, **rules) -> str:
    """The good blocks of a page, joined by an empty line."""
    return "\n\n".join(b.text for b in classify(page, **rules) if b.label == "good")


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "main_text", keep: list[str] | None = None, **rules) -> DataFrame:
    """The columns of ``pages`` (or those of ``keep``) and the main text; a row per row."""
    ship(pages.sparkSession)
    kept = pages.columns if keep is None else keep
    name = fresh(kept, out_col)
    schema = T.StructType([*pages.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.StringType())])
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(x.as_py(), **rules) for x in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], schema.names)

    return rows.mapInArrow(run, schema)


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **rules) -> DataFrame:
    """A row per block: id_col, block (from 0, in page order), tag, text, stop_density,
    link_density, first (label of the first pass) and label (good or bad)."""
    ship(pages.sparkSession)
    schema = T.StructType([pages.schema[id_col], *T._parse_datatype_string("block int, tag string, text string, stop_density double, link_density double, first string, label string").fields])
    rows = pages.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=64):
            found = [(k, n, b) for k, x in enumerate(batch.column(1)) for n, b in enumerate(classify(x.as_py(), **rules))]
            columns = [pa.array([k for k, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int32())]
            columns[0] = batch.column(0).take(columns[0])
            for field in ("tag", "text", "stop_density", "link_density", "first", "label"):
                columns.append(pa.array([getattr(b, field) for _, _, b in found], pa.float64() if "density" in field else pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
