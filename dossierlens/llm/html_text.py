"""The main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its own words and
link density, those of the blocks before and after it, and the kind of container it stands
in; a decision tree trained on a small labelled table made here says which blocks are
main text. All blocks it takes are kept whole, in page order. A class name decides nothing by itself:
the tree also sees how much of the page's words its element holds, and whether a first heading.

Tags are found by one scan from left to right, whose time is in proportion to the page however broken it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches
from .trees import Tree, fit_tree

N_LABELLED_PAGES = 400

# Elements of HTML.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = "script style noscript template svg math iframe object canvas audio video title textarea select button head".split()
OUTSIDE = set("nav aside footer form header menu dialog fieldset".split())
CLOSED_BY_NEXT = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
# Words in class, id and role that name what is not the article.
REMARKS = set("comment comments commentlist reply replies respond discussion disqus related recommended recommendations".split())
HINTS = REMARKS | set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav footer header masthead topbar banner ad ads adv "
    "advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social widget widgets toolbar pagination pager "
    "copyright legal complementary contentinfo search skip disclaimer alert form poll".split()
)

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT if name != "head"}
_LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
# What a hidden element's attributes hold, and those of others may.
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

@dataclass
class Block:
    text: str
    tag: str
    words: int
    link_density: float
    outside: bool
    inside: bool
    zone: int = -1
    """The innermost element around the block whose names hint at what is not the article."""
    share: float = 0.0
    """The share of the page's words in that element."""
    leads: bool = False
    """Whether it holds a first heading."""
    remarks: bool = False
    """Whether its names hint at remarks of readers."""


def hidden(attributes: str) -> bool:
    """Whether the attributes of a tag hide the element."""
    if not _HIDDEN.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip()
        if (
            name == "hidden" and not value.lower().startswith("until")
            or name == "aria-hidden" and value.lower() == "true"
            or name == "style" and _NOT_SHOWN.search(value)
        ):
            return True
    return False


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``(begin, end, closing, tag, attributes)`` of the markup of a page; the tag is empty for what shows nothing.

    A tag ends at the first ``>`` outside quotes, or, where its quotes do not close, at the first one. What
    such vain searches read is counted; beyond the length of the page all tags end at the first ``>``.
    """
    gone: set[str] = set()
    vain, at = 0, 0

    def find(what: str, begin: int) -> int:
        found = -1 if what in gone else html.find(what, begin)
        if found < 0:
            gone.add(what)
        return found

    while opened := _OPEN.search(html, at):
        begin, at = opened.span()
        if opened.group() == "<!--":
            end = find("-->", at)
            at = len(html) if end < 0 else end + 3
            yield begin, at, False, "", ""
            continue
        first = find(">", at)
        if first < 0:
            return
        closing, tag = bool(opened.group(1)), (opened.group(2) or "").lower()
        if tag in _CLOSING and not closing:
            ended = None if html[first - 1] == "/" else _CLOSING[tag].search(html, first)
            at = first + 1 if html[first - 1] == "/" else ended.end() if ended else len(html)
            yield begin, at, False, "", ""
            continue
        end = at
        while tag and vain <= len(html):
            end = _PLAIN.match(html, end).end()
            quote = -1 if end == len(html) else end if html[end] == ">" else find(html[end], end + 1)
            if quote < 0:
                vain += end - at + 1
                end = first
                break
            if quote == end:
                break
            end = quote + 1
        else:
            end = first
        yield begin, end + 1, closing, tag, html[at:end] if tag else ""
        at = end + 1


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order.

    A form is outside, unless it holds an article or main, or several blocks with most of the page's words.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, int, bool, bool, int]] = []  # tag, zone that counts, zone, outside, inside, outermost form
    opened: Counter[str] = Counter()
    parents: list[int] = []  # of each zone
    remarks: list[bool] = []
    leads: list[bool] = []
    standing: list[tuple[int, int]] = []  # zone and form of each block
    wraps: list[bool] = []  # of each form: whether it holds an article or main
    pieces: list[str] = []
    linked: list[str] = []
    in_link = 0
    tag_now = "body"

    def state() -> tuple[int, int, bool, bool, int]:
        return stack[-1][1:] if stack else (-1, -1, False, False, -1)

    def end_block() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            in_links = len(unescape(" ".join(linked)).split())
            counts, zone, outside, inside, form = state()
            standing.append((zone, form))
            found.append(Block(text, tag_now, words, min(1.0, in_links / words), outside, inside, counts))
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if in_link:
                linked.append(text)

    at = 0
    for begin, end, closing, tag, rest in tags(html):
        add(html[at:begin])
        at = end
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            end_block()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                popped = ""
                while popped != tag:
                    popped = stack.pop()[0]
                    opened[popped] -= 1
                if tag in BLOCKS:
                    tag_now = stack[-1][0] if stack else "body"
            continue
        while stack and tag in CLOSED_BY_NEXT.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        counts, zone, outside, inside, form = state()
        names = {
            part.lower()
            for groups in (_NAMES.findall(rest) if rest else ())
            for name in groups
            for part in _PART.findall(name)
        }
        if tag in ("article", "main"):
            inside = True
            if counts >= 0 and not remarks[counts]:
                counts = -1
            if form >= 0:
                wraps[form] = True
        if tag in ("body", "html", "main"):
            names = set()
        if tag == "form" and form < 0:
            form = len(wraps)
            wraps.append(False)
        if names & HINTS:
            parents.append(zone)
            remarks.append(bool(names & REMARKS))
            leads.append(False)
            counts = zone = len(parents) - 1
        if tag == "h1" and zone >= 0:
            leads[zone] = True
        outside = outside or tag in OUTSIDE and tag != "form" and not (tag == "header" and inside)
        outside = outside or bool(rest) and hidden(rest)
        stack.append((tag, counts, zone, outside, inside, form))
        opened[tag] += 1
        if tag in BLOCKS:
            tag_now = tag
    add(html[at:])
    end_block()

    total = sum(b.words for b in found)
    words, holds = Counter(), Counter()
    for block, (_, form) in zip(found, standing):
        words[form] += block.words
        holds[form] += 1
    for block, (_, form) in zip(found, standing):
        block.outside = block.outside or form >= 0 and not wraps[form] and (holds[form] < 2 or 2 * words[form] <= total)
    shown = sum(b.words for b in found if not b.outside)
    held = [0] * len(parents)
    for block, (zone, _) in zip(found, standing):
        if zone >= 0 and not block.outside:
            held[zone] += block.words
    for zone in range(len(parents) - 1, -1, -1):  # those inside come after those around them
        if parents[zone] >= 0:
            held[parents[zone]] += held[zone]
            leads[parents[zone]] |= leads[zone]
    for block in found:
        if block.zone >= 0:
            block.share, block.leads = held[block.zone] / max(1, shown), leads[block.zone]
            block.remarks = remarks[block.zone]
            block.inside = block.inside and (block.leads or not block.remarks)
    return found


def features(found: list[Block]) -> np.ndarray:
    """One row per block: itself, its neighbours, and where it stands."""
    own = np.array([(b.words, b.link_density) for b in found], dtype=float).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    marked = float(any(b.inside and not b.outside for b in found))
    more = np.array(
        [
            (
                b.outside, 1 - b.share if b.zone >= 0 else 0, b.remarks and not b.leads, b.inside, marked, b.tag[0] == "h" and b.tag[1:].isdigit(),
                b.tag == "li", b.text[-1] in ".!?:;\"”»…", b.words <= 30 and bool(_LEGAL.search(b.text)),
            )
            for b in found
        ],
        dtype=float,
    ).reshape(-1, 9)
    return np.hstack([own, before, after, more])


def labelled_pages(n: int = N_LABELLED_PAGES, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Small pages made by rule, with 1 for each block of main text and 0 for each other.

    Names mislead in part of them: an element around the whole page is called after a sidebar, a footer or
    remarks, and notices stand without a name, so that neighbours have to tell short text from short text.
    """
    rng = np.random.default_rng(seed)

    def words(low: int, high: int) -> str:
        count = int(rng.integers(low, high + 1))
        return " ".join("".join("abcdefghinorstu"[k] for k in rng.integers(0, 15, int(rng.integers(2, 9)))) for _ in range(count))

    def one(*options):
        return options[int(rng.integers(0, len(options)))]

    pages = []
    for i in range(n):
        parts: list[tuple[str, list[int]]] = []

        def links(open_tag: str, close: str, low: int = 2, high: int = 8) -> None:
            k = int(rng.integers(low, high + 1))
            long = one((1, 3), (1, 3), (12, 60))  # teasers are as long as text
            parts.append((open_tag + "<ul>" + "".join(f'<li><a href="/x">{words(*long)}</a></li>' for _ in range(k)) + "</ul>" + close, [0] * k))

        def outside(open_tag: str, close: str, low: int = 2, high: int = 30) -> None:
            parts.append((f"{open_tag}{words(low, high)}.{close}", [0]))

        wrapped = rng.random() < 0.35
        if wrapped:
            name = one("main-content has-sidebar", "search-results layout", "page footer-fixed", "post has-comments", "wrap no-banner", "header-fixed site")
            parts.append((f'<div class="{name}">', []))
        if rng.random() < 0.15:
            parts.append((f'<div class="header"><h1>{words(1, 4)}</h1></div>', [0]))
        if rng.random() < 0.8:
            links(*one(("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ("<div>", "</div>"), ("<header>", "</header>")))
        if rng.random() < 0.6:
            outside(*one(('<div class="ad">', "</div>"), ('<div id="cookie-notice">', "</div>"), ('<div class="banner promo">', "</div>"), ("<header>", "</header>"), ("<aside>", "</aside>")))
        if rng.random() < 0.4:
            outside(*one(("<div>", "</div>"), ("<p>", "</p>")), 2, 9)
            links("<div>", "</div>")
        marked = i % 2 != 0
        parts.append((one("<article>", "<main>", "<article><header>") if marked else one("<div>", '<div class="content">'), []))
        parts.append((f"<h1>{words(3, 12)}</h1>", [1]))
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            low, high = (1, 6) if kind < (0.3 if marked else 0.15) else (12, 120)
            link = f' <a href="/y">{words(1, 2)}</a> ' if rng.random() < 0.2 and low > 1 else ""
            parts.append((f"<p>{words(low, high)}{link}.</p>", [1]))
            if marked and rng.random() < 0.1:
                parts.append((f"<ul><li>{words(1, 9)}</li><li>{words(1, 9)}</li></ul>", [1, 1]))
            if rng.random() < 0.08:
                outside(*one(('<div class="ad">', "</div>"), ("<aside>", "</aside>"), ('<div class="share">', "</div>"), ("<form>", "</form>")), 1, 20)
        parts.append(("</article></main>" if marked else "</div>", []))
        if rng.random() < 0.5:
            for _ in range(int(rng.integers(1, 7))):
                outside(*one(('<div class="comments"><p>', "</p></div>"), ('<section id="comments"><article>', "</article></section>"), ("<form><label>", "</label></form>")), 2, 60)
        if rng.random() < 0.5:
            links(*one(('<div class="related">', "</div>"), ("<aside>", "</aside>"), ('<div class="sidebar">', "</div>")), 1, 5)
        outside(*one(("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="copyright">', "</div>")), 1, 25)
        if rng.random() < 0.5:
            sign = one("© 2020 ", "Copyright 2021 ", "All rights reserved. ")
            parts.append((one("<p>", "<div>") + sign + words(1, 9) + ".", [0]))
        pages.append(("".join(p for p, _ in parts), [x for _, labels in parts for x in labels]))
    return pages


@cache
def trained_tree(n: int = N_LABELLED_PAGES) -> Tree:
    rows, labels = [], []
    for html, truth in labelled_pages(n):
        rows.append(features(blocks(html)))
        labels.extend(truth)
    return fit_tree(np.vstack(rows), np.array(labels, dtype=float), max_depth=12, min_leaf=5)


def main_blocks(html: str | None, tree: Tree) -> list[str]:
    """The texts of a page's main blocks."""
    found = blocks(html) if html else []
    if not found:
        return []
    chosen = tree.predict(features(found)) >= 0.5
    return [b.text for b, keep in zip(found, chosen) if keep]


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without main text, give an empty text. Null ids and urls
    are carried; rows that repeat are each read by themselves. No shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained_tree())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = ["\n".join(main_blocks(html, shared.value)) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    key = pages.schema["page_id"].dataType.simpleString()
    return small_batches(pages).select("page_id", "url", "html").mapInArrow(extracted, f"page_id {key}, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
