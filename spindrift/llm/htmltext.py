"""Main-text extraction from HTML by tag-path ratios.

A page becomes blocks of text with root-to-leaf tag paths, kept as a tree of
paths.  Per path the text length, the punctuation and the blocks are added up;
the ratios of text and of punctuation to blocks are smoothed over the tree (a
path weighs SMOOTH to the power of its distance), in two passes whatever the
number of paths, and fused by their product.  What elements say of themselves
(menu, footer, comments, article ...) is a factor of the fused ratio, never a
verdict: blocks whose path reaches a share of the best one are content, in page
order, so a page that lies in a form or in a "sidebar" as a whole loses nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Fixed values of HTML and of common page furniture.
_RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|xmp|noembed"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head title select option optgroup button input script style noscript template textarea iframe svg math object canvas xmp noembed audio video map".split())
_ASIDE = frozenset("nav footer aside form fieldset legend dialog menu menuitem".split())
_FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot masthead header topbar toolbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus widget search pagination pager skip copyright disclaimer legal hidden outbrain taboola".split())
#: Words that may stand beside those in a name: "sidebar-left" is a sidebar, "side-effects" is not.
_NEUTRAL = frozenset("site page global main top bottom left right upper lower first last list lists box boxes area section wrapper wrap container content inner outer block item items link links bar buttons button icons text title form section group panel slot unit small large wide mobile desktop js is the reader user post posts thread count new".split())
_CONTENT = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("th", ("tr", "table")), "th": ("td", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
_PART = re.compile(r"[^a-z]+")
#: Weight of a path one step away; share of the best score that content reaches; factors of
#: what is called furniture, and of what lies outside the declared or the likely article.
SMOOTH, SHARE, ASIDE, OUTSIDE = 0.5, 0.03, 0.02, 0.15
#: Elements nest so deep, as browsers have it; text of deeper ones belongs to the last.
DEEPEST = 512


def _named_furniture(value: str) -> bool:
    """Whether one of the names is furniture as a whole: all its words say so, or say nothing."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for w in _PART.split(name) if w]
        if any(w in _FURNITURE for w in words) and all(w in _FURNITURE or w in _NEUTRAL for w in words):
            return True
    return False


def _aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element announces itself as something other than the article."""
    if tag in _ASIDE or tag == "header" and not inside:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", *_CONTENT) and _named_furniture(value):
            return True
    return False


@dataclass
class Paths:
    """The tree of tag paths; path 0 is the empty one, parents come before children."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    aside: list[bool] = field(default_factory=lambda: [False])
    known: dict[tuple[int, str, bool], int] = field(default_factory=dict)

    def child(self, path: int, tag: str, aside: bool) -> int:
        key = (path, tag, aside)
        if key not in self.known:
            self.known[key] = len(self.tag)
            self.tag.append(tag)
            self.parent.append(path)
            self.aside.append(aside)
        return self.known[key]

    def names(self, path: int) -> list[str]:
        out = []
        while path > 0:
            out.append(self.tag[path])
            path = self.parent[path]
        return out


def blocks_of(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The paths, and (path, text, characters of it within links) by block in page order."""
    paths, stack = Paths(), []  # stack: (tag, path, dropped)
    open_tags: Counter = Counter()
    out: list[tuple[int, str, int]] = []
    buffer: list[str] = []
    at_path, link, dropped, content, deeper = -1, 0, 0, 0, 0
    told: dict[tuple[str, str, bool], bool] = {}

    def put(text: str) -> None:
        nonlocal at_path, link
        if dropped or not text:
            return
        text = html.unescape(text)
        if at_path < 0 and text.strip():
            at_path = stack[-1][1] if stack else 0
        if open_tags["a"]:
            link += len(text)
        buffer.append(text)

    def end_block() -> None:
        nonlocal at_path, link
        if text := " ".join("".join(buffer).split()):
            out.append((at_path, text, link))
        buffer.clear()
        at_path, link = -1, 0

    def close(upto: int) -> None:
        nonlocal dropped, content
        if any(t not in _INLINE for t, _, _ in stack[upto:]):
            end_block()
        for t, _, bad in stack[upto:]:
            open_tags[t] -= 1
            dropped -= bad
            content -= t in _CONTENT
        del stack[upto:]

    def close_last(wanted: tuple[str, ...], stops) -> None:
        """Closes the last open one of the wanted elements, unless a stop lies over it."""
        if not any(open_tags[t] for t in wanted):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in wanted:
                return close(i)
            if stops(stack[i][0]):
                return None

    at = 0
    for m in _TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        shut, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if shut:
            if deeper:
                deeper -= 1
            else:
                close_last((tag,), (lambda t: t not in _INLINE) if tag in _INLINE else (lambda t: False))
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                end_block() if tag == "hr" else put(" ")
            continue
        if tag in _CLOSES_P:
            close_last(("p",), lambda t: t not in _INLINE)
        if tag in _SAME:
            other, stops = _SAME[tag]
            close_last((tag, other), lambda t, stops=stops: t in stops)
        if tag not in _INLINE:
            end_block()
        if attributes.rstrip().endswith("/") and tag in ("path", "g"):
            continue
        if len(stack) >= DEEPEST:
            deeper += 1
            continue
        key = (tag, attributes, content > 0)
        if key not in told:
            told[key] = _aside(*key)
        path = stack[-1][1] if stack else 0
        if tag not in _INLINE or told[key]:
            path = paths.child(path, tag, told[key])
        bad = tag in _DROPPED
        stack.append((tag, path, bad))
        open_tags[tag] += 1
        dropped += bad
        content += tag in _CONTENT
    put(page[at:])
    end_block()
    return paths, out


def smooth(paths: Paths, values: dict[int, float], weight: float = SMOOTH) -> list[float]:
    """By path p, the sum over the paths q of weight ** distance(p, q) * values[q]: up the tree, then down."""
    up = [values.get(p, 0.0) for p in range(len(paths.tag))]
    for p in range(len(up) - 1, 0, -1):
        up[paths.parent[p]] += weight * up[p]
    for p in range(1, len(up)):
        up[p] += weight * (up[paths.parent[p]] - weight * up[p])
    return up


def fused_ratios(paths: Paths, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """By path, the smoothed ratio of text to blocks times the root of that of punctuation."""
    length, marks, many = Counter(), Counter(), Counter()
    for path, text, link in blocks:
        length[path] += max(0, len(text) - link)
        marks[path] += len(_PUNCTUATION.findall(text))
        many[path] += 1
    text = smooth(paths, {p: length[p] / many[p] for p in many})
    mark = smooth(paths, {p: (1 + marks[p]) / many[p] for p in many})
    whole = smooth(paths, {p: 1.0 for p in many})
    return {p: text[p] / whole[p] * math.sqrt(mark[p] / whole[p]) for p in many}


def _likely_roots(paths: Paths, score: dict[int, float], mass: dict[int, float]) -> set[int]:
    """Where the article begins: declared elements that hold enough text, else the path over all that scores high."""
    total = [mass.get(p, 0.0) for p in range(len(paths.tag))]
    for p in range(len(total) - 1, 0, -1):
        total[paths.parent[p]] += total[p]
    declared = {p for p, t in enumerate(paths.tag) if t in _CONTENT and total[p] >= 0.3 * total[0] > 0}
    if declared:
        return declared
    best = max(score.values())
    strong = [p for p in score if score[p] >= 0.5 * best]
    # The deepest path that all of them share.
    under = [0] * len(paths.tag)
    for p in strong:
        under[p] += 1
    for p in range(len(under) - 1, 0, -1):
        under[paths.parent[p]] += under[p]
    return {max(p for p in range(len(under)) if under[p] == len(strong))}


def content_nodes(paths: Paths, blocks: list[tuple[int, str, int]], share: float = SHARE) -> list[int]:
    """Indices of the blocks on content paths."""
    if not blocks:
        return []
    fused = fused_ratios(paths, blocks)
    # Factors pass down the tree; a path called furniture twice is no less than one called so once.
    called = [False] * len(paths.tag)
    for p in range(1, len(called)):
        called[p] = called[paths.parent[p]] or paths.aside[p]
    score = {p: f * (ASIDE if called[p] else 1.0) for p, f in fused.items()}
    mass: Counter = Counter()
    for path, text, link in blocks:
        mass[path] += max(0, len(text) - link) * (ASIDE if called[path] else 1.0)
    roots = _likely_roots(paths, score, mass)
    within = [p in roots for p in range(len(paths.tag))]
    for p in range(1, len(within)):
        within[p] = within[p] or within[paths.parent[p]]
    score = {p: s * (1.0 if within[p] else OUTSIDE) for p, s in score.items()}
    best = max(score.values())
    if best <= 0:
        return []
    chosen = {p for p, s in score.items() if s >= share * best}
    heading = {p: not _HEADINGS.isdisjoint(paths.names(p)) for p in score}
    declared = {p for p in roots if paths.tag[p] in _CONTENT}
    # A block that is mostly links is navigation, unless it is a heading or in a declared article.
    kept = {i for i, (p, text, link) in enumerate(blocks) if p in chosen and (link * 2 <= len(text) or heading[p] or declared and within[p])}
    # A heading too short for its path to pass goes with the block that it stands over.
    for i in range(len(blocks) - 2, -1, -1):
        if i + 1 in kept and heading[blocks[i][0]] and not called[blocks[i][0]]:
            kept.add(i)
    return sorted(kept)


def main_text(page: str | None) -> str:
    paths, blocks = blocks_of(page or "")
    return " ".join(blocks[i][1] for i in content_nodes(paths, blocks))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Defined cases: null or empty html, and a page without content, give an
    empty text; a null id or url is kept; repeated rows give repeated rows;
    paths of equal score stand or fall together; broken markup is read as it
    comes; pages of any length are read whole, in time that grows with their
    length, one Arrow batch at a time; an empty table gives no row; other
    columns are not read.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
