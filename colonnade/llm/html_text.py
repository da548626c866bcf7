"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text at block-level tags; a part of a line that is named as an advert or a button to share is a block of its own inside
the line. A classifier, a logistic regression over features of the block and of the elements around it, gives each block the log odds of being
content. It is fitted in numpy on pages that are generated with their truth (html_pages), TRAINING_PAGES of them, whatever the table. Source-to-block
capacity is the cost of calling the block boilerplate, block-to-sink capacity that of calling it content; blocks next to each other, and blocks under one
parent, are joined by smoothness capacities that fall with their distance in the tree, on the scale of the terminal costs. Maximum flow gives the minimum
cut, and the blocks on the source's side are content.

A class or id speaks for an element only if nothing else in the name does: no-sidebar or comments-open say what a page has, and a
word on body, on main, or on what holds the article says nothing about the text inside.

Defined cases: null, empty and tagless-but-blank pages give an empty text; text without any tags is one block, and content; unclosed tags end
where HTML implies, or with the page; end tags without a partner are passed over in constant time; malformed tags and very long pages are read
to their end; a null page_id or url is kept; repeated rows stay; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colonnade.llm.common import only, rows_in_blocks

#: Generated pages that the classifier is fitted on.
TRAINING_PAGES = 400

# Element names and the words of class and id attributes that the classifier knows.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas video audio head title select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion sidebar aside widget widgets comment comments commentlist respond reply replies disqus "
    "cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup login menu menus nav navbar navigation topnav breadcrumb breadcrumbs pagination pager "
    "footer foot copyright masthead share sharing social related recommended recommendations toolbar search skip outbrain taboola".split()
)
INLINE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored share sharing social".split())
#: Words that leave the meaning of a boilerplate word beside them as it is.
NEUTRAL_WORDS = frozenset(
    "site page top bottom left right main global primary secondary box block list item items link links wrap wrapper container section area bar inner outer row col column post posts article articles "
    "story stories slot unit zone panel form field button buttons group holder content body text title heading count more sticky fixed js".split()
)
#: Beside these a boilerplate word tells what the page has or lacks, not what the element is.
STATE_WORDS = frozenset("no not has have with without is are open opened closed enabled disabled on off visible hidden active inactive allowed".split())
CONTENT_WORDS = frozenset("article content post entry story main body text prose maincontent articlebody".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
CONTENT_ROLES = frozenset("main article".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Elements that an implied end never reaches through.
SCOPE = frozenset("table ul ol dl body html article section div main aside nav header footer form".split())

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RIGHTS = re.compile(r"^©|all rights reserved", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def name_words(name: str) -> list[str]:
    """Words of one class or id, lowered; capitals inside begin a word, digits say nothing."""
    return [w for w in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if w]


@lru_cache(maxsize=65536)
def name_says(names: str) -> tuple[bool, bool, bool, bool]:
    """Of a class or id attribute: whether some name in it is boilerplate's own, or only holds such a word; whether one is content's; whether one marks an advert or a share button."""
    full = weak = content = inline = False
    for name in names.split():
        words = set(name_words(name))
        if words & STATE_WORDS:
            continue
        if words & (BOILER_WORDS | {"header"}):
            if words <= BOILER_WORDS | NEUTRAL_WORDS | {"header"}:
                full = True
                inline |= bool(words & INLINE_WORDS)
            else:
                weak = True
        elif words & CONTENT_WORDS:
            content = True
    return full, weak, content, inline


class _Element:
    __slots__ = ("name", "parent", "depth", "skip", "linked", "block", "inside", "key", "full", "weak", "content", "role", "hidden", "advert", "chars", "has_h1", "has_article", "flags")

    def __init__(self, name: str, parent, attributes: str, key: int):
        self.name, self.parent, self.key = name, parent, key
        self.depth = parent.depth + 1 if parent else 0
        self.skip = name in SKIPPED or bool(parent and parent.skip)
        self.linked = name == "a" or bool(parent and parent.linked)
        inline = name in INLINE and parent is not None
        self.block = parent.block if inline else self
        self.inside = None if inline else Counter()
        self.full = self.weak = self.content = self.hidden = False
        self.advert = inline and parent.advert
        self.role, self.chars, self.has_h1, self.has_article, self.flags = 0, 0, False, False, None
        if "=" in attributes or "hidden" in attributes:
            self._read(attributes, inline)

    def _read(self, attributes: str, inline: bool) -> None:
        for m in _ATTRIBUTE.finditer(attributes):
            k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
            if k in ("class", "id"):
                full, weak, content, advert = name_says(v)
                self.full, self.weak, self.content = self.full or full, self.weak or weak, self.content or content
                self.advert = self.advert or (inline and advert)
            elif k == "role":
                self.role = -1 if v.lower() in BOILER_ROLES else 1 if v.lower() in CONTENT_ROLES else self.role
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and _HIDDEN.search(v)):
                self.hidden = True


class Block:
    """A run of text between block-level tags, or a part of one that is named as an advert, with what the classifier needs."""

    __slots__ = ("text", "raw", "linked", "element", "advert", "line")

    def __init__(self, raw: str, linked: int, element: _Element, advert: bool, line: int):
        self.raw, self.text = raw, " ".join(raw.split())
        self.linked, self.element, self.advert, self.line = linked, element, advert, line


def blocks_of(page: str) -> tuple[list[Block], list[_Element]]:
    """The page's blocks in order, and its elements, each after its parent; skipped elements have no blocks."""
    top = _Element("#page", None, "", 0)
    here, out, elements, at, line = top, [], [top], 0, 0
    held: list[tuple[str, bool, bool]] = []
    open_names: Counter = Counter()

    def close(upto: _Element) -> None:
        """Makes upto the open element."""
        nonlocal here
        while here is not upto:
            open_names[here.name] -= 1
            if here.inside is None:
                here.block.inside[here.name] -= 1
            here = here.parent

    def flush() -> None:
        nonlocal line
        if held:
            parts: list[list] = []
            for text, linked, advert in held:
                if not parts or (parts[-1][2] != advert and text.strip()):
                    parts.append([[], 0, advert])
                parts[-1][0].append(text)
                parts[-1][1] += len(text) if linked else 0
            made = [Block("".join(t), n, here.block, advert, line) for t, n, advert in parts]
            out.extend(b for b in made if b.text)
            line += 1
            held.clear()

    def say(text: str) -> None:
        if text and not here.skip:
            held.append((html.unescape(text) if "&" in text else text, here.linked, here.advert))

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if not m[1]:
            if name == "br":
                say(" ")
            if name in VOID:
                continue
            if name == "body" and here.name == "head":
                close(here.parent)
            if name not in INLINE and here.block.name == "p":
                close(here.block.parent)
            if name in CLOSED_BY:
                closes = CLOSED_BY[name]
                node, last = here, None
                while node.parent and node.name not in SCOPE and any(open_names[c] > 0 for c in closes):
                    if node.name in closes:
                        last = node.parent
                        if name != "tr":
                            break
                    node = node.parent
                if last is not None:
                    close(last)
            here = _Element(name, here, m[3], len(elements))
            elements.append(here)
            open_names[name] += 1
            if here.inside is None:
                here.block.inside[name] += 1
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
                close(here.parent)
        elif name in INLINE:
            if here.block.inside[name] > 0:
                node = here
                while node.name != name:
                    node = node.parent
                close(node.parent)
        elif open_names[name] > 0:
            node = here
            while node.name != name:
                node = node.parent
            close(node.parent)
    flush()
    return out, elements


def _surroundings(blocks: list[Block], elements: list[_Element]) -> int:
    """Sets each element's flags, from what it holds and from what it lies in; returns the characters of the page."""
    for b in blocks:
        b.element.chars += len(b.text)
        if b.element.name == "h1":
            b.element.has_h1 = True
    for e in reversed(elements[1:]):
        up = e.parent
        up.chars += e.chars
        up.has_h1 |= e.has_h1
        up.has_article |= e.has_article or e.name == "main" or e.role > 0 or (e.name == "article" and not (e.full or e.weak))
    total = max(elements[0].chars, 1)
    for e in elements:
        # section: -1 nearest is boilerplate's element, 1 an article or main; tag, full, weak, content, role, hidden: something above says so
        section, tag, heads, full, weak, content, role, hidden, article = e.parent.flags if e.parent else (0, 0, 0, 0, 0, 0, 0, 0, 0)
        wrapper = e.name in ("html", "body", "main", "#page") or e.has_article or (e.has_h1 and e.chars > 0.4 * total)
        if e.name in BOILER and not (e.name == "form" and wrapper):
            section, tag = -1, 1
        elif e.name in CONTENT:
            section = 1
            article = article or not (e.full or e.weak)
        elif e.name == "header" and not article:
            heads = 1
        if not wrapper and e.name not in INLINE:
            full, weak = full or e.full, weak or e.weak
            role = -1 if e.role < 0 else role
        if e.content:
            content = 1
        if e.role > 0:
            role = role or 1
        e.flags = section, tag, heads, int(full), int(weak), content, role, int(hidden or (e.hidden and not wrapper)), int(article)
    return total


def features(blocks: list[Block], elements: list[_Element]) -> np.ndarray:
    """A row of bounded numbers for each block."""
    total = _surroundings(blocks, elements)
    has_article = elements[0].has_article
    rows = []
    for i, b in enumerate(blocks):
        e, n = b.element, len(b.text)
        words = b.text.count(" ") + 1
        share = min(1.0, b.linked / n)
        section, tag, heads, full, weak, content, role, hidden, article = e.flags
        around = (e.parent.chars if e.parent else e.chars) / total
        rows.append(
            (
                1.0, min(math.log1p(words), 5.0), float(words < 6), share, share * (words < 9), float(e.name in ("p", "blockquote", "pre")), float(e.name == "h1"),
                float(e.name in ("h2", "h3", "h4", "h5", "h6")), float(e.name in ("li", "dt", "dd")), float(e.name in ("td", "th")), float(section < 0), float(section > 0), float(tag), float(heads),
                float(full), float(weak), float(content), float(role < 0), float(role > 0), float(hidden), float(bool(_RIGHTS.search(b.text))), float(b.text[-1] in ".!?…\"'”»"),
                min(1.0, (b.text.count(".") + b.text.count(",")) / words), around, float(has_article and not article), (i + 1) / len(blocks), float(b.advert), float(full and tag),
                float(full and section > 0), float(full and (e.full or e.parent.full)),
            )
        )
    own = np.array(rows).reshape(len(blocks), 30)
    pad = np.zeros((1, 2))
    near = np.concatenate([pad, own[:, [1, 3]], pad])
    return np.hstack([own, near[:-2], near[2:]])


@lru_cache(maxsize=4)
def classifier(pages: int = TRAINING_PAGES, seed: int = 17, penalty: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights of the features, by Newton steps on generated pages whose truth is known."""
    from colonnade.llm.html_pages import generated

    x, y = [], []
    for page, truth in generated(pages, seed):
        blocks, elements = blocks_of(page)
        x.append(features(blocks, elements))
        y += [b.text in truth for b in blocks]
    x, y = np.vstack(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
    return w


def minimum_cut(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of the minimum cut. gain[i]: capacity from the source less that to the sink; links: (i, j, capacity both ways)."""
    n = len(gain)
    left = list(gain)  # what a node can still send (above 0) or take (below 0), once its own two terminal edges are full
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, c in links:
        near[i].append(len(to))
        to.append(j)
        room.append(c)
        near[j].append(len(to))
        to.append(i)
        room.append(c)
    content = [False] * n
    for s in range(n):
        while left[s] > 0 and not content[s]:
            via, order, sink = {s: -1}, [s], -1
            for i in order:
                if left[i] < 0:
                    sink = i
                    break
                for e in near[i]:
                    j = to[e]
                    if room[e] and j not in via and not content[j]:
                        via[j] = e
                        order.append(j)
            if sink < 0:  # no way to the sink: these nodes are on the source's side, and no later flow can leave them
                for i in order:
                    content[i] = True
                break
            path, i = [], sink
            while i != s:
                path.append(via[i])
                i = to[via[i] ^ 1]
            flow = min(left[s], -left[sink], *(room[e] for e in path))
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
            left[s] -= flow
            left[sink] += flow
    return content


def _capacity(x: float) -> float:
    """-log of the logistic of -x: what calling it wrong costs."""
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def label(blocks: list[Block], odds: np.ndarray, near: float = 0.5, siblings: float = 1.0, alike: float = 1.0, scale: int = 1000) -> list[bool]:
    """Which blocks are content, by the minimum cut; odds: log odds of each. near joins neighbours, by their distance in the tree; siblings those
    of one parent, by the blocks between them, and alike is added where their elements are of one name."""
    gain, links, last = [], [], {}
    for i, b in enumerate(blocks):
        x = float(max(-12.0, min(12.0, odds[i])))
        gain.append(round(scale * (_capacity(x) - _capacity(-x))))
        e = b.element
        if i:
            p, q, steps = e, blocks[i - 1].element, 0
            while p is not q and steps < 6:
                if p.depth >= q.depth:
                    p = p.parent
                else:
                    q = q.parent
                steps += 1
            links.append((i - 1, i, round(scale * near / (1 + steps))))
        if not b.advert:
            parent = e.parent.key if e.parent else -1
            if parent in last:
                j = last[parent]
                links.append((j, i, round(scale * (siblings + alike * (blocks[j].element.name == e.name)) / math.sqrt(i - j))))
            last[parent] = i
    return minimum_cut(gain, links)


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return ""
    odds = features(blocks, elements) @ (classifier() if weights is None else weights)
    lines: dict[int, list[str]] = {}
    if len(elements) == 1:
        return "\n\n".join(b.text for b in blocks)
    for b, keep in zip(blocks, label(blocks, odds)):
        if keep:
            lines.setdefault(b.line, []).append(b.raw)
    return "\n\n".join(" ".join("".join(parts).split()) for parts in lines.values())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html). No exchange."""
    weights = pages.sparkSession.sparkContext.broadcast(classifier())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, urls), texts in rows_in_blocks(batches):
            found = [main_text(t, weights.value) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
