"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A tolerant parser builds the tree of block elements; runs of text between block boundaries are its leaves. Each
node gets features: its tag and attribute tokens and those of its ancestors, depth, sibling statistics, and the density of
text, links, punctuation and elements in its subtree. The trees give the probability that a node holds main text.

Decoding maximises the likelihood of all nodes' labels under one rule: below a node without main text there is none, and a node
with main text has a child that holds it. So an ancestor and its descendants never contradict each other.

The trees are fitted on pages that are generated here, with layouts, attribute names, languages and
damage drawn at random, and whose main text is therefore known.

Text: character references decoded, white space inside a block as one space, trimmed, blocks joined in page order by \\n. Scripts,
styles and other elements without visible text never count, nor what is inside hidden elements.

Defined cases: a null page and a page without text have the empty text; damaged markup, stray and missing end tags are read as browsers do,
roughly: a quote counts only after =, an unfinished tag at the end of the page is no text; pages of any length are read whole, in one
pass, and features cover whole runs; of labellings that are as likely, the one with less text wins; repeated rows, and rows with a null or repeated
page_id, are handled row by row; an empty table gives an empty table; extra columns stay out of the way.
"""

from __future__ import annotations

import html
import math
import random
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundforge.llm import gbt
from roundforge.llm.common import as_text, map_texts

#: Fixed values of the HTML standard, as far as they matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg head title textarea select option canvas audio video map datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext nobr object q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var br img wbr input picture source".split())
CLOSED_BY_BLOCK = "p"
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

#: A start tag: its name and attributes. Possessive, so a tag is read once; a quote that is never closed is a character like any other.
_START = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_END = re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_NAME = re.compile(r"/?[A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s=>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
_SPLIT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Attribute tokens by what they hint at.
HINTS = {
    "main": "article content post entry story body main text prose blog news hentry page document markdown readable".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs topbar links".split(),
    "frame": "header masthead footer foot bottom copyright legal banner logo top site".split(),
    "side": "sidebar side aside widget rail related recommended recommendations popular trending more teaser secondary complementary".split(),
    "ad": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted dfp outbrain taboola banner".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay warning announcement disclaimer message toast dialog".split(),
    "form": "form login signup subscribe subscription newsletter search contact register input".split(),
    "comment": "comment comments reply replies disqus respond discussion feedback review reviews commentlist thread".split(),
    "share": "share sharing social follow like tweet facebook tags tag byline meta author date rating print".split(),
}
TAG_GROUPS = [["article"], ["main"], ["section"], ["div"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["li", "dd", "dt"], ["ul", "ol", "dl", "menu"], ["table", "tbody", "thead", "tr", "td", "th"], ["nav"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "button"], ["blockquote", "pre", "figure", "figcaption"], ["#run"], ["body", "html", "#root"]]
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_HINT = {w: i for i, ws in enumerate(HINTS.values()) for w in ws}
WORDS = ["copyright", "©", "rights reserved", "cookie", "subscribe", "sign up", "log in", "advertisement", "sponsored", "newsletter", "reply", "comment", "share", "privacy"]


class Node:
    __slots__ = ("tag", "hints", "parent", "children", "runs", "text", "link", "elements", "order")

    def __init__(self, tag: str, hints: frozenset[int], parent: Node | None) -> None:
        self.tag, self.hints, self.parent, self.children = tag, hints, parent, []
        self.text, self.link, self.elements = "", 0, 0


def _hints(attributes: str) -> tuple[frozenset[int], bool]:
    """Hint groups of the attribute tokens, and whether the element is hidden."""
    found, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for w in _SPLIT.findall(_CAMEL.sub(" ", value).lower()):
                if w in _HINT:
                    found.add(_HINT[w])
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return frozenset(found), hidden


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """The parts of a page, in one pass: kind, name or text, attributes, and the place behind. Kinds: text, start, end.

    The caller may send the place at which to go on."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], "", end
            return
        mark = page[lt + 1 : lt + 2]
        if not (mark in ("!", "?", "/") or mark.isascii() and mark.isalpha()):
            yield "text", page[at : lt + 1], "", lt + 1  # no tag
            at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], "", lt
        if _NAME.match(page, lt + 1):
            m = (_END if mark == "/" else _START).match(page, lt)
            if m is None:
                return  # an unfinished tag takes the rest
            at = m.end()
            to = yield ("end" if mark == "/" else "start"), m[1].lower(), "" if mark == "/" else m[2], at
            at = to or at
        elif page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
        else:
            close = page.find(">", lt)
            at = end if close < 0 else close + 1


class Open:
    """The open elements, outermost first, and where each tag and the block elements stand among them, so that none is looked for."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, Node | None, bool]] = []  # tag, node (None for inline ones), whether it is hidden
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost element of these tags, or -1."""
        most = -1
        for t in tags:
            at = self.places[t]
            if at and at[-1] > most:
                most = at[-1]
        return most


def parse(page: str) -> Node:
    """The tree of block elements with runs of text as leaves. Hidden elements are read like any other and then left out."""
    root = Node("#root", frozenset(), None)
    stack = Open()
    elements, places, blocks = stack.elements, stack.places, stack.blocks
    block, pieces, link, links, muted = root, [], 0, 0, 0
    no_hint: frozenset[int] = frozenset()

    def flush() -> None:
        nonlocal pieces, link
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                run = Node("#run", no_hint, block)
                run.text, run.link = text, link
                block.children.append(run)
        pieces, link = [], 0

    def pop_to(size: int) -> None:
        """Closes the open elements from number ``size`` on."""
        nonlocal block, links, muted
        while len(elements) > size:
            tag, node, hidden = elements.pop()
            places[tag].pop()
            muted -= hidden
            if node is not None:
                blocks.pop()
                flush()
                block = node.parent
                if hidden:
                    block.children.pop()
            elif tag == "a":
                links = max(0, links - 1)

    parts = tokens(page)
    part = next(parts, None)
    while part is not None:
        kind, tag, attributes, at = part
        go_on = None
        if kind == "text":
            if not muted:
                pieces.append(tag)
                if links:
                    link += len(tag.strip())
        elif kind == "end":
            at_tag = places[tag]
            if not at_tag:
                if tag == "p" or tag not in INLINE:
                    flush()
            elif not (tag in INLINE and blocks and blocks[-1] > at_tag[-1]):  # an end tag of an inline element doesn't close blocks
                pop_to(at_tag[-1])
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not muted:
                pieces.append(" ")
            block.elements += 1
        elif tag in RAW:
            if tag not in INLINE:
                flush()
            block.elements += 1
            go_on = _behind(page, at, tag)
        elif tag == "head":
            flush()  # what it holds is hidden itself
        else:
            closed = attributes.rstrip().endswith("/") and tag not in INLINE
            hints, hidden = _hints(attributes) if attributes.strip() else (no_hint, False)
            hidden |= tag in HIDDEN
            if tag in INLINE:
                places[tag].append(len(elements))
                elements.append((tag, None, hidden))
                muted += hidden
                links += tag == "a"
                block.elements += 1
            else:
                open_block(stack, tag, pop_to)
                if not (tag in ("html", "body") and places[tag]):
                    flush()
                    if hidden:
                        block.elements += 1
                    if not closed:
                        node = Node(tag, hints, block)
                        block.children.append(node)
                        places[tag].append(len(elements))
                        blocks.append(len(elements))
                        elements.append((tag, node, hidden))
                        muted += hidden
                        block = node
        try:
            part = next(parts, None) if go_on is None else parts.send(go_on)
        except StopIteration:
            part = None
    pop_to(0)
    flush()
    return root


#: Of SELF_CLOSING: the tags that a start tag closes, and those within which it looks for them, without the former.
_CLOSES = {tag: (tuple(sorted(like)), tuple(sorted(scope - like))) for tag, (like, scope) in SELF_CLOSING.items()}


def open_block(stack: Open, tag: str, pop_to: Callable[[int], None]) -> None:
    """Closes the elements that the start tag of a block element ends."""
    if tag in _CLOSES:
        like, scope = _CLOSES[tag]
        while (k := stack.last(like)) > stack.last(scope):
            pop_to(k)
            if tag not in ("tr", "tbody"):
                break
    p = stack.places[CLOSED_BY_BLOCK]
    if p and not (stack.blocks and stack.blocks[-1] > p[-1]):
        pop_to(p[-1])


@lru_cache(maxsize=64)
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)


def _behind(page: str, at: int, tag: str) -> int:
    """The place behind the end tag of an element whose content is no markup; without one it takes the rest."""
    m = _closer(tag).search(page, at)
    return m.end() if m else len(page)


def flat(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.order = len(out)
        out.append(n)
        todo.extend(reversed(n.children))
    return out


N_HINTS = len(HINTS)
AGAINST = ("nav", "footer", "aside", "form", "button")
MANY = 12  # counts of brothers, runs and paragraphs tell no more beyond it


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    chars, link, words, marks, digits, upper, elements, runs, paragraphs, size = (np.zeros(n) for _ in range(10))
    for i, x in enumerate(nodes):
        elements[i] = x.elements + 1
        size[i] = 1
        if x.tag == "#run":
            t = x.text
            chars[i], link[i], words[i], runs[i] = len(t), x.link, t.count(" ") + 1, 1
            marks[i] = sum(map(t.count, ".,;:!?"))
            digits[i] = sum(map(t.count, "0123456789"))
            upper[i] = sum(1 for w in t.split() if w[0].isupper())
        elif x.tag == "p":
            paragraphs[i] = 1
    own = chars.copy()
    parent = np.array([x.parent.order if x.parent is not None else -1 for x in nodes])
    stats = np.stack([chars, link, words, marks, digits, upper, elements, runs, paragraphs, size], 1)
    for i in range(n - 1, 0, -1):
        stats[parent[i]] += stats[i]
    total = max(1.0, stats[0, 0])
    before = np.concatenate([[0], np.cumsum(own)[:-1]]) / total
    k = len(TAG_GROUPS)
    depth, more = np.zeros(n), np.zeros((n, 9))
    closest, against = np.zeros(n), np.zeros(n)  # the closest hint for or against main text; hints against it, all told
    tag, above, hint, hint_above = (np.zeros(n, np.int64) for _ in range(4))
    brothers: dict[int, tuple[float, float, dict[str, int]]] = {}
    for i, x in enumerate(nodes):
        if x.tag in _GROUP:
            tag[i] = 1 << _GROUP[x.tag]
        for h in x.hints:
            hint[i] |= 1 << h
        bad = bool(x.hints - {0}) or x.tag in AGAINST
        good = 0 in x.hints or x.tag in ("article", "main")
        closest[i] = -1.0 if bad and not good else 1.0 if good and not bad else 0.0
        against[i] = bad
        said = 0
        if x.tag == "#run":
            low = x.text.lower()
            said = sum(1 for w in WORDS if w in low) / max(1.0, words[i] / 12)
        if i:
            p = parent[i]
            depth[i], above[i], hint_above[i] = depth[p] + 1, above[p] | tag[p], hint_above[p] | hint[p]
            closest[i] = closest[i] or closest[p]
            against[i] += against[p]
            if p not in brothers:
                alike: dict[str, int] = {}
                for b in x.parent.children:
                    alike[b.tag] = alike.get(b.tag, 0) + 1
                many = len(x.parent.children)
                brothers[p] = many, stats[p, 0] / many, alike
            many, mean, alike = brothers[p]
            all_, all_link = stats[p, 0], stats[p, 1]
            more[i] = said, math.log1p(all_), all_link / max(1.0, all_), stats[i, 0] / max(1.0, all_), mean, min(alike[x.tag], MANY), min(many, MANY), closest[i], against[i]
    bits = lambda masks, width: (masks[:, None] >> np.arange(width)) & 1
    c, w = np.maximum(1, stats[:, 0]), np.maximum(1, stats[:, 2])
    dense = [depth, np.log1p(stats[:, 0]), stats[:, 1] / c, stats[:, 3] / w, stats[:, 4] / c, stats[:, 5] / w, stats[:, 0] / np.maximum(1, stats[:, 6]), stats[:, 0] / np.maximum(1, stats[:, 7])]
    dense += [stats[:, 8] / np.maximum(1, stats[:, 9]), np.log1p(stats[:, 9]), stats[:, 0] / total, before, np.log1p(stats[:, 6]), np.minimum(stats[:, 7], MANY), np.minimum(stats[:, 8], MANY), np.full(n, math.log(total)), stats[:, 0] / np.maximum(1, stats[:, 9])]
    return np.concatenate([bits(tag, k), bits(above, k), bits(hint, N_HINTS), bits(hint_above, N_HINTS), np.stack(dense, 1), more], 1)


def decode(nodes: list[Node], p: np.ndarray) -> list[str]:
    """The text runs that are kept, in page order."""
    n = len(nodes)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log1p(-p)
    best = np.zeros(n)  # of the node as main text, with the best labels below
    none = drop.copy()  # of the whole subtree without
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#run":
            best[i] = keep[i]
            continue
        gain, total, inner = -math.inf, 0.0, drop[i]
        for c in x.children:
            j = c.order
            total += max(best[j], none[j])
            gain = max(gain, best[j] - max(best[j], none[j]))
            inner += none[j]
        best[i] = keep[i] + total + gain if x.children else -math.inf  # at least one child holds main text
        none[i] = inner
    out, todo = [], [nodes[0]] if best[0] > none[0] else []
    while todo:
        x = todo.pop()
        if x.tag == "#run":
            out.append(x.text)
            continue
        chosen = [c for c in x.children if best[c.order] > none[c.order]]
        if not chosen:
            chosen = [max(x.children, key=lambda c: best[c.order] - none[c.order])]
        todo.extend(reversed(chosen))
    return out


# --- training pages ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Training:
    """pages: generated pages to fit on, a bound on the classifier's sample."""

    pages: int = 300
    seed: int = 5
    trees: int = 40
    depth: int = 4


class _Page:
    """One random page. Main text is marked by the attribute data-m, which is no feature."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.syllables = rng.choice(["th er on an re he in ed nd ha at en es or ti st ar le", "é ou que le eau oi an tion ent re la ai è ch", "ung ch ein er der ge st ie ver ü ä au tz en", "ción os ar que la ado es ñ rr mente as el do í"]).split()
        self.noise = rng.choice(["", "", "", "***", "!!", "$$$", " |"])

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def sentence(self, lo: int = 1, hi: int = 14) -> str:
        return (" ".join(self.word() + (self.noise if self.r.random() < 0.8 else "") + ("," if self.r.random() < 0.1 else "") for _ in range(self.r.randint(lo, hi)))).capitalize() + "."

    def heading(self, lo: int = 1, hi: int = 9) -> str:
        """Without a full stop, mostly; at times cut off or a word again and again."""
        r = self.r
        if r.random() < 0.15:
            return " ".join([self.word().capitalize()] * r.randint(1, 9))
        text = self.sentence(lo, hi)
        return text if r.random() < 0.3 else text.rstrip(".")

    def prose(self, lo: int = 1, hi: int = 7) -> str:
        if self.r.random() < 0.06:
            return " ".join([self.word()] * self.r.randint(1, 60))
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def name(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        words = HINTS[kind]
        w = r.choice(words[: max(3, len(words) * 2 // 3)]) if r.random() < 0.97 else self.word()
        w = r.choice([w, w, f"{w}-{self.word()}", f"{self.word()}-{w}", f"{w}{r.randint(1, 9)}", f"site-{w}", f"{w}-container", f"{w} {self.word()}"])
        return f' {r.choice(["class", "class", "id"])}="{w}"'

    def links(self, n: int) -> str:
        r = self.r
        item = r.choice(["<li><a href='#'>{}</a></li>", "<a href='/x'>{}</a> ", "<li><a href=/y>{}</a>", "<p><a href='#'>{}</a></p>"])
        body = "".join(item.format(" ".join(self.word() for _ in range(r.randint(1, 4)))) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def paragraphs(self) -> str:
        r, out = self.r, []
        # without damage an article may be one short paragraph
        for i in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 40])):
            k = r.random()
            text = self.prose(1, r.choice([1, 2, 7]))
            if k < 0.72:
                if r.random() < 0.15:
                    text = text.replace(" ", f" <a href='#'>{self.word()}</a> ", 1)
                out.append(r.choice(["<p data-m>{}</p>", "<p data-m>{}</p>", "<p data-m>{}", "<p data-m><b>{}<br>", "<p data-m><span>{}</span></p>"]).format(text))
            elif k < 0.8:
                out.append(f"<h{r.randint(2, 4)} data-m>{self.heading(1, 5)}</h2>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li data-m>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote data-m>{self.prose(1, 3)}</blockquote>")
            elif k < 0.95:
                out.append(f"<pre data-m>{self.prose(1, 3)}</pre>")
            elif k < 0.97:
                out.append("<table>" + "".join(f"<tr><td data-m>{self.word()}</td><td data-m>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div data-m>{text}</div>")
            if r.random() < 0.08:
                out.append(self.clutter(r.choice(["ad", "share", "notice", "form", "side"])))
        return "".join(out)

    def clutter(self, kind: str) -> str:
        r = self.r
        tag = {"menu": ["nav", "nav", "div", "ul"], "frame": ["header", "footer", "footer", "div"], "side": ["aside", "div", "section"], "comment": ["section", "div", "ol"], "form": ["form", "div"]}.get(kind, ["div", "div", "aside", "section", "p"])
        tag = r.choice(tag)
        name = self.name(kind)
        if tag in ("div", "section", "ul", "ol", "p") and not name:
            name = f' class="{r.choice(HINTS[kind][:5])}"'
        said = {"frame": f"© {r.randint(1999, 2026)} {self.sentence(1, 4)}", "notice": "We use cookies. " + self.sentence(), "form": "<label>E-mail</label><input name=e><button>OK</button>", "share": "Share this " + self.links(3), "ad": "Advertisement"}.get(kind, "")
        k = r.random()
        if kind == "comment":
            tag = tag.replace("p", "div")
            body = "".join(f"<{t}><b>{self.word()}</b> {self.prose(1, 3)}</{t}>" for t in [r.choice(["li", "div class='comment'", "p"])] for _ in range(r.randint(1, 6)))
            body = r.choice(["<h3>Comments</h3>", f"<h3>{self.word()}</h3>", ""]) + re.sub(r"</(\w+) [^>]*>", r"</\1>", body)
        elif kind == "menu" or k < 0.25:
            body = self.links(r.randint(2, 9))
        elif k < 0.5 and said:
            body = said
        else:
            body = r.choice(["{}"] if tag == "p" else ["{}", "{}", "<p>{}</p>", "<h4>{}</h4>"]).format(self.prose(1, 3)) + (said if k > 0.85 else "")
        return f"<{tag}{name}>{body}</{tag}>"

    def build(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td", ""])
        name = self.name("main")
        if tag in ("div", "section") and not name:
            name = f' class="{r.choice(HINTS["main"][:7])}"'
        title = r.choice([f"<h1 data-m>{self.heading()}</h1>"] * 4 + [""])
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = title + (f"<p class='byline'>{self.sentence(1, 4)}</p>" if r.random() < 0.08 else "") + self.paragraphs()
        if "data-m" not in inner:
            inner += f"<p data-m>{self.prose(1, 2)}</p>"
        core = f"<{tag}{name}>{inner}</{tag}>" if tag else inner
        if tag == "td":
            core = f"<table><tr><td>{self.links(3)}</td>{core}</tr></table>"
        before = [self.clutter(k) for k in ("menu", "frame", "notice", "ad") if r.random() < 0.45]
        after = [self.clutter(k) for k in ("side", "comment", "frame", "share", "form", "ad", "menu", "notice") if r.random() < 0.35]
        r.shuffle(before)
        wrap = r.choice(["", "", "div", "div", "main"])
        if wrap:
            k = r.randint(0, len(after))
            core = f"<{wrap}{self.name('main') if r.random() < 0.5 else ''}>{core}{''.join(after[:k])}</{wrap}>"
            after = after[k:]
        head = f"<head><title>{self.word()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body{self.name('frame') if r.random() < 0.1 else ''}>{''.join(before)}<!-- x -->{core}{''.join(after)}</body></html>"


def training_rows(training: Training) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(training.seed)
    xs, ys = [], []
    for _ in range(training.pages):
        marked = _Page(rng).build()
        # the mark is turned into a character of the text, which shows which runs are main text
        nodes = flat(parse(re.sub(r" data-m((?: [^>]*)?>)", "\\1\ue000", marked)))
        y = np.zeros(len(nodes))
        for x in reversed(nodes):
            if x.tag == "#run":
                if "\ue000" in x.text:
                    y[x.order] = 1
                    x.text = x.text.replace("\ue000", "").strip()
            elif any(y[c.order] for c in x.children):
                y[x.order] = 1
        xs.append(features(nodes))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


@dataclass(frozen=True)
class Model:
    boosted: gbt.Boosted = field(repr=False)
    key: str = ""


@lru_cache(maxsize=4)
def fit(training: Training = Training()) -> Model:
    """Fitted on the driver, from generated pages alone, once for each ``training``."""
    x, y = training_rows(training)
    return Model(gbt.fit(x, y, training.trees, training.depth, bins=32, min_hessian=4.0), uuid.uuid4().hex)


def extract_pages(pages: list[str], model: Model) -> list[str]:
    trees = [flat(parse(p)) for p in pages]
    if not trees:
        return []
    p = model.boosted.probability(np.concatenate([features(t) for t in trees]))
    ends = np.cumsum([len(t) for t in trees])
    return ["\n".join(decode(t, p[e - len(t) : e])) for t, e in zip(trees, ends, strict=True)]


def extract(pages: DataFrame, model: Model, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (page_id, url) with text and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: list[str]) -> dict[str, list]:
        texts = extract_pages(batch, sent.value)
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages.select(*(keep or ["page_id", "url"]), as_text(column).alias("_text")), run, "text string, n_chars long")
