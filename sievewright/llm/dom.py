"""A small HTML reader: blocks of text, the tree of block elements and features of its nodes."""

from __future__ import annotations

import html
import re

import numpy as np

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is no markup, with what ends it.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
#: Elements that are taken out with all that lies in them once their end tag comes; one that is never ended holds nothing.
DROPPED = frozenset("svg object select template noscript".split())
#: The same, but ended by whatever ends them.
_CHOICES = frozenset(("option", "optgroup"))
#: "/" at the end of a tag, if it is not the last letter of a bare value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$|(?:^|\s)[^\s=\"']+/$")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
#: Elements that a new one of the key closes, up to the nearest of the second set.
_BLOCKS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role attributes, by what they tell.
HINTS = {
    "main": "article content main post entry story body text copy page prose read reader blog news maincontent articlebody",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pager pagination toc tabs topnav subnav skip links sitemap categories",
    "head": "header masthead banner logo topbar branding hero top site head",
    "foot": "footer copyright legal bottom imprint colophon credits foot contentinfo",
    "side": "sidebar aside widget related recommend recommended recommendations trending popular side rail complementary secondary teaser teasers latest more",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay banner subscribe newsletter paywall message warning toast disclaimer notification privacy info announcement",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense adsbygoogle commercial partner affiliate billboard outbrain taboola",
    "form": "form login signin signup register search input contact poll survey subscription feedback",
    "comment": "comment comments reply replies discuss discussion disqus respond response responses thread reader guestbook commentlist reviews",
    "share": "share sharing social follow tag tags like likes tools toolbar buttons rating",
    "meta": "byline author meta date time published updated bio",
}
HINT_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        HINT_OF.setdefault(_w, []).append(_k)
TAGS = "p h1 h2 ul li div section article main nav header footer aside form table td blockquote pre figure span a button dl body ol fieldset".split()
TAG_OF = {t: i for i, t in enumerate(TAGS)}
TAG_OF |= {"h3": TAG_OF["h2"], "h4": TAG_OF["h2"], "h5": TAG_OF["h2"], "h6": TAG_OF["h2"], "th": TAG_OF["td"], "dialog": TAG_OF["aside"], "menu": TAG_OF["nav"], "legend": TAG_OF["fieldset"], "figcaption": TAG_OF["figure"]}


class Page:
    """Nodes in document order (0 is the root) and text runs: the node of each, its text, whether it stands in a link, and the block it belongs to."""

    def __init__(self, source: str, marked: bool = False):
        """``marked``: the page is one of our own, whose data-y attributes say what is article."""
        self.tag, self.parent, self.depth, self.hint, self.truth, self.index = ["#root"], [-1], [0], [()], [None], [0]
        self.children = [0]
        self.run_node: list[int] = []
        self.run_text: list[str] = []
        self.run_link: list[bool] = []
        self.run_block: list[int] = []
        self._block, self._links, self._head, self._marked, self._svgs = 0, 0, False, marked, 0
        self._stack: list[tuple] = [(0, "#root", None)]
        self._at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
        self._solid: list[int] = [0]  # and of all that are not inline
        at = 0
        while m := _MARKUP.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag, attrs = (m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
            if not tag:
                continue
            if m["end"] or m["end2"]:
                self._close(tag)
            elif (self._svgs or tag == "svg") and _CLOSED.search(attrs):
                continue
            elif tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(tag, attrs)
        if at < len(source):
            self._text(source[at:])
        self._pop_to(1)

    def _text(self, raw: str) -> None:
        if self._head and not raw.strip():
            return
        if self._head:
            self._close("head")
        self.run_node.append(self._stack[-1][0])
        self.run_text.append(html.unescape(raw) if "&" in raw else raw)
        self.run_link.append(self._links > 0)
        self.run_block.append(self._block)

    def _pop_to(self, k: int) -> None:
        while len(self._stack) > k:
            _, tag, before = self._stack.pop()
            self._at[tag].pop()
            if tag not in INLINE:
                self._solid.pop()
            if tag == "a":
                self._links -= 1
            if tag == "svg":
                self._svgs -= 1
            if tag not in INLINE and tag not in DROPPED:
                self._block += 1
            if tag in _CHOICES:
                self._forget(before)

    def _forget(self, before: tuple) -> None:
        """Takes out all nodes and runs since ``before``."""
        nodes, runs, self._block, self._head = before
        if len(self.tag) > nodes:
            self.children[self.parent[nodes]] -= 1
        for x in (self.tag, self.parent, self.depth, self.hint, self.truth, self.index, self.children):
            del x[nodes:]
        for x in (self.run_node, self.run_text, self.run_link, self.run_block):
            del x[runs:]

    def _close(self, tag: str) -> None:
        if tag == "head":
            self._head = False
        if tag in ("html", "body", "br"):
            return
        k = self._last((tag,))
        if not k or (tag in INLINE and self._solid[-1] > k) or (tag == "p" and self._last(DROPPED) > k):
            return
        before = self._stack[k][2]
        self._pop_to(k)
        if tag in DROPPED:
            self._forget(before)

    def _last(self, tags) -> int:
        """Place in the stack of the innermost open element of some tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "head":
            self._head = True
            return
        if tag in ("html", "meta", "link", "base"):
            return
        if self._head and tag not in DROPPED:
            self._head = False
        if tag in VOID:
            if tag in ("br", "hr"):
                self._block += 1
            if tag == "hr":
                self._end_p()
            return
        if tag in _BLOCKS:
            self._end_svg()
            self._end_choice()
            self._end_p()
        if tag in CLOSES:
            what, until = CLOSES[tag]
            k = self._last(what)
            if k > max(self._last(until), self._last(DROPPED)):
                self._pop_to(k)
        hint, truth = [], None
        if attrs and "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                if name.lower() == "data-y":
                    truth = int(value) if self._marked else None
                else:
                    hint += [h for w in _TOKENS.findall(value) for h in HINT_OF.get(w.lower(), ())]
        before = (len(self.tag), len(self.run_node), self._block, self._head)
        inline = tag in INLINE
        if not inline and tag not in DROPPED and tag not in _CHOICES:
            self._block += 1
        if tag == "a":
            self._links += 1
        if tag == "svg":
            self._svgs += 1
        node = self._stack[-1][0]
        if not inline or hint or truth is not None:
            up = node
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.hint.append(tuple(hint))
            self.truth.append(truth if truth is not None else self.truth[up])
            self.index.append(self.children[up])
            self.children[up] += 1
            self.children.append(0)
        self._at.setdefault(tag, []).append(len(self._stack))
        if not inline:
            self._solid.append(len(self._stack))
        self._stack.append((node, tag, before if tag in DROPPED or tag in _CHOICES else None))

    def _end_svg(self) -> None:
        """A block of HTML ends a drawing that was left open."""
        k = self._last(("svg",))
        if k > self._last(("foreignobject", "desc")):
            self._pop_to(k)

    def _end_choice(self) -> None:
        while (k := self._last(_CHOICES)) and self._solid[-1] <= k:
            self._pop_to(k)

    def _end_p(self) -> None:
        k = self._last(("p",))
        if k and self._solid[-1] <= k:
            self._pop_to(k)

    def text(self, chosen: np.ndarray) -> str:
        """Text of the chosen nodes: white space inside a block becomes one blank, blocks are joined by one blank."""
        out, block, part = [], None, []
        for node, text, b in zip(self.run_node, self.run_text, self.run_block):
            if chosen[node]:
                if b != block:
                    out.append("".join(part))
                    part, block = [], b
                part.append(text)
            elif part:
                out.append("".join(part))
                part, block = [], None
        out.append("".join(part))
        return " ".join(x for x in (_SPACE.sub(" ", p).strip() for p in out) if x)

    def features(self) -> np.ndarray:
        """A row of numbers for every node: sizes and densities of its subtree, place among its siblings, hints of its own and of what it lies in."""
        n = len(self.tag)
        own, link, punct, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, linked in zip(self.run_node, self.run_text, self.run_link):
            size = len(text.strip())
            if size:
                own[node] += size
                runs[node] += 1
                punct[node] += text.count(",") + text.count(".")
                if linked:
                    link[node] += size
        parent, tags = np.array(self.parent), np.array([TAG_OF.get(t, len(TAGS)) for t in self.tag])
        sums = np.stack([own, link, punct, runs, np.ones(n), tags == TAG_OF["p"], tags == TAG_OF["li"]], 1)
        direct = own.copy()
        for i in range(n - 1, 0, -1):
            sums[parent[i]] += sums[i]
        hints, within = np.zeros((n, len(HINTS))), np.zeros((n, len(HINTS)))
        boiler = [TAG_OF[t] for t in ("nav", "header", "footer", "aside", "form")]
        inside = np.zeros((n, 2))
        for i in range(1, n):
            for h in self.hint[i]:
                hints[i, h] = 1
            p = parent[i]
            within[i] = np.maximum(within[p], hints[p])
            inside[i, 0] = max(inside[p, 0], tags[p] in boiler)
            inside[i, 1] = max(inside[p, 1], self.tag[p] in ("article", "main"))
        size, up = sums[:, 0], sums[np.maximum(parent, 0)]
        kids = np.array(self.children)[np.maximum(parent, 0)]
        place = np.array(self.index) / np.maximum(kids - 1, 1)
        numbers = [np.log1p(size), np.log1p(direct), sums[:, 1] / np.maximum(size, 1), sums[:, 2] / np.maximum(size, 1) * 100, size / np.maximum(sums[:, 3], 1), sums[:, 4] / np.maximum(size, 1) * 100]
        numbers += [np.log1p(sums[:, 5]), np.log1p(sums[:, 6]), np.array(self.depth), place, kids, size / np.maximum(up[:, 0], 1), size / max(size[0], 1), np.array(self.children)]
        return np.c_[np.stack(numbers, 1), hints, within, inside, tags[:, None] == np.arange(len(TAGS))]
