"""HTML to a tree of block elements, their texts, and features of each node.

Inline elements are part of the block they stand in. Texts that stand in a container (a div, say)
are leaf nodes of their own, tagged ``#text``. What no reader sees (head, scripts, styles, form
controls, comments) has no text.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: Comments, declarations, and tags. No alternative looks at a character twice, except that a quote which
#: is never closed is searched for once; then it is a plain character, and its tag ends at the next ``>``.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe textarea select button object math audio video canvas title datalist".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img input wbr area nobr".split())
CONTAINERS = frozenset("html body div main section article aside nav header footer form fieldset ul ol dl table tbody thead tr figure center details".split())
#: Elements that a start tag of the key closes, if they are open within the nearest of ``_SCOPE``.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
_SCOPE = frozenset("html body table ul ol dl article section div main aside nav header footer form blockquote".split())

TAG_GROUPS = ["nav", "aside", "header", "footer", "form", "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr td th", "#text", "blockquote pre figure figcaption"]
TOKEN_GROUPS = [
    "ad ads adv advert advertisement sponsor sponsored promo promotion dfp adsense banner",
    "nav navigation menu navbar breadcrumb breadcrumbs toc pager pagination",
    "foot footer copyright legal colophon",
    "head header masthead brand logo topbar",
    "side sidebar widget related recent popular rail aside recommended more teaser",
    "comment comments reply replies respond discussion disqus commentlist",
    "notice cookie cookies consent gdpr alert popup modal overlay message warning",
    "share sharing social follow tweet",
    "login search subscribe newsletter signup form contact",
    "content article post entry story main body text",
    "title headline",
    "meta byline author date tags tag caption credits",
]
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_WORD = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_N_TAGS, _N_WORDS = len(TAG_GROUPS), len(TOKEN_GROUPS)
NUMBERS = ["depth", "children", "text", "own_text", "link_share", "words_a_block", "density", "sentence_share", "page_share", "start", "sibling_index", "siblings_alike", "paragraphs", "items", "links", "headings", "after_h1", "parent_share", "sibling_text"]
FEATURES = [*(f"tag:{g}" for g in TAG_GROUPS), *(f"in:{g}" for g in TAG_GROUPS[:8]), *(f"word:{g.split()[0]}" for g in TOKEN_GROUPS), *(f"in_word:{g.split()[0]}" for g in TOKEN_GROUPS), *NUMBERS]


class Page:
    """Nodes in page order (a parent before its children), and blocks of text: (node, pieces)."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.words: list[frozenset] = []
        self.label: list[str] = []
        self.blocks: list[tuple[int, list[str]]] = []
        self.link_chars: list[int] = []
        self.n_links: list[int] = []
        self._parse(html)

    def _node(self, tag: str, parent: int, attributes: str = "") -> int:
        words, label = frozenset(), ""
        if "=" in attributes:
            found = [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)]
            label = next((v for k, v in found if k == "data-label"), "")
            words = frozenset(_WORD[w] for k, v in found if k != "data-label" for w in map(str.lower, _PARTS.findall(v)) if w in _WORD)
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.label.append(label)
        self.link_chars.append(0)
        self.n_links.append(0)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, links, block, at, n = [self._node("html", -1)], 0, None, 0, len(html)
        names = ["html"]
        places: dict[str, list[int]] = {}  # of each open name but the first, where it stands in the stack
        scopes = [0]
        unclosed: set[str] = set()  # names whose end tag is known not to follow

        def cut(k: int) -> None:
            for name in names[k:]:
                places[name].pop()
                if name in _SCOPE:
                    scopes.pop()
            del names[k:], stack[k:]

        def close(closed: tuple) -> None:
            k = max((places[c][-1] for c in closed if places.get(c)), default=0)
            if k > scopes[-1]:
                cut(k)

        while at <= n:
            m = _TOKEN.search(html, at) if at < n else None
            end = m.start() if m else n
            if end > at:
                text = unescape(html[at:end])
                if block is None and not text.isspace():
                    node = stack[-1]
                    if names[-1] in CONTAINERS:
                        node = self._node("#text", node)
                    block = (node, [])
                    self.blocks.append(block)
                if block is not None:
                    block[1].append(text)
                    if links:
                        self.link_chars[block[0]] += len(text.strip())
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if not m[1]:
                if name in UNSEEN or name == "head":
                    if name not in unclosed and (m[3][-1:] != "/" or name == "head"):
                        to = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
                        if to is None:
                            unclosed.add(name)
                        at = to.end() if to else (n if name != "head" else at)
                    continue
                if name == "br" or name == "hr":
                    block = None
                    continue
                if name == "a":
                    links += 1
                    self.n_links[stack[-1]] += 1
                    continue
                if name in INLINE or name in VOID:
                    continue
                if name in ("html", "body") and name in places or name == "html":
                    continue
                block = None
                if name in _ENDS_P:
                    close(("p",))
                if name in _CLOSES:
                    close(_CLOSES[name])
                links = 0 if name in _ENDS_P else links
                places.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(self._node(name, stack[-1], m[3]))
                names.append(name)
            elif name == "a":
                links = max(0, links - 1)
            elif name not in INLINE and name not in ("html", "body"):
                block = None
                if places.get(name):
                    cut(places[name][-1])

    def texts(self, kept) -> list[str]:
        """Blocks of kept nodes, white space inside made one space; none is empty."""
        return [t for node, pieces in self.blocks if kept[node] and (t := " ".join("".join(pieces).split()))]

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, words, sentences, blocks, start = (np.zeros(n) for _ in range(5))
        at = 0
        for node, pieces in self.blocks:
            t = "".join(pieces)
            size = len(t.strip())
            start[node] = start[node] or at
            own[node] += size
            words[node] += t.count(" ") + 1
            sentences[node] += t.count(". ") + t.rstrip().endswith((".", "!", "?", "…"))
            blocks[node] += 1
            at += size
        whole = max(1, at)
        depth, tags, kids, items, paragraphs, headings = (np.zeros(n) for _ in range(6))
        out = np.zeros((n, len(FEATURES)), np.float32)
        parent, group = self.parent, [_TAG.get(t, -1) for t in self.tag]
        o_in, o_word, o_up, o_num = _N_TAGS, _N_TAGS + 8, _N_TAGS + 8 + _N_WORDS, _N_TAGS + 8 + 2 * _N_WORDS
        index, alike, after, h1 = np.zeros(n), np.zeros(n), np.zeros(n), 0
        same: dict = {}
        for i in range(n):
            p, g = parent[i], group[i]
            if g >= 0:
                out[i, g] = 1
            for w in self.words[i]:
                out[i, o_word + w] = 1
            if p >= 0:
                depth[i] = depth[p] + 1
                index[i] = kids[p]
                kids[p] += 1
                same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
                out[i, o_in:o_word] = np.maximum(out[p, o_in:o_word], out[p, :8])
                out[i, o_up:o_num] = np.maximum(out[p, o_up:o_num], out[p, o_word:o_up])
            after[i] = h1
            h1 = max(h1, self.tag[i] == "h1")
        total, links, n_links = own.copy(), np.array(self.link_chars, float), np.array(self.n_links, float)
        under = np.ones(n)
        first = np.where(own > 0, start, np.inf)
        for i in range(n - 1, 0, -1):
            p, t = parent[i], self.tag[i]
            paragraphs[i] += t == "p"
            items[i] += t == "li"
            headings[i] += group[i] in (10, 11)
            for a in (total, links, n_links, words, sentences, blocks, under, paragraphs, items, headings):
                a[p] += a[i]
            first[p] = min(first[p], first[i])
            alike[i] = same[p, t] / kids[p]
        up = np.maximum(parent, 0)
        largest = np.zeros(n)
        np.maximum.at(largest, up[1:], total[1:])
        numbers = [
            depth, kids, np.log1p(total), np.log1p(own), links / np.maximum(total, 1), words / np.maximum(blocks, 1), np.log1p(total / under),
            sentences / np.maximum(words, 1), total / whole, np.where(np.isfinite(first), first, whole) / whole, index, alike, np.log1p(paragraphs), np.log1p(items),
            np.log1p(n_links), np.log1p(headings), after, total / np.maximum(total[up], 1), total / np.maximum(largest[up], 1),
        ]
        out[:, o_num:] = np.stack(numbers, axis=1)
        return out


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The most likely choice of nodes to keep in which every kept node's parent is kept.

    ``log_odds`` of a node's being kept against being dropped with all below it; a node adds its
    own only if it is kept, so a subtree is kept where the best sum over it is positive.
    """
    n = len(page.tag)
    best = log_odds.astype(float).copy()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept = np.zeros(n, bool)
    kept[0] = n > 0 and best[0] > 0
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    return kept
