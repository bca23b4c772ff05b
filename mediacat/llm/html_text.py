"""Main text of web pages by composite text density.

For every node of the page's tree the number of characters per tag is computed and
adjusted by the share of link text: with C characters, T tags, LC link characters and LT
link tags below a node, and LCB and CB those of the body,

    density = C/T * log(C/LC * T/LT) / log(log(C/(C-LC) * LC + LCB/CB * C + e))

A container's density sum adds the densities of its children. The one with the largest sum
is the core of the article, or the article or main element around it; the least density on its path from the body is the threshold; the
core, and the densest node of every other branch that reaches the threshold, are content.

What no article contains is taken out of the tree before that: scripts, styles, forms,
menus, page headers and footers, sidebars, notices, adverts and reader comments, known by
element, role, visibility, or a class or id that consists of such names, or begins or ends
with one of comments or notices. Nothing around an article or main is dropped by name, nor
all text of the page. Comments go first. Of what remains, a form (but for its controls) or
a compound name around the core stays, and so does another name that holds most of the
characters of a page without an article. Where the core is in an article or main, nothing
outside such elements is content; nor if articles hold most characters of the core. A label is
dropped only with a control.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that can hold an article; a paragraph or a list is part of one.
CONTAINERS = frozenset("html body main article section div form center table tbody tr td details dir".split())
HEAD = frozenset("base head link meta noscript script style template title".split())
#: An open element of the key is closed by a start tag of the values.
_CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Up to which a search for an element to close goes.
_SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "option": frozenset(["select"])}

DROPPED = frozenset("head nav footer aside button select svg canvas audio video object applet dialog menu input".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar widget share sharing social related recommended recommendations comment comments disqus respond reply replies login signup search skip".split()
)
#: Of those, names of reader comments; an element whose first or last part is one holds comments.
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies".split())
#: A compound name with one of these as first or last part is dropped unless it holds the core.
NOTICE_NAMES = frozenset("advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices newsletter paywall sidebar footer breadcrumb breadcrumbs pagination".split())
#: Parts by which a name tells the state of a page or element, not what it holds.
STATE_PARTS = frozenset("has with without no is open closed show hide".split())
CONTROLS = frozenset("input select textarea button".split())
KEPT = frozenset(["html", "body", "article", "main"])


def _dropped(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in KEPT:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _named(tag: str, attributes: str) -> str:
    """Why an element may be dropped: ``form``, ``comment``, ``name`` (a whole class or id consists
    of the names to drop), ``notice`` (a compound of one), or nothing."""
    kind = "form" if tag == "form" else ""
    if not attributes or tag in KEPT:
        return kind
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in value.strip("\"'").lower().split():
                parts = _NAME_PARTS.findall(token)
                if not parts or not STATE_PARTS.isdisjoint(parts):
                    continue
                ends = {parts[0], parts[-1]}
                if ends & COMMENT_NAMES:
                    return "comment"
                if DROPPED_NAMES.issuperset(parts):
                    kind = kind or "name"
                elif ends & NOTICE_NAMES:
                    kind = kind or "notice"
    return kind


class Page:
    """The tree of a page as flat arrays: a node's parent comes before it."""

    def __init__(self, html: str):
        self.tags, self.parents, self.drop = ["html"], [0], [False]
        #: Text and its node in page order; a node of -1 is a block's edge.
        self.pieces: list[tuple[int, str]] = []
        self._open = [0]
        self._count = {"html": 1}
        self._named: dict[int, str] = {}
        self._labels: list[tuple[int, bool]] = []
        self._parse(html)
        self._drop_labels()
        self._drop_named()

    def _block(self, node: int) -> int:
        while node and self.tags[node] not in BLOCK:
            node = self.parents[node]
        return node

    def _drop_labels(self) -> None:
        """Drop labels of controls: those that name one, hold one or share a block with one."""
        if not self._labels:
            return
        near = set()
        for k, tag in enumerate(self.tags):
            if tag in CONTROLS:
                near.add(self._block(k))
                while k and self.tags[k] != "label":
                    k = self.parents[k]
                near.add(k)
        self.drop = self._dropped_with({k for k, names_one in self._labels if names_one or k in near or self._block(k) in near})

    def _has_text(self, drop: list[bool]) -> bool:
        return any(node >= 0 and not drop[node] and text.strip() for node, text in self.pieces)

    def _sizes(self) -> list[int]:
        """The characters that aren't dropped or white space below each node."""
        size = [0] * len(self.tags)
        for node, text in self.pieces:
            if node >= 0 and not self.drop[node]:
                size[node] += len("".join(text.split()))
        for k in range(len(size) - 1, 0, -1):
            size[self.parents[k]] += size[k]
        return size

    def _drop_named(self) -> None:
        """Drop comments and what is named, but nothing around an article or main, and not all
        text of the page. Around the core of what isn't a comment, forms and compound names
        stay, and other names if they hold most of the characters and no article is declared."""
        if not self._named:
            return
        commented = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            commented[k] = commented[self.parents[k]] or self._named.get(k) == "comment"
        articles = [k for k, tag in enumerate(self.tags) if tag in ("article", "main") and not self.drop[k]]
        if any(not commented[k] for k in articles) or len(articles) > 1:  # a comment may be an article too
            articles = [k for k in articles if not commented[k]]
        holds = set()
        for k in articles:
            while k and k not in holds:
                holds.add(k)
                k = self.parents[k]
        named = {k: kind for k, kind in self._named.items() if k not in holds}
        drop = self._dropped_with({k for k, kind in named.items() if kind == "comment"})
        if self._has_text(drop):
            self.drop = drop
        _, sums = self.densities()
        core = max(range(len(sums)), key=lambda k: (sums[k], -k))
        around = set()
        while core:
            around.add(core)
            core = self.parents[core]
        rest = {k for k, kind in named.items() if kind == "name" or kind in ("form", "notice") and k not in around}
        if held := rest & around:
            size = self._sizes()
            if not holds:
                rest -= {k for k in held if 2 * size[k] > size[0]}
        drop = self._dropped_with(rest)
        self.drop = drop if self._has_text(drop) else self._dropped_with(rest - around)

    def _dropped_with(self, named: set[int]) -> list[bool]:
        drop = self.drop[:]
        for k in range(1, len(drop)):
            drop[k] = drop[k] or drop[self.parents[k]] or k in named
        return drop

    def _push(self, tag: str, attributes: str) -> None:
        top = self._open[-1]
        inside = self._count.get("article", 0) + self._count.get("main", 0) > 0
        self.tags.append(tag)
        self.parents.append(top)
        self.drop.append(self.drop[top] or _dropped(tag, attributes, inside))
        if not self.drop[-1]:
            if kind := _named(tag, attributes):
                self._named[len(self.tags) - 1] = kind
            if tag == "label":
                self._labels.append((len(self.tags) - 1, any(name.lower() == "for" for name, _ in _ATTRIBUTE.findall(attributes))))
        if tag in BLOCK:
            self.pieces.append((-1, ""))
        elif tag == "br":
            self.pieces.append((top, " "))
        if tag not in VOID:
            self._open.append(len(self.tags) - 1)
            self._count[tag] = self._count.get(tag, 0) + 1

    def _pop(self) -> str:
        tag = self.tags[self._open.pop()]
        self._count[tag] -= 1
        if tag in BLOCK:
            self.pieces.append((-1, ""))
        return tag

    def _close(self, tag: str) -> None:
        if tag != "html" and self._count.get(tag):
            while self._pop() != tag:
                pass

    def _close_within(self, tag: str) -> None:
        """Close an open ``tag`` unless an element that bounds its scope is in between."""
        if self._count.get(tag):
            for node in reversed(self._open):
                if self.tags[node] == tag:
                    self._close(tag)
                    return
                if self.tags[node] in _SCOPE[tag]:
                    return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._count.get(tag):
            return
        if self._count.get("head") and tag not in HEAD:
            self._close("head")
        if tag in _CLOSES_P and self._count.get("p"):
            self._close("p")
        for of, by in CLOSED_BY.items():
            if tag in by:
                self._close_within(of)
        self._push(tag, attributes)

    def _text(self, raw: str) -> None:
        if not self.drop[self._open[-1]]:
            self.pieces.append((self._open[-1], unescape(raw) if "&" in raw else raw))

    def _parse(self, html: str) -> None:
        at, look, n = 0, 0, len(html)
        while at < n:
            lt = html.find("<", look)
            m = _TOKEN.match(html, lt) if lt >= 0 else None
            if lt >= 0 and m is None:  # a sign, not a tag
                look = lt + 1
                continue
            if (end := lt if lt >= 0 else n) > at:
                self._text(html[at:end])
            if m is None:
                break
            at = look = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            if lt >= 0 and not html.endswith(">", lt, at):  # cut off by the end of the page
                break
            self._start(tag, m[3] or m[6] or "")
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = look = close.end() if close else n
                self._close(tag)

    def densities(self) -> tuple[list[float], list[float]]:
        """Each node's composite text density and density sum."""
        n = len(self.tags)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if node >= 0:
                chars[node] += len("".join(text.split()))
        for k in range(n - 1, -1, -1):
            if self.drop[k]:
                chars[k] = tags[k] = link_chars[k] = link_tags[k] = 0
                continue
            if self.tags[k] == "a":
                link_chars[k] = chars[k]
                link_tags[k] += 1
            if k:
                up = self.parents[k]
                chars[up] += chars[k]
                link_chars[up] += link_chars[k]
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k]
        body = self.tags.index("body") if "body" in self.tags else 0
        share = link_chars[body] / (chars[body] or 1)
        density, sums = [0.0] * n, [0.0] * n
        for k in range(n):
            if c := chars[k]:
                t, lc, lt = tags[k] or 1, link_chars[k] or 1, link_tags[k] or 1
                base = math.log(c / (c - link_chars[k] or 1) * lc + share * c + math.e)
                density[k] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / math.log(base)
        for k in range(1, n):
            sums[self.parents[k]] += density[k]
        for k in range(n):
            if not tags[k]:  # a node without elements stands for its own text
                sums[k] = density[k]
            if self.tags[k] not in CONTAINERS:
                sums[k] = 0.0
        return density, sums

    def content(self) -> list[bool]:
        """Whether each node belongs to the article."""
        density, sums = self.densities()
        n = len(self.tags)
        best = list(range(n))  # the node of the largest sum in each subtree, the outer of equals
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            if (sums[best[k]], -best[k]) > (sums[best[up]], -best[up]):
                best[up] = best[k]
        core = best[0]
        node = core
        declared = [False] * n  # inside an article or main
        for k in range(1, n):
            declared[k] = declared[self.parents[k]] or self.tags[k] in ("article", "main")
        if any(declared) and not declared[core]:
            # Articles below the core that hold most of its characters declare what is content.
            size, inside = self._sizes(), [False] * n
            for k in range(n):
                inside[k] = k == core or k > 0 and inside[self.parents[k]]
            outer = [k for k in range(1, n) if inside[k] and declared[k] and not declared[self.parents[k]]]
            if 2 * sum(size[k] for k in outer) > size[core]:
                core = node = max(outer, key=lambda k: (sums[k], size[k], -k))
        while node:  # an element that declares the article holds all of it
            node = self.parents[node]
            if self.tags[node] == "article" or self.tags[node] == "main" and self.tags[core] != "article":
                core = node
        best[core] = node = core
        threshold = density[core]
        while node and self.tags[node] != "body":
            node = self.parents[node]
            threshold = min(threshold, density[node])
        marked = [False] * n
        reached = [False] * n
        above = self.tags.index("body") if "body" in self.tags else 0
        while above:
            above = self.parents[above]
            reached[above] = True
        for k in range(n):
            reached[k] = reached[k] or (k == 0 or reached[self.parents[k]]) and density[k] >= threshold and density[k] > 0
            if reached[k] and density[k] > 0 and (declared[best[k]] or not declared[core]):
                marked[best[k]] = True
        for k in range(1, n):
            marked[k] = (marked[k] or marked[self.parents[k]]) and not self.drop[k]
        return marked

    def text(self) -> str:
        inside = self.content()
        blocks: list[str] = []
        block: list[str] = []
        for node, text in [*self.pieces, (-1, "")]:
            if node >= 0:
                if inside[node]:
                    block.append(text)
            elif block:
                if line := " ".join("".join(block).split()):
                    blocks.append(line)
                block = []
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    """The article's text, one line a block; empty for null, empty and textless pages."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; ``n_chars`` counts code points."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
