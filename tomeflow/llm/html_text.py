"""Main text of HTML pages by composite text density.

A page becomes a tree, in which formatting elements (``INLINE``) are no nodes of
their own, as bold words make a text no less dense; every node gets its characters ``C``, tags ``T``, link
characters ``LC`` and link tags ``LT``. Its composite density is
``C/T * log(C/LC * T/LT) / log(log(C/(C-LC) * LC + LCb/Cb * C + e))``, with ``b``
the body and no count below 1, so a node whose text is all links has little. A
node's density sum adds up the densities of its children; its own text counts as
one more child, by its characters. The node with the largest sum is the main
subtree and is taken whole; the threshold is the least density on its path from
the body, and every other node that reaches it contributes its own largest-sum
subtree. What lies between them in the smallest node around them all belongs to
the text, too, unless that node is as good as the body. Within what is taken, lists and boxes whose text is nothing but three
links or more (menus) go where their density is below the threshold.

By their kind, scripts and styles, ``nav``, page headers, footers, asides, forms
and hidden nodes, and nodes with such a role, are no text at all. A name is only
a hint: in a box (``BOXES``) all of whose class or id words name page furniture or
are neutral, text counts as link text, unless it holds an article or main heading
(``HEADS``). Names of paragraphs and other elements mean nothing.

Nulls and edges: null or empty HTML gives empty text; broken markup is closed as
browsers do (a block ends an open paragraph, stray end tags are ignored, an open
comment or script reaches to the end); a page of links only gives their text;
depth is not limited, nothing recurses, and time is linear in the page; repeated rows come back as often as they
came in; columns other than the id, the URL and the HTML are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""(<!--)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?][^>]*+>""")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'<>/=]+)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML's element classes and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li optgroup option tbody td tfoot th thead title tr legend".split()) | {"dd", "dt", "li"}
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe svg math object embed canvas audio video map dialog menu label fieldset xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs crumbs footer "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login signin register search share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond replies widget widgets toolbar pagination pager copyright disclaimer masthead topbar skip form".split()
)
NEUTRAL = frozenset("area bar block bottom box center col column container content global group holder inner item items left link links list main module outer page panel primary region right row secondary section site slot space thread top unit wrap wrapper zone".split())
BOXES = frozenset("center dd details div dl figure iframe ins ol section span table tbody td tr ul".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
ARTICLE = frozenset({"article", "main"})
HEADS = ARTICLE | {"h1"}
MENU_LINKS = 3


def _names_furniture(value: str, inside_article: bool) -> bool:
    """Whether some name in a class or id has no words but those of page furniture and neutral ones."""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        known = words & FURNITURE or not inside_article and "header" in words
        if known and words <= FURNITURE | NEUTRAL | {"header"}:
            return True
    return False


def _marks(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether a node is no text by its kind, and whether its name hints at furniture."""
    if tag in NEVER:
        return True, False
    if tag == "header":
        return not inside_article, False
    hint = False
    if not attrs or tag in ("html", "body"):
        return False, False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        value = a or b or c
        name = (name or bare).lower()
        if name in ("class", "id"):
            hint = hint or tag in BOXES and _names_furniture(value, inside_article)
        elif name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, hint


class Page:
    """Tree of one page. Nodes are numbered in page order, so a parent comes before its children."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.gone, self.hint = ["#root"], [-1], [False], [False]
        self.events: list[tuple[int, str | None]] = []  # text of a node, or None at the edge of a block
        self._open, self._article, self._names, self._endless = [0], [0], {}, set()
        self._read(source)

    def _push(self, tag: str, attrs: str) -> int:
        """A new node; none (-1) for formatting, whose text belongs to the node it stands in."""
        up = self._open[-1]
        gone, hint = _marks(tag, attrs, bool(self._article[-1]))
        if tag in INLINE and not (gone or hint or self.gone[up]):
            return -1
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.gone.append(self.gone[up] or gone)
        self.hint.append(hint)
        return node

    def _enter(self, node: int) -> None:
        tag = self.tag[node]
        self._open.append(node)
        self._article.append(self._article[-1] + (tag in ARTICLE))
        self._names[tag] = self._names.get(tag, 0) + 1

    def _leave(self) -> str:
        tag = self.tag[self._open.pop()]
        self._article.pop()
        self._names[tag] -= 1
        if tag in BLOCK:
            self.events.append((0, None))
        return tag

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """End the open elements of ``tags`` that are nearer than any of ``stop``."""
        if not any(self._names.get(t) for t in tags):
            return
        found = 0
        for depth, node in enumerate(reversed(self._open[1:]), 1):
            if self.tag[node] in stop:
                break
            if self.tag[node] in tags:
                found = depth
        for _ in range(found):
            self._leave()

    def _text(self, piece: str) -> None:
        if piece:
            self.events.append((self._open[-1], _html.unescape(piece) if "&" in piece else piece))

    def _read(self, source: str) -> None:
        at = 0
        find = _TOKEN.search
        while m := find(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[1]:
                if source.startswith((">", "->"), at):
                    at = source.index(">", at) + 1
                else:
                    end = _COMMENT_END.search(source, at)
                    at = end.end() if end else len(source)
                continue
            name = m[3]
            if not name:
                continue
            tag = name.lower()
            if m[2]:
                if tag == "p" and not self._names.get("p"):
                    self.events.append((0, None))
                elif self._names.get(tag):
                    while self._leave() != tag:
                        pass
                continue
            if tag in CLOSES_P and self._names.get("p"):
                self._close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in SELF_CLOSING:
                self._close(*SELF_CLOSING[tag])
            if tag == "br":
                self._text(" ")
            elif tag in BLOCK:
                self.events.append((0, None))
            node = self._push(tag, m[4])
            if tag in VOID or node < 0:
                continue
            if tag in RAW:
                end = None if tag in self._endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if end is None:
                    self._endless.add(tag)
                    at = len(source) if tag in ("script", "style") else at
                else:
                    at = end.end()
                continue
            self._enter(node)
        self._text(source[at:])
        self.events.append((0, None))

    def densities(self) -> tuple[int, list[float], list[float]]:
        """The body, and every node's composite density and density sum; ``links`` and ``menu`` are set on the way."""
        n = len(self.tag)
        parent, gone, tag = self.parent, self.gone, self.tag
        own, chars, tags, link_chars, link_tags = [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
        for node, text in self.events:
            if text is not None and not gone[node] and (k := len(" ".join(text.split()))):
                own[node] += k
        head = [t in HEADS for t in tag]  # around the main heading
        for i in range(n - 1, -1, -1):
            if not gone[i]:
                chars[i] += own[i]
                if parent[i] >= 0:
                    chars[parent[i]] += chars[i]
                    tags[parent[i]] += tags[i]
                    head[parent[i]] |= head[i]
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        hint, in_link, links = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            hint[i] = hint[parent[i]] or self.hint[i] and not head[i]
            in_link[i] = in_link[parent[i]] or tag[i] == "a" or hint[i]
        for i in range(n - 1, -1, -1):
            if gone[i]:
                continue
            if in_link[i]:
                link_chars[i] += own[i]
                link_tags[i] += 1
            links[i] += tag[i] == "a"
            if (p := parent[i]) >= 0:
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
                links[p] += links[i]
        share = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if not gone[i] and chars[i]:
                c, t, lc, lt, plain = chars[i], tags[i], max(1, link_chars[i]), max(1, link_tags[i]), max(1, chars[i] - link_chars[i])
                density[i] = c / t * math.log(c / lc * t / lt) / math.log(math.log(c / plain * lc + share * c + math.e))
        for i in range(n - 1, 0, -1):
            total[i] += own[i]
            total[parent[i]] += density[i]
        self.chars, self.hinted = chars, hint
        self.menu = [tag[i] in BOXES and links[i] >= MENU_LINKS and link_chars[i] == chars[i] for i in range(n)]
        return body, density, total

    def content(self) -> list[bool]:
        """Which nodes are article text."""
        body, density, total = self.densities()
        n, parent, gone, chars, hint = len(self.tag), self.parent, self.gone, self.chars, self.hinted
        best = list(range(n))  # of each node's subtree, by sum, the first in page order
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if not gone[i] and not hint[i] and (total[best[i]], -best[i]) > (total[best[p]], -best[p]):
                best[p] = best[i]
        main = best[body] if chars[body] else 0
        threshold, node = density[main], main
        while node > 0 and node != body:
            node = parent[node]
            threshold = min(threshold, density[node])
        keep = [False] * n
        keep[main] = True
        for i in range(n):
            if chars[i] and density[i] >= threshold and not gone[i] and not hint[i]:
                keep[best[i]] = True
        kept = [i for i in range(n) if keep[i]]
        low, high = kept[0], kept[-1]  # the smallest node around the first and the last is around all
        while low != high:
            low, high = (low, parent[high]) if high > low else (parent[low], high)
        if low > body and (chars[low] < chars[body] or self.tag[low] in ARTICLE):
            keep[low] = True
        for i in range(1, n):
            keep[i] = (keep[i] or keep[parent[i]]) and not gone[i] and not ((hint[i] or self.menu[i]) and density[i] < threshold)
        return keep

    def text(self) -> str:
        keep = self.content()
        out, piece = [], []
        for node, text in self.events:
            if text is not None:
                if keep[node]:
                    piece.append(text)
            elif piece:
                if line := " ".join("".join(piece).split()):
                    out.append(line)
                piece = []
        return "\n".join(out)


def main_text(source: str | None) -> str:
    """The article text of one page, one line a block."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
