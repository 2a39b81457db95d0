"""Functions over trees that no built-in reads: HTML as found, and JSON in its own key order.

Both are Arrow-batched: a batch of texts in, a batch of results out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeflow.functions.text import strip

# Content containers in order of preference, and JSON keys that hold Markdown.
CONTENT_CLASSES = ("detail-news", "content", "main")
MARKDOWN_KEYS = ("markdown", "markdown_text", "md", "md_text")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Events(HTMLParser):
    """Flat list of a page's nodes: for each its tag, classes, parent and end, and the texts with their node.

    Elements end at their own end tag only, so an open paragraph holds the ones
    after it; end tags without a start are skipped.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.classes, self.ends = ["#page"], [[]], [0]
        self.texts: list[tuple[int, int, str]] = []  # node, time, text
        self.starts, self.open, self.clock = [0], [0], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.clock += 1
        self.tags.append(tag)
        self.classes.append((dict(attrs).get("class") or "").split())
        self.starts.append(self.clock)
        self.ends.append(0)
        node = len(self.tags) - 1
        if tag in VOID:
            self.ends[node] = self.clock
        else:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.ends[self.open.pop()] = self.clock

    def handle_endtag(self, tag: str) -> None:
        if not any(self.tags[n] == tag for n in reversed(self.open)):
            return
        self.clock += 1
        while True:
            node = self.open.pop()
            self.ends[node] = self.clock
            if self.tags[node] == tag:
                return

    def handle_data(self, data: str) -> None:
        self.clock += 1
        self.texts.append((self.open[-1], self.clock, data))

    def finish(self, page: str) -> _Events:
        self.feed(page)
        self.close()
        self.clock += 1
        for node in self.open:
            self.ends[node] = self.clock
        return self


def main_paragraphs(page: str | None) -> str:
    """Paragraphs of the preferred container, one a line, inline pieces joined as they are."""
    if not page:
        return ""
    tree = _Events().finish(page)
    node = next((i for c in CONTENT_CLASSES for i, t in enumerate(tree.tags) if t == "div" and c in tree.classes[i]), None)
    if node is None:
        node = next((i for i, t in enumerate(tree.tags) if t == "body"), 0)
    lo, hi = tree.starts[node], tree.ends[node]
    texts = [(at, text) for n, at, text in tree.texts if lo <= at <= hi and tree.tags[n] not in ("script", "style")]
    spans = [(tree.starts[i], tree.ends[i]) for i, t in enumerate(tree.tags) if t == "p" and lo <= tree.starts[i] <= hi]
    paragraphs, at, first = [], 0, 0
    for start, end in spans:
        while first < len(texts) and texts[first][0] < start:
            first += 1
        pieces, at = [], first
        while at < len(texts) and texts[at][0] <= end:
            pieces.append(texts[at][1].strip())
            at += 1
        paragraphs.append("".join(pieces))
    paragraphs = [p for p in paragraphs if p]
    if not paragraphs:
        paragraphs = [line.strip() for line in "\n".join(text for _, text in texts).splitlines() if line.strip()]
    return "\n".join(paragraphs).strip()


def markdown_strings(text: str | None) -> list[str]:
    """Strings under Markdown keys of a JSON text, depth first and in the text's order; empty if it isn't JSON."""
    try:
        top = json.loads(text or "")
    except ValueError:
        return []
    out, todo = [], [top]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            todo.extend(_Found(v) if isinstance(v, str) and k.lower() in MARKDOWN_KEYS else v for k, v in reversed(value.items()))
        elif isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, _Found):
            out.append(str(value))
    return out


class _Found(str):
    """A string under one of the keys."""


@F.pandas_udf(T.StringType())
def html_paragraphs(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for page in pages:
        yield page.map(main_paragraphs, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_markdown(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(markdown_strings, na_action=None)


# References that titles hold; the older names need no semicolon. The ampersand comes last.
REFERENCES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?|&apos;", "'"), ("&nbsp;?", "\u00a0"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"))


def unescape(text: Column) -> Column:
    """Common character references as characters."""
    for name, value in REFERENCES:
        text = F.regexp_replace(text, name, value)
    return text


def html_title(page: Column) -> Column:
    """The article title that a page's meta names, else its title up to the first underscore; null if neither has text."""
    meta = F.regexp_extract(page, r"""(?is)<meta\b(?=[^>]*\bname\s*=\s*["']?ArticleTitle["'\s/>])[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    single = F.regexp_extract(page, r"""(?is)<meta\b(?=[^>]*\bname\s*=\s*["']?ArticleTitle["'\s/>])[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    title = F.regexp_extract(page, r"(?is)<title\b[^>]*>([^<]*)</title\s*>", 1)
    found = [strip(unescape(meta)), strip(unescape(single)), strip(F.split_part(unescape(title), F.lit("_"), F.lit(1)))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
