"""Text normalization as Column functions; white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns of the text contract.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NUMERAL = "[一二三四五六七八九十百千万零〇0-9]"
HEADINGS = (f"(第{NUMERAL}+章)", f"(第{NUMERAL}+节)", f"(第{NUMERAL}+条)", f"(附件{NUMERAL}*)")
FENCES = ("```markdown", "```md", "```")
SHORT_LINE, VERTICAL_SHARE = 2, 0.65
#: What ends a line for line-wise readers: more than LF and CR.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def line_feeds(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Array of lines, at any line end."""
    return F.split(text, LINE_END)


def nonempty_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def normalize_text(text: Column) -> Column:
    """LF line ends, no control characters, lines without trailing blanks, no ends of white space, at most three LF in a row; null is empty."""
    t = line_feeds(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, CONTROL, "")
    t = strip(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n)", ""))
    return F.regexp_replace(t, r"\n{4,}", "\n\n\n")


def strip_fence(text: Column) -> Column:
    """Without one Markdown code fence around the whole text."""
    t = strip(text)
    out = t
    for fence in reversed(FENCES):
        inside = F.substring(t, F.lit(len(fence) + 1), F.greatest(F.length(t) - len(fence) - 3, F.lit(0)))
        out = F.when(t.startswith(fence) & t.endswith("```"), strip(inside)).otherwise(out)
    return out


def normalize_markdown(text: Column) -> Column:
    """Like ``normalize_text``, but trailing blanks of lines stay, and a fence around the text goes."""
    t = F.regexp_replace(line_feeds(F.coalesce(text, F.lit(""))), CONTROL, "")
    return strip(F.regexp_replace(strip_fence(t), r"\n{4,}", "\n\n\n"))


def normalize_text_layer(text: Column) -> Column:
    """Text layer of a PDF: blank lines go, and text set one or two characters a line is joined and broken at headings."""
    kept = nonempty_lines(normalize_markdown(text))
    short = F.size(F.filter(kept, lambda x: F.length(x) <= SHORT_LINE))
    joined = F.regexp_replace(F.array_join(kept, ""), r"(?U)\s+", "")
    broken = reduce(lambda t, heading: F.regexp_replace(t, heading, "\n$1"), HEADINGS, joined)
    vertical = F.array_join(nonempty_lines(broken), "\n")
    return F.when(F.size(kept) == 0, F.lit("")).when(short / F.size(kept) < VERTICAL_SHARE, F.array_join(kept, "\n")).otherwise(vertical)


def plain_text(content: Column) -> Column:
    """Text of a plain file: no byte order mark, LF line ends, lines without trailing blanks, stripped."""
    t = line_feeds(F.regexp_replace(content, r"^\x{FEFF}", ""))
    return strip(F.regexp_replace(t, r"(?U)[[^\S\n]\x1c-\x1f]+(?=\n)", ""))


def overlap_tail(text: Column, size: int) -> Column:
    """Up to ``size`` last characters, from the first line that starts within them."""
    if size <= 0:
        return F.lit("")
    end = strip(F.substring(text, F.greatest(F.length(text) - size, F.lit(0)) + 1, F.lit(size)))
    return bind(end, lambda tail: F.when(F.locate("\n", tail) > 1, strip(F.substring(tail, F.locate("\n", tail) + 1, F.length(tail)))).otherwise(tail))


def _heading_text(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), "^#+", ""))


def first_line(text: Column) -> Column:
    """First line with text besides leading ``#``, without them; null if none."""
    return F.get(F.filter(F.transform(lines(text), _heading_text), lambda x: x != ""), 0)


def first_heading(text: Column) -> Column:
    """Text of the first Markdown heading; null if none."""
    marked = F.filter(F.transform(lines(text), strip), lambda x: x.startswith("#"))
    return F.get(F.filter(F.transform(marked, _heading_text), lambda x: x != ""), 0)


def suffix(path: Column) -> Column:
    """Last extension in lower case, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]+$", 0), r"(?<=.)\.[^.]+$", "")


def natural_key(path: Column) -> Column:
    """Sort key of a file's stem in which runs of digits compare as numbers."""
    tokens = F.regexp_extract_all(stem(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    # numbers sort by length, then digits, and before other text
    return F.transform(tokens, lambda x: F.when(x.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), F.length(number(x)).alias("size"), number(x).alias("text"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lower(x).alias("text"))))


def nonempty(*columns: Column) -> Column:
    """First of ``columns`` that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))
