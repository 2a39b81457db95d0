"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base spans are regular expressions with checks (``base_spans``). They seed the
bootstrap: each occurrence of an identifier induces lexical patterns: two of the
words around it, next to it or with one word skipped (``_patterns``), in lower
case and with digits as 0; a word of over ``LONG`` characters stands as its hash.
Pattern and instance form a graph over the whole corpus, scored in rounds in
Spark: a pattern's confidence for a kind is the share of its distinct instances
known to be of that kind; an instance's confidence is ``1 - prod(1 - confidence)``
over its confident patterns. Instances that reach ``min_instance`` become known
and score patterns in the next round, until a round adds none. At the end, each
unmatched identifier-like token (four digits in a row, or an @) that stands in a
confident pattern and is a known instance gives a further span of that kind.
Numbers that merely look like identifiers hold a pattern's confidence down, so
where contexts are random nothing is added.

Nulls and edges: null text is empty; positions are code points, ends exclusive;
rows with a null id are searched like others; repeated rows come back as often
as they came in, their spans are kept apart by id and text; columns other than
``doc_id`` and ``text`` are not read, and ``mask`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.llm.common import cut, row_key, small_enough

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_PATTERN = 0.9
MIN_INSTANCE = 0.9
LONG = 40

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A digit run matches as a whole or not at all, hence the look-behind and the possessive runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]{4}|@")
_SPACE = re.compile(r"\s")
_DIGIT = re.compile(r"[0-9]")
_EDGE = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind as in ``KINDS``, then start."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _short(word: str) -> str:
    return word if len(word) <= LONG else f"#{xxhash.xxh3_128_hexdigest(word)}"


def _word(token: str) -> str:
    return _short(_DIGIT.sub("0", (token.strip(_EDGE) or token).lower()))


def _before(plain: str, at: int, n: int) -> list[str]:
    """Up to ``n`` words before ``at``, the nearest first; each costs its own length."""
    out = []
    while len(out) < n:
        while at > 0 and plain[at - 1] == " ":
            at -= 1
        if at <= 0:
            break
        start = plain.rfind(" ", 0, at) + 1
        out.append(_word(plain[start:at]))
        at = start
    return out + ["^"] * (n - len(out))


def _after(plain: str, at: int, n: int) -> list[str]:
    out = []
    while len(out) < n:
        while at < len(plain) and plain[at] == " ":
            at += 1
        if at >= len(plain):
            break
        end = plain.find(" ", at)
        end = len(plain) if end < 0 else end
        out.append(_word(plain[at:end]))
        at = end
    return out + ["$"] * (n - len(out))


def _patterns(plain: str, start: int, end: int) -> list[str]:
    """Two words around a place: ``_`` is the place, ``*`` any word."""
    b1, b2, b3 = _before(plain, start, 3)
    a1, a2 = _after(plain, end, 2)
    return [f"{b2} {b1} _", f"{b3} {b2} * _", f"{b3} * {b1} _", f"{b1} _ {a1}", f"{b2} * _ {a1}", f"{b1} _ * {a2}"]


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """``(kind or None, start, end, instance, patterns)`` of base spans and other identifier-like tokens."""
    if not spans and not _TRIGGER.search(text):
        return []
    plain = _SPACE.sub(" ", text)
    out = [(kind, s, e, _short(plain[s:e].lower()), _patterns(plain, s, e)) for kind, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    i = done = 0
    for m in _TRIGGER.finditer(plain):
        if m.start() < done:
            continue
        start = plain.rfind(" ", done, m.start()) + 1 or done
        end = plain.find(" ", m.end())
        end = done = len(plain) if end < 0 else end
        while start < end and plain[start] in _EDGE:
            start += 1
        while end > start and plain[end - 1] in _EDGE:
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start < end and not any(s < end for s, _ in taken[i : i + 1]):
            out.append((None, start, end, _short(plain[start:end].lower()), _patterns(plain, start, end)))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id {id}, row_key string, n_email long, n_ip long, n_card long, n_phone long, base string, seen array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"


def find(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base, seen = {k: [] for k in KINDS}, [], []
            for text in b.column(2).to_pylist():
                spans = base_spans(text or "")
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(digest(spans))
                seen.append([dict(zip(("kind", "start", "end", "instance", "patterns"), o, strict=True)) for o in occurrences(text or "", spans)])
            columns = [b.column(0), b.column(1), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(seen, seen_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", row_key().alias("row_key"), text.alias("text")).mapInArrow(run, _FOUND.format(id=kind))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_pattern: float = MIN_PATTERN, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """``(row_key, spans)``: further spans, for the rows that have any."""
    seen = found.select("row_key", F.explode("seen").alias("o")).select("row_key", "o.*")
    edges = cut(seen.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    totals = cut(totals.where(F.col("total") >= min_support))
    known = cut(seen.where("kind is not null").select("instance", "kind").distinct())
    patterns = None
    for _ in range(rounds):
        hits = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
        patterns = cut(hits.join(totals, "pattern").where((F.col("hits") >= min_support) & (F.col("hits") >= min_pattern * F.col("total"))).select("pattern", "kind", (F.col("hits") / F.col("total")).alias("confidence")))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
        scored = edges.where("kind is null").select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
        best = Window.partitionBy("instance").orderBy(F.desc("confidence"), "kind")
        new = scored.where(F.col("confidence") >= min_instance).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("instance", "kind")
        grown = cut(known.unionByName(new).distinct())
        if grown.count() == known.count():
            break
        known = grown
    loose = seen.where("kind is null").select("row_key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    spans = loose.join(patterns.select("pattern", "kind"), "pattern").join(known, ["instance", "kind"]).select("row_key", F.struct("kind", "start", "end").alias("span"))
    return cut(spans.groupBy("row_key").agg(F.collect_set("span").alias("spans")))


def _all_spans(base: str, more: str):
    """Base spans and further ones, by kind as listed, then start."""
    one = F.transform(F.filter(F.split(F.col(base), ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("long").alias("start"), F.split(x, ":")[2].cast("long").alias("end")))
    listed = F.concat(one, F.coalesce(F.col(more), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(listed, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(F.array_distinct(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, row_key, n_email, n_ip, n_card, n_phone, base, spans)``, one row per input row.

    ``n_*`` and ``base`` (``kind:start:end`` by comma) are of the base patterns;
    ``spans`` has the bootstrapped ones too.
    """
    found = cut(find(docs))
    more = bootstrap(found, **options)
    if small_enough(more):
        more = F.broadcast(more)
    return found.drop("seen").join(more, "row_key", "left").withColumn("spans", _all_spans("base", "spans"))


def masked(text: str | None, spans: str | None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first."""
    if not text or not spans:
        return text
    parts = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, at, until = [], 0, -1
    for start, minus, kind in parts:
        if start >= until:
            if until >= 0:
                at = until
            out += [text[at:start], f"[{kind.upper()}]"]
            until = -minus
        else:
            until = max(until, -minus)
    return "".join(out) + text[until:]


def mask(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all spans replaced by their kind; its columns stay as they are."""
    found = cut(find(docs.select("doc_id", "text")))
    more = bootstrap(found, **options)
    columns = docs.columns
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__key", row_key())
    hints = more.select(F.col("row_key").alias("__key"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("__more"))
    keyed = keyed.join(F.broadcast(hints) if small_enough(more) else hints, "__key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(columns.index("text")).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                out.append(masked(t, ",".join(x for x in (digest(base_spans(t or "")), m) if x)))
            cols = [pa.array(out, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return keyed.select(*columns, "__more").mapInArrow(run, docs.schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
