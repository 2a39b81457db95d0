"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds a bounded sample of labelled text. A
document is parsed against every automaton from left to right into the longest
phrases that occur in that language's text; the cross-parsing entropy of a
language is ``phrases * log2(sample length) / symbols``. The language with the
least entropy wins, ties by name; the score is ``1 - best / second``.

Text is read as lower-cased letters, with one space for any run of other
characters. Whole texts are parsed, in stretches of ``STRETCH`` symbols that
start a phrase of their own, so that memory doesn't follow the longest text and
many stretches advance together.

The sample: ``sample_docs`` documents a language, in the order of the MD5 of
their id, and ``sample_symbols`` symbols of them, dealt in turns of ``TURN``
symbols a document, so no long document fills it; models stay of one size
whatever the corpus. They are built on the workers from the broadcast sample
(under ``TOTAL_SYMBOLS`` characters), with sparse transitions, so memory follows
the sample and not the alphabet.

Nulls and edges: null text, and text without letters, is ``und`` with score 0;
rows with a null language or id teach nothing, of repeated ids one row does; with
no labelled row at all everything is ``und``; languages that tie go by name;
repeated rows come back as often as they came in; columns other than ``doc_id``,
``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.llm.common import binary_parts, row_slices

SAMPLE_DOCS = 64
SAMPLE_SYMBOLS = 32_768
#: Over all languages; with many languages each gets less.
TOTAL_SYMBOLS = 400_000
STRETCH = 2048
TURN = 256
UNKNOWN, SPACE = 0, 1
_CACHE: dict = {}


def folds(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for other code points."""
    if "letters" not in _CACHE:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CACHE["letters"] = table
    return _CACHE["letters"]


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_only(text: str) -> str:
    """Lower-cased letters with one space for each run of other characters."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.where(points, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return "".join(map(chr, points[keep]))


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], list[int]]:
    """Transitions and suffix links of the automaton of all substrings of ``text``."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step, link


class Transitions:
    """Sparse transitions by row displacement: those of a state stand at its offset plus their symbols, in one table that is a quarter full.

    Offsets are drawn at random, for the states with the most transitions first,
    and drawn again for states that meet others.
    """

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int) -> None:
        rng = np.random.Generator(np.random.PCG64(3))
        room = 4 * len(state) + 64
        self.offset = np.zeros(states, np.int32)
        self.owner, self.to = np.full(room + width, -1, np.int32), np.zeros(room + width, np.int32)
        order = np.argsort(state, kind="stable")
        state, symbol, to = state[order], symbol[order], to[order]
        degree = np.bincount(state, minlength=states)
        for many in 2 ** np.arange(int(degree.max(initial=0)).bit_length())[::-1]:
            left = np.flatnonzero((degree[state] >= many) & (degree[state] < 2 * many))
            while len(left):
                mine = state[left]
                drawn = rng.integers(0, room, states, dtype=np.int32)
                slot = drawn[mine] + symbol[left]
                failed = np.zeros(states, bool)
                failed[mine[self.owner[slot] >= 0]] = True
                tried = np.flatnonzero(~failed[mine])
                before = self.owner[slot[tried]]
                self.owner[slot[tried]] = mine[tried]  # of states that meet in a slot the last stays
                failed[mine[tried[self.owner[slot[tried]] != mine[tried]]]] = True
                lost = failed[mine[tried]]
                keep = tried[~lost]
                self.owner[slot[tried]] = before
                self.owner[slot[keep]], self.to[slot[keep]] = mine[keep], to[left[keep]]
                self.offset[mine[keep]] = drawn[mine[keep]]
                left = left[failed[mine]]

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no transition."""
        slot = self.offset.take(state) + symbol
        return np.where(self.owner.take(slot) == state, self.to.take(slot), -1)


class Parser:
    """Cross-parser over the automata of all languages; states are numbered through.

    A phrase goes on while its state has a transition, so the automata's own
    transitions are enough; they are stored sparsely, those of the roots as rows.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        alphabet = sorted(set("".join(samples.values())) - {" "})
        symbol = {ch: i + 2 for i, ch in enumerate(alphabet)} | {" ": SPACE}
        self.symbols = np.full(0x110000, UNKNOWN, np.int32)
        lower = _letters()
        for ch, i in symbol.items():
            self.symbols[ord(ch)] = i
        self.symbols = np.where(lower > 0, self.symbols[lower], SPACE).astype(np.int32)
        parts, roots, base = [], [], 0
        self.start = np.zeros((len(self.langs), len(alphabet) + 2), np.int32)
        for k, lang in enumerate(self.langs):
            step, _ = suffix_automaton(samples[lang])
            parts.append(np.array([(s + base, symbol[ch], t + base) for s, to in enumerate(step) for ch, t in to.items()], np.int32).reshape(-1, 3))
            roots.append(base)
            self.start[k] = base  # an unknown symbol is a phrase of its own, after which the root waits
            for ch, t in step[0].items():
                self.start[k, symbol[ch]] = t + base
            base += len(step)
        self.roots = np.array(roots, np.int32)
        self.go = Transitions(*np.concatenate(parts).T, base, len(alphabet) + 2)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each stretch against each language."""
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order], sizes[order]
        state = np.repeat(self.roots[:, None], len(at), axis=1)
        count = np.zeros((len(self.langs), len(at)), np.int32)
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        root = self.roots[:, None]
        for t, k in enumerate(alive):
            now = symbols[at[:k] + t]
            was = state[:, :k]
            v = self.go.next(was, now[None, :])
            ended = v < 0
            count[:, :k] += ended | (was == root)  # after the root, any symbol starts a phrase
            state[:, :k] = np.where(ended, self.start[:, now], v)
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        points = code_points(raw[offsets[0] : offsets[-1]])
        lead = np.r_[0, np.cumsum((raw[offsets[0] : offsets[-1]] & 0xC0) != 0x80)]
        bounds = lead[offsets - offsets[0]]
        symbols = self.symbols[points]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)
        keep[bounds[:-1][bounds[:-1] < len(keep)]] = True
        kept = np.r_[0, np.cumsum(keep)]
        bounds, symbols = kept[bounds], symbols[keep]
        letters = np.r_[0, np.cumsum(symbols != SPACE)][bounds]
        size = np.diff(bounds)
        parts = np.maximum(1, -(-size // STRETCH))
        doc = np.repeat(np.arange(n), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = bounds[:-1][doc] + nth * STRETCH
        sizes = np.minimum(STRETCH, bounds[1:][doc] - starts)
        counts = self.phrases(symbols, starts, sizes)
        total = np.zeros((len(self.langs), n))
        for i in range(len(self.langs)):
            total[i] = np.bincount(doc, counts[i], minlength=n)
        entropy = total * self.bits[:, None] / np.maximum(1, size)[None, :]
        best = entropy.argmin(axis=0)
        least = entropy.min(axis=0)
        if len(self.langs) > 1:
            second = np.partition(entropy, 1, axis=0)[1]
            score = 1 - least / np.maximum(second, 1e-300)
        else:
            score = np.ones(n)
        none = np.diff(letters) == 0
        return ["und" if none[i] else self.langs[best[i]] for i in range(n)], np.where(none, 0.0, np.clip(score, 0, 1))


def sample_text(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> dict[str, str]:
    """A bounded sample of each language's labelled text; at most ``sample_docs`` rows a language reach the driver."""
    labelled = docs.where((folds() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    ids = labelled.select("doc_id", "lang").distinct()
    # first within hashed parts of a language, so that its rows never meet in one task
    of_part = F.pmod(F.xxhash64("doc_id"), F.lit(256))
    for part in (["lang", of_part], ["lang", F.pmod(of_part, F.lit(16))], ["lang"]):
        ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("nth") <= sample_docs)
    chosen = {(r.lang, r.doc_id): r.nth for r in ids.collect()}
    if not chosen:
        return {}
    langs = sorted({lang for lang, _ in chosen})
    most = max(256, min(sample_symbols, TOTAL_SYMBOLS // len(langs)))
    rows = labelled.where(F.col("doc_id").isin(sorted({i for _, i in chosen}))).groupBy("lang", "doc_id").agg(F.min(F.expr(f"substring(text, 1, {2 * most})")).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted((r for r in rows.collect() if (r.lang, r.doc_id) in chosen), key=lambda r: (r.lang, chosen[r.lang, r.doc_id])):
        texts.setdefault(r.lang, []).append(letters_only(r.text + " "))
    out = {lang: "".join(t[at : at + TURN] for at in range(0, max(map(len, of_lang)), TURN) for t in of_lang)[:most] for lang, of_lang in texts.items()}
    return {k: v for k, v in out.items() if v.strip()}


def parser_of(samples: dict[str, str]) -> Parser:
    """The parser of these samples, built once in each worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).digest()
    if key not in _CACHE:
        _CACHE[key] = Parser(samples)
    return _CACHE[key]


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per input row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(sample_text(docs, sample_docs, sample_symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sent.value
        for b in batches:
            n = b.num_rows
            if not samples:
                langs, scores = ["und"] * n, np.zeros(n)
            else:
                parser = parser_of(samples)
                offsets, raw = binary_parts(b.column(2))
                langs, scores = [], np.zeros(n)
                for lo, hi in row_slices(np.diff(offsets)):
                    names, scores[lo:hi] = parser.predict(offsets[lo : hi + 1], raw)
                    langs += names
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(folds() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
