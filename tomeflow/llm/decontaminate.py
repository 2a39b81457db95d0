"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased words: runs of letters, digits and underscores of any
script, and each letter by itself of scripts that don't put blanks between words
(``UNSPACED``). Fixed masks run over the words; a seed is the hash of the words at
the mask's 1s, so a substitution at a 0 doesn't change it. Test and training seeds
are joined; each hit proposes an alignment (training position minus test
position), on which words are compared in place: a document leaks an item if some
window of ``window`` aligned words (the whole item, if it is shorter) agrees in
``min_similarity`` of them.

The masks guarantee a hit: wherever the words that may differ stand in a window,
some mask at some place in it has none of them under a 1. Windows of 13 words and
more have ``MASKS``, shorter ones shorter masks, and windows with more differing
words than these allow meet under the longest run of words that must agree. Of
items with one to four words none may differ at 0.8; ``min_words`` leaves out
items shorter than that, and is 1 unless given.

The test seeds are broadcast if they are at most ``seed_limit``, by the items' own
word counts. Beyond that the seeds of documents that pass a bitmap of the test
seeds (of ``JOIN_BITS`` bits) are shuffled and joined, with the same links.

Nulls and edges: null or empty texts leak nothing, and so do items without words;
null item ids are a value like others; of alignments that tie the first counts; repeated rows of a document or item give the same pair once; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomeflow.llm.common import cut, keep_rows, row_key

#: Fixed masks: 1s are hashed, 0s may differ. These hit any 13 words of which two differ.
MASKS = ("11101101", "1101001110011", "110010100111011", "1110100111")
#: These hit any 6 words of which one differs and any 10 of which two do; with ``FIVE`` any 5 of which one does.
SHORT = ("1111", "11011")
FIVE = ("10111", "11101")
LONGEST = max(map(len, MASKS))
WINDOW = 13
MIN_SIMILARITY = 0.8
SEED_LIMIT = 2_000_000
FILTER_BITS = 22
JOIN_BITS = 27

# Thai, Lao, Burmese, Khmer, kana and Han letters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text."""
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """Seed at each position where ``mask`` fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh3_64_intdigest(mask.encode()), np.uint64)
    with np.errstate(over="ignore"):
        for i, kept in enumerate(mask):
            if kept == "1":
                out = (out ^ words[i : i + n]) * _MIX
                out ^= out >> np.uint64(31)
    return out


def masks_for(n: int, window: int = WINDOW, min_similarity: float = MIN_SIMILARITY) -> tuple[str, ...]:
    """Masks of an item with ``n`` words, one of which hits each window that passes."""
    size = min(window, n)
    if not size:
        return ()
    differ = sum(size - k >= min_similarity * size for k in range(1, size))
    if size >= 13 and differ <= 2:
        return tuple(m for m in MASKS if len(m) <= n)
    if differ <= (2 if size >= 10 else 1 if size >= 5 else -1):
        return SHORT if size > 5 else SHORT + FIVE
    return ("1" * -(-(size - differ) // (differ + 1)),)


def aligned(doc: np.ndarray, item: np.ndarray, shift: int, window: int, min_similarity: float) -> tuple[int, int, int] | None:
    """``(matched, start, end)`` in the document of the best window of an alignment, if it passes."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if hi - lo < size:
        return None
    same = np.r_[0, np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])]
    per = same[size:] - same[:-size]
    best = int(per.max())
    if best < min_similarity * size:
        return None
    good = np.flatnonzero(per >= min_similarity * size)
    start, end = lo + shift + int(good[0]), lo + shift + int(good[-1]) + size
    return int(same[good[-1] + size] - same[good[0]]), start, end


class Seeds:
    """The test seeds, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, min_similarity: float = MIN_SIMILARITY) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        seeds, item, at, masks = [], [], [], []
        for k, w in enumerate(self.words):
            for m in masks_for(len(w), window, min_similarity):
                s = seeds_of(w, m)
                seeds.append(s)
                item.append(np.full(len(s), k))
                at.append(np.arange(len(s)))
                masks.append(m)
        self.masks = sorted(set(masks))
        none = np.zeros(0, np.int64)
        all_seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(all_seeds, kind="stable")
        self.seeds, self.item, self.at = all_seeds[order], np.concatenate(item or [none])[order], np.concatenate(at or [none])[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.seeds)] = True

    @staticmethod
    def _slot(seeds: np.ndarray) -> np.ndarray:
        return (seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def alignments(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, shift, hits)`` that seeds propose for a document."""
        pairs = []
        for m in self.masks:
            s = seeds_of(words, m)
            at = np.flatnonzero(self.filter[self._slot(s)]) if len(s) else []
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seeds, s[at], "left"), np.searchsorted(self.seeds, s[at], "right")
            n = hi - lo
            if n.any():
                k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.stack([self.item[k], np.repeat(at, n) - self.at[k]]))
        if not pairs:
            return []
        found, hits = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True)
        return [(int(i), int(d), int(h)) for (i, d), h in zip(found.T, hits, strict=True)]


def best_links(words: np.ndarray, proposed: list[tuple[int, int, int]], items: list[np.ndarray], window: int, min_similarity: float) -> dict[int, tuple[int, int, int, int]]:
    """``item -> (hits, matched, start, end)`` of its best verified alignment."""
    out: dict[int, tuple[int, int, int, int]] = {}
    for item, shift, hits in proposed:
        got = aligned(words, items[item], shift, window, min_similarity)
        if got and (item not in out or (got[0], -got[1]) > (out[item][1], -out[item][2])):
            out[item] = (hits, *got)
    return out


_LINKS = "doc_id {doc}, item_id {item}, row_key string, seed_hits long, matched_words long, item_words long, start_word long, end_word long"


def _rows(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "row_key", "seed_hits", "matched_words", "item_words", "start_word", "end_word"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def item_lengths(items: DataFrame) -> dict[int, int]:
    """How many words of ``items`` stand in items of each length; those of over ``LONGEST`` words count under the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in b.column(0).to_pylist()], pa.int64())], names=["n"])

    counted = items.select("text").mapInArrow(run, "n long").groupBy(F.least("n", F.lit(LONGEST + 1)).alias("length")).agg(F.sum("n").alias("words"))
    return {r.length: r.words for r in counted.collect()}


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_similarity: float = MIN_SIMILARITY, seed_limit: int = SEED_LIMIT, min_words: int = 1) -> DataFrame:
    """Verified leaks, one row per document and item: ids, seed hits, matched words and the word span in the document."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    if min_words > 1:
        items = items.where(F.col("text").isNotNull()).mapInArrow(_at_least(min_words), items.schema)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    schema = _LINKS.format(doc=docs.schema["doc_id"].dataType.simpleString(), item=benchmark.schema["item_id"].dataType.simpleString())
    lengths = item_lengths(items)
    seeds = sum(words * len(masks_for(n, window, min_similarity)) for n, words in lengths.items())
    if seeds <= seed_limit and items.count() <= seed_limit:
        return _leaks_by_broadcast(rows, items, schema, window, min_similarity).distinct()
    masks = sorted({m for n in lengths for m in masks_for(n, window, min_similarity)})
    return _leaks_by_join(rows, items, masks, schema, window, min_similarity).distinct()


def _at_least(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([len(words_of(t)) >= min_words for t in b.column(1).to_pylist()], pa.bool_()))

    return run


def _leaks_by_broadcast(docs: DataFrame, items: DataFrame, schema: str, window: int, min_similarity: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    cache: dict = {}
    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(items.schema["item_id"].dataType), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = cache.get("seeds") or cache.setdefault("seeds", Seeds(sent.value, window, min_similarity))
        for b in batches:
            found = []
            ids, keys = b.column(0), b.column(2)
            for i, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                if proposed := seeds.alignments(words):
                    for k, got in best_links(words, proposed, seeds.words, window, min_similarity).items():
                        found.append((ids[i].as_py(), seeds.ids[k], keys[i].as_py(), got[0], got[1], len(seeds.words[k]), got[2], got[3]))
            if found:
                yield _rows(found, kinds)

    return docs.mapInArrow(run, schema)


def _bitmap(seeds: DataFrame, bits: int = JOIN_BITS) -> np.ndarray:
    """Which leading ``bits`` of a seed occur; at most ``2 ** bits / 64`` rows reach the driver."""
    slot = F.shiftrightunsigned("seed", 64 - bits)
    marked = seeds.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("bit"))
    rows = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _leaks_by_join(docs: DataFrame, items: DataFrame, every: list[str], schema: str, window: int, min_similarity: float) -> DataFrame:
    """The same links where the test seeds are too many to broadcast; ``every`` mask that some item has runs over the documents."""
    keyed = items.select("item_id", "text", F.md5(F.concat_ws("|", F.col("item_id").isNull().cast("string"), F.col("item_id").cast("string"), "text").cast("binary")).alias("item_key"))

    def seed_rows(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = None if sent is None else sent.value
            for b in batches:
                keys, places, seeds = [], [], []
                for key, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                    words = words_of(text)
                    for m in masks_for(len(words), window, min_similarity) if bitmap is None else every:
                        s = seeds_of(words, m)
                        at = np.arange(len(s))
                        if bitmap is not None and len(s):
                            slot = s >> np.uint64(64 - JOIN_BITS)
                            at = np.flatnonzero(bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                        if len(at):
                            keys += [key] * len(at)
                            places.append(at)
                            seeds.append(s[at])
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(places)), pa.array(np.concatenate(seeds).view(np.int64))], names=["key", "at", "seed"])

        return run

    test = cut(keyed.select("text", "item_key").mapInArrow(seed_rows(None), "key string, at long, seed long").select(F.col("key").alias("item_key"), F.col("at").alias("item_at"), "seed"))
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(test))
    train = docs.select("text", "row_key").mapInArrow(seed_rows(sent), "key string, at long, seed long").select(F.col("key").alias("row_key"), "at", "seed").distinct()  # repeated rows hit once
    hits = train.join(test, "seed").groupBy("row_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("hits"))
    hits = hits.groupBy("row_key", "item_key").agg(F.collect_list(F.struct("shift", "hits")).alias("shifts"))
    joined = hits.join(docs.select("doc_id", F.col("text").alias("doc_text"), "row_key"), "row_key").join(keyed.withColumnRenamed("text", "item_text"), "item_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            ids, item_ids, keys, shifts, doc_texts, item_texts = b.columns
            for i, proposed in enumerate(shifts.to_pylist()):
                item = words_of(item_texts[i].as_py())
                got = best_links(words_of(doc_texts[i].as_py()), [(0, p["shift"], p["hits"]) for p in sorted(proposed, key=lambda p: p["shift"])], [item], window, min_similarity).get(0)
                if got:
                    found.append((ids[i].as_py(), item_ids[i].as_py(), keys[i].as_py(), got[0], got[1], len(item), got[2], got[3]))
            if found:
                yield _rows(found, [ids.type, item_ids.type, pa.string(), *[pa.int64()] * 5])

    return joined.select("doc_id", "item_id", "row_key", "shifts", "doc_text", "item_text").mapInArrow(verify, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that leak an item; their columns stay as they are."""
    return keep_rows(docs, leaks(docs.select("doc_id", "text"), benchmark, **options), "left_anti")
