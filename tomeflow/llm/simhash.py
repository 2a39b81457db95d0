"""SimHash near-duplicate groups by pivot distance tables.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of
its word shingles. Two fingerprints link at ``max_bits`` or fewer differing
bits. Pairs are found with distance tables to reference fingerprints:

1. Copies of one fingerprint collapse to a class before anything is paired.
2. The 64 bits fall into ``max_bits + 2`` bands. For each band a table holds the
   partial Hamming distances to every reference fingerprint within that band.
   Partial distances of a linked pair are equal in two bands at least, so the
   pair meets under the key of some two bands (full-width distances alone leave
   a quadratic number of pairs: 57 % of random pairs pass each reference).
3. Under a key, a pair goes if its full distances to any reference differ by
   more than ``max_bits`` (the triangle inequality); survivors are verified by
   XOR and bit count.
4. Each key emits a spanning forest of its links and not all pairs. A key with
   more than ``group_limit`` fingerprints is dealt again under keys of finer
   bands, twice at most. What still meets then are distinct fingerprints that
   agree in half their bits or so; they are dealt into blocks, every two of which
   meet, so no task holds more than some two limits.

Nulls and edges: null text counts as empty, which has fingerprint zero; a null
``doc_id`` keeps its fingerprint, links with nothing and has a null component;
repeated rows come back as often as they came in. Only ``doc_id`` and ``text``
are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import by_key, connected_components, cut, keep_rows, row_key, small_enough, sorted_groups, texts_of

SEED = 42
REFERENCES = 32
GROUP_LIMIT = 20_000
#: Moduli of the finer bands for keys over the limit; class j holds the bits i with i % m == j.
#: More levels would multiply the rows of a dense cloud without parting it; blocks of it follow.
FINER = (5, 7)
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: bytes, words: int = 4) -> int:
    """Majority fingerprint of the UTF-8 ``text``; A-Z are lower-cased."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    n = len(tokens) - words + 1
    starts = [0, *ends]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, SHINGLES_AT_ONCE):
        hi = min(n, lo + SHINGLES_AT_ONCE)
        hashes = np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(starts[lo:hi], ends[lo + words - 1 : hi + words - 1], strict=True)), np.uint64, hi - lo)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in texts_of(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def references(n: int = REFERENCES) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, n, dtype=np.uint64)


def distances(fps: np.ndarray, mask: int = 2**64 - 1, refs: np.ndarray | None = None) -> np.ndarray:
    """Table of Hamming distances to the references within ``mask``, one row a fingerprint."""
    refs = references() if refs is None else refs
    return np.bitwise_count((fps[:, None] ^ refs[None, :]) & np.uint64(mask)).astype(np.uint8)


def _fold(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit key of a row of distances, on top of ``key``."""
    out = key.copy()
    with np.errstate(over="ignore"):
        for packed in np.ascontiguousarray(table).view(np.uint64).T:
            out = (out ^ packed) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def band_masks(bands: int) -> list[int]:
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def cells(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Keys of every two bands of ``max_bits + 2``."""
    tables = [distances(fps, m) for m in band_masks(max_bits + 2)]
    start = np.zeros(len(fps), np.uint64)
    out = []
    for n, (i, j) in enumerate(combinations(range(len(tables)), 2)):
        out.append(_fold(_fold(start + np.uint64(n + 1), tables[i]), tables[j]))
    return out


def finer_cells(key: np.ndarray, fps: np.ndarray, level: int) -> list[np.ndarray]:
    """Keys below ``key``: bits by residue; a linked pair agrees in one class at least."""
    m = FINER[level]
    return [_fold(key + np.uint64(j + 1), distances(fps, sum(1 << i for i in range(j, 64, m)))) for j in range(m)]


def _pairs_of_runs(fps: np.ndarray, run: np.ndarray, longest: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of short runs, all runs at a time."""
    table = distances(fps)
    left, right = [], []
    for step in range(1, longest):
        i = np.flatnonzero(run[step:] == run[:-step])
        if not len(i):
            break
        j = i + step
        for c in range(table.shape[1]):
            near = np.abs(table[i, c].astype(np.int16) - table[j, c]) <= max_bits
            i, j = i[near], j[near]
            if c >= 3 and not len(i):
                break
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        left.append(i[ok])
        right.append(j[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _forest_of_group(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in one group; a linked row leaves the rest at once."""
    table = distances(fps)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = np.asfortranarray(table[order]), fps[order]
    rest = np.arange(len(fps))
    left, right, queue = [], [], []
    while len(rest) or queue:
        if queue:
            x = queue.pop()
        else:
            x, rest = int(rest[0]), rest[1:]
        d = int(table[x, 0])
        first = table[rest, 0]
        lo, hi = np.searchsorted(first, [d - max_bits if d > max_bits else 0, d + max_bits + 1])
        near = np.arange(lo, hi)
        for c in range(1, table.shape[1]):
            if not len(near):
                break
            near = near[np.abs(table[rest[near], c].astype(np.int16) - int(table[x, c])) <= max_bits]
        near = near[np.bitwise_count(sorted_fps[rest[near]] ^ sorted_fps[x]) <= max_bits]
        if len(near):
            found = rest[near]
            left.append(np.full(len(found), x))
            right.append(found)
            queue.extend(found.tolist())
            rest = np.delete(rest, near)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


SMALL_RUN = 24
_OUT = "kind int, key long, fp long, rep long, other long"


def _links(max_bits: int, limit: int | None):
    """Streams groups of a key: links as (rep, other), rows of too large groups as they came."""

    def batch(kind, key, fp, rep, other):
        n = len(rep)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(fp), pa.array(rep), pa.array(other)], names=["kind", "key", "fp", "rep", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bounded_groups(batches, limit):
            key, fp, rep, whole = table
            if not whole:
                yield batch(1, key, fp, rep, rep)
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            run_no = np.repeat(np.arange(len(starts)), sizes)
            u = fp.view(np.uint64)
            few = np.flatnonzero((sizes >= 2) & (sizes <= SMALL_RUN))
            got_a, got_b = [], []
            if len(few):
                rows = np.flatnonzero(np.isin(run_no, few))
                a, b = _pairs_of_runs(u[rows], run_no[rows], int(sizes[few].max()), max_bits)
                got_a.append(rep[rows[a]])
                got_b.append(rep[rows[b]])
            for g in np.flatnonzero(sizes > SMALL_RUN):
                s = slice(starts[g], starts[g] + sizes[g])
                a, b = _forest_of_group(u[s], max_bits)
                got_a.append(rep[s][a])
                got_b.append(rep[s][b])
            if got_a and sum(map(len, got_a)):
                a, b = np.concatenate(got_a), np.concatenate(got_b)
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                zero = np.zeros(len(a), np.int64)
                yield batch(0, zero, zero, a, b)

    return run


def bounded_groups(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``(key, fp, rep, whole)`` of whole groups, or, with whole False, pieces of one group over ``limit``."""
    held: list[tuple[np.ndarray, ...]] = []
    over = None

    def joined():
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(np.asarray(b.column(i)) for i in range(3))
        if held and len(held[0][0]):
            held.append(cols)
            cols = joined()
            held = []
        key = cols[0]
        if over is not None:
            n = int(np.searchsorted(key, over, side="right"))
            if n:
                yield (*(c[:n] for c in cols), False)
                cols = tuple(c[n:] for c in cols)
                key = cols[0]
            if not len(key):
                continue
            over = None
        last = int(np.searchsorted(key, key[-1], side="left"))
        if last:
            yield from _by_size(tuple(c[:last] for c in cols), limit)
        tail = tuple(c[last:] for c in cols)
        if limit and len(tail[0]) > limit:
            over = tail[0][0]
            yield (*tail, False)
        else:
            held = [tail]
    if held and len(held[0][0]):
        yield from _by_size(joined(), limit)


def _by_size(cols: tuple[np.ndarray, ...], limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    key = cols[0]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    big = sizes > limit if limit else np.zeros(len(sizes), bool)
    if not big.any():
        yield (*cols, True)
        return
    rows = np.repeat(big, sizes)
    yield (*(c[rows] for c in cols), False)
    if not rows.all():
        yield (*(c[~rows] for c in cols), True)


def _deal(frame: DataFrame, keys) -> DataFrame:
    """One row for each key of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp, rep = (np.asarray(b.column(i)) for i in range(3))
            for k in keys(key.view(np.uint64), fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(fp), pa.array(rep)], names=["key", "fp", "rep"])

    return frame.select("key", "fp", "rep").mapInArrow(run, "key long, fp long, rep long")


def in_blocks(over: DataFrame, limit: int) -> DataFrame:
    """Rows of keys that nothing parts further: every two blocks of at most some ``limit`` rows under a key of their own."""
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    blocks = cut(blocks)
    dealt = over.join(F.broadcast(blocks) if small_enough(blocks) else blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    met = dealt.withColumn("other", F.explode(others))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "rep")


def links(classes: DataFrame, max_bits: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(rep, other)``: links that span every group of ``classes (fp, rep)``."""
    start = classes.select(F.lit(0).cast("long").alias("key"), "fp", "rep")
    dealt = _deal(start, lambda key, fp: cells(fp, max_bits))
    found = None
    for level in range(len(FINER) + 2):
        limit = group_limit if level <= len(FINER) else None
        out = cut(by_key(dealt, "key", _links(max_bits, limit), _OUT, then=("rep",)))
        edges = out.where("kind = 0").select("rep", "other")
        found = edges if found is None else found.unionByName(edges)
        over = out.where("kind = 1")
        if limit is None or over.isEmpty():
            break
        if level < len(FINER):
            dealt = _deal(over, lambda key, fp, level=level: finer_cells(key, fp, level))
        else:
            dealt = in_blocks(over, group_limit)
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)``, one row per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    ``doc_id`` reachable over links; ``kept`` marks the document that stays.
    """
    fps = cut(fingerprints(docs, words))
    classes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = connected_components(links(classes, max_bits, group_limit), "rep", "other")
    named = classes.join(comps, classes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


# Deduplication by similarity: the fingerprints propose, shingle sets decide.

SIMILARITY = 0.8
#: Bits that two prints of 64 may differ in and still be compared; 0.8 is at 19 of 128 on average, four deviations are 16 more.
NEAR_BITS = 18
#: Fingerprints of a text, bits of a band and bits of it that are turned; wider bands meet fewer of the pairs at the threshold.
PRINTS, BAND_BITS, WEAK_BITS = 2, 16, 4
ALL_PAIRS = 20_000
#: Links that a task holds before it thins them out.
FOREST_AT = 1 << 20
#: Shingles of a cluster in one block.
BLOCK = 1 << 19


def _sketch(text: bytes, words: int, prints: int, band_bits: int, weak: int) -> tuple[bytes, list[int], list[int]]:
    """``(digest, fingerprints, masks)``: a mask has the ``weak`` bits of least majority in each band.

    Shingles that repeat count once, as in ``shingle_set``.
    """
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    digest = xxhash.xxh3_128_digest(joined, seed=7)
    if not tokens:
        return digest, [0] * prints, [0] * prints
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    stops = [*ends[words - 1 :]] if len(tokens) >= words else [len(joined) + 1]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, stops, strict=False)), np.uint64, len(stops))
    hashes, at = np.unique(hashes, return_index=True)
    n = len(at)
    fps, masks = [], []
    for k in range(prints):
        if k:
            hashes = np.fromiter((xxhash.xxh64_intdigest(joined[starts[i] : stops[i] - 1], SEED + k) for i in at.tolist()), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, SHINGLES_AT_ONCE):
            ones += np.unpackbits(hashes[lo : lo + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        margin = 2 * ones - n
        fps.append(int(np.packbits((margin > 0).astype(np.uint8), bitorder="little").view(np.uint64)[0]))
        mask = 0
        for band in range(64 // band_bits):
            for i in np.argsort(np.abs(margin[band * band_bits : (band + 1) * band_bits]), kind="stable")[:weak].tolist():
                mask |= 1 << (band * band_bits + i)
        masks.append(mask)
    return digest, fps, masks


def sketches(docs: DataFrame, words: int, prints: int, band_bits: int, weak: int) -> DataFrame:
    """``(doc_id, row_key, digest, fp, weak)`` of each row; the last two are arrays, one entry a print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_sketch(t, words, prints, band_bits, weak) for t in texts_of(batch.column(2))]
            signed = lambda rows: pa.array([np.array(r, np.uint64).view(np.int64).tolist() for r in rows], pa.list_(pa.int64()))
            digest = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), signed([g[1] for g in got]), signed([g[2] for g in got])], names=["doc_id", "row_key", "digest", "fp", "weak"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key string, digest binary, fp array<long>, weak array<long>")


def _subsets(mask: np.ndarray, weak: int) -> list[np.ndarray]:
    """For each row, every combination of its mask's bits but none; ``weak`` bits each."""
    bits, rest = [], mask.copy()
    for _ in range(weak):
        low = rest & (~rest + np.uint64(1))
        bits.append(low)
        rest ^= low
    out = []
    for c in range(1, 1 << weak):
        x = np.zeros(len(mask), np.uint64)
        for i, b in enumerate(bits):
            if c >> i & 1:
                x |= b
        out.append(x)
    return out


_PAIR_COLUMNS = "key long, probe int, id long, p0 long, p1 long"


def banded(classes: DataFrame, band_bits: int, weak: int) -> DataFrame:
    """Each class under the distance-table key of its bands, and under those with some of its weakest bits turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = references()
        for b in batches:
            ids = b.column(0)
            fps = np.array(b.column(1).to_pylist(), np.int64).view(np.uint64)
            masks = np.array(b.column(2).to_pylist(), np.int64).view(np.uint64)
            if not len(fps):
                continue
            p0, p1 = pa.array(fps[:, 0].view(np.int64)), pa.array(fps[:, -1].view(np.int64))
            for k in range(fps.shape[1]):
                for band in range(64 // band_bits):
                    area = ((1 << band_bits) - 1) << (band * band_bits)
                    start = np.full(len(fps), k * 64 + band + 1, np.uint64)
                    for n, turn in enumerate([np.zeros(len(fps), np.uint64), *_subsets(masks[:, k] & np.uint64(area), weak)]):
                        key = _fold(start, distances(fps[:, k] ^ turn, area, refs[:16]))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), int(n > 0), np.int32)), ids, p0, p1], names=["key", "probe", "id", "p0", "p1"])

    return classes.select("id", "fp", "weak").mapInArrow(run, _PAIR_COLUMNS)


def _near(table: np.ndarray, p0: np.ndarray, p1: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs pass the distance tables, then the fingerprints."""
    keep = np.arange(len(i))
    for c in range(table.shape[1]):
        keep = keep[np.abs(table[i[keep], c].astype(np.int16) - table[j[keep], c]) <= NEAR_BITS]
    bits = np.bitwise_count(p0[i[keep]] ^ p0[j[keep]]) + np.bitwise_count(p1[i[keep]] ^ p1[j[keep]])
    return keep[bits <= 2 * NEAR_BITS]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row that each of ``n`` rows reaches over the links ``i, j``."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if np.array_equal(a, b):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)`` that span the classes of near fingerprints under each key, ``a`` the least id.

    A class under its own key is held against every one under it, own or turned.
    Rows come sorted by key, own ones first, then id. In a group of over
    ``ALL_PAIRS`` comparisons a row that is reached leaves the rest at once, but
    is held against all that are not reached yet; only what is connected already
    is not compared, and ``verified`` compares that in full. Links of many keys
    are thinned to a forest with the same components before they leave the task.
    """
    held, n_held = [], 0
    for rows in sorted_groups(batches, "key"):
        rows = rows.combine_chunks()
        key, probe, ids = (np.asarray(rows.column(c)) for c in ("key", "probe", "id"))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        own = np.add.reduceat((probe == 0).astype(np.int64), starts)
        p0, p1 = (np.asarray(rows.column(c)).view(np.uint64) for c in ("p0", "p1"))
        table = distances(p0, refs=references()[:2])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = sizes * own <= ALL_PAIRS
        for nth in range(int(own[small].max(initial=0))):
            g = np.flatnonzero(small & (own > nth))
            n = sizes[g] - nth - 1
            i = np.repeat(starts[g] + nth, n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = _near(table, p0, p1, i, j)
            left.append(i[ok])
            right.append(j[ok])
        for g in np.flatnonzero(~small):
            rest, queue, owned = np.arange(starts[g], starts[g] + sizes[g]), [], starts[g] + own[g]
            while len(rest) and (queue or rest[0] < owned):
                if queue:
                    x = queue.pop()
                else:
                    x, rest = int(rest[0]), rest[1:]
                others = rest if x < owned else rest[: np.searchsorted(rest, owned)]
                near = _near(table, p0, p1, np.full(len(others), x), others)
                if len(near):
                    left.append(np.full(len(near), x))
                    right.append(others[near])
                    queue.extend(others[near].tolist())
                    rest = np.delete(rest, near)
        root = _roots(len(ids), np.concatenate(left), np.concatenate(right))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        pairs = np.stack([least[root], ids])
        held.append(pairs[:, pairs[0] != pairs[1]])
        n_held += held[-1].shape[1]
        if n_held > FOREST_AT:
            yield _forest(held)
            held, n_held = [], 0
    if n_held:
        yield _forest(held)


def _forest(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Links from the least id of each component of ``pairs`` to its others."""
    ids, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    at = at.reshape(2, -1)
    root = _roots(len(ids), at[0], at[1])
    rest = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[rest]]), pa.array(ids[rest])], names=["a", "b"])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    tokens = text.lower().split()
    joined = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, len(joined)))


def _similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the sets that reach ``similarity``; a linked set leaves the rest at once.

    Each set is held against all by the lists of the sets that have its shingles.
    """
    size = np.array([len(x) for x in sets])
    at = np.r_[0, np.cumsum(size)]
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    count = np.bincount(shingle)
    first = np.cumsum(count) - count
    rest, queue, left, right = np.ones(len(sets), bool), [], [], []
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            own = shingle[at[x] : at[x + 1]]
            n = count[own]
            k = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[k], minlength=len(sets))
            found = np.flatnonzero(rest & (both / np.maximum(size[x] + size - both, 1) >= similarity)).tolist()
            left += [x] * len(found)
            right += found
            queue += found
            rest[found] = False
    return left, right


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links that span what reaches ``similarity`` among the classes that ``pairs`` connect.

    ``classes (id, rep_key)`` names the row whose text stands for a class, in ``texts (rep_key, text)``.

    All sets of a cluster are compared. One with over ``BLOCK`` shingles is dealt
    into blocks, and each two of them meet, so that sets move once a block and not
    once a pair, and none is gathered whole.
    """
    clusters = connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    clusters = cut(clusters.join(classes, "id"))
    side = F.broadcast(clusters) if small_enough(clusters) else clusters

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "cluster", "n", "shingles"])

    members = texts.join(side, "rep_key").select("id", "cluster", "text").dropDuplicates(["id"])  # repeats of one row
    sets = cut(members.mapInArrow(hashed, "id long, cluster long, n long, shingles binary"))
    blocks = sets.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    large = cut(blocks.where("blocks > 1"))
    dealt = sets.join(F.broadcast(large) if small_enough(large) else large, "cluster", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda x: x != F.col("block")))
    met = dealt.withColumn("other", F.explode(others))
    met = met.select(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "key"):
            key, ids = (rows.column(c).to_numpy() for c in ("key", "id"))
            held = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            left, right = [], []
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
                a, b = _similar_forest(held[lo:hi], similarity)
                left += ids[lo:hi][a].tolist() if a else []
                right += ids[lo:hi][b].tolist() if b else []
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return by_key(met, "key", compare, "a long, b long", then=("id",))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, row_key, component_id)``: groups of documents linked at ``similarity`` over word shingles.

    Copies of one sequence of words collapse first, to a class that the least id
    among them stands for; texts that share an id stay apart. The keys are the same
    for any number of texts, and so are the pairs that meet.
    """
    rows = cut(sketches(docs, words, PRINTS, BAND_BITS, WEAK_BITS))
    named = rows.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row_key")).alias("rep"))
    classes = rows.select("digest", "fp", "weak").dropDuplicates(["digest"]).join(named, "digest")
    classes = cut(classes.select(F.xxhash64("digest").alias("id"), "digest", F.col("rep.doc_id").alias("least"), F.col("rep.row_key").alias("rep_key"), "fp", "weak"))
    pairs = by_key(banded(classes, BAND_BITS, WEAK_BITS), "key", _candidates, "a long, b long", then=("probe", "id")).distinct()
    texts = docs.select(row_key().alias("rep_key"), F.col("text").cast("string").alias("text"))
    comps = connected_components(verified(pairs, classes.select("id", "rep_key"), texts, words, similarity))
    placed = classes.join(comps, classes.id == comps.node, "left").select("digest", "least", F.coalesce("component", "id").alias("component"))
    linked = comps.join(classes, comps.node == classes.id).groupBy("component").agg(F.min("least").alias("component_id"))
    group = placed.join(linked, "component", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    return rows.select("doc_id", "row_key", "digest").join(group, "digest", "left").select("doc_id", "row_key", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; its columns stay as they are.

    Of repeated rows one stays. Rows with a null id go if a document with an id
    has the same words.
    """
    groups = cut(similar_groups(docs.select("doc_id", "text"), words, similarity))
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    out = keep_rows(docs, groups.where(~stays), "left_anti")
    repeated = cut(groups.where(stays).groupBy("row_key").count().where("count > 1").select("row_key"))
    if repeated.isEmpty():
        return out
    once = keep_rows(out, repeated, "left_anti")
    return once.unionByName(keep_rows(out, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
