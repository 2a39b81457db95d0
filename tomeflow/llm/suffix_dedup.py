"""Removal of repeated substrings, found by suffix arrays that grow with the repeats only.

Every byte covered by a string of ``MATCH`` bytes that also starts in a document
with a smaller id is removed. A window is a string of ``MATCH`` bytes.

1. Copies of a whole text go first: all but the smallest id lose everything.
2. Each window picks an anchor, the gram of ``GRAM`` bytes in it with the least
   hash (the rightmost of equals). Equal windows pick equal grams at the same
   place, so a window can only repeat if its anchor does. Consecutive windows
   with one anchor form a chunk.
3. Anchors' hashes are counted by hash bucket; those seen once in the corpus are
   done with. The chunks of the others, equal ones of a block of documents sent
   once, meet by anchor.
4. Chunks of an anchor are laid over each other at the anchor. Columns between
   which no pair of chunks starts or ceases to agree become one symbol, and a
   suffix array by linear Lyndon grouping (``suffix_sort``) orders the suffixes of
   these sequences. A run of suffixes that agree over all symbols of a window is
   that string's occurrences, and their least id decides.
5. The covered byte ranges return to their documents.

An anchor with over ``hot`` occurrences doesn't gather its chunks in one task:
its windows are dealt singly, by the hash of their bytes, equal ones of a block
once.

Hashes travel in a row for each block and bucket that meet; with so many blocks
that such a row holds one hash, this is a shuffle on the hash.

Nulls and edges: null text is empty; texts under ``MATCH`` bytes stay whole; rows
with a null id neither lose bytes nor make others lose any, and are dealt nowhere;
repeated rows and rows of one id don't remove each other, as no id is smaller;
matches never cross documents; columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.llm.common import binary_parts, cut, small_enough, text_or_empty
from tomeflow.llm.suffix_sort import suffix_array

MATCH = 50
GRAM = 24
GRAMS = MATCH - GRAM + 1  # in a window
WIDTH = MATCH + GRAMS - 1  # columns that windows of one anchor can reach
BLOCK_BYTES = 8 << 20
SLICE = 1 << 18
PIECE = 1 << 21
PLACE_BITS = 22
HOT = 20_000
#: Blocks whose hashes share a bucket on average.
BLOCKS_A_BUCKET = 8
#: Groups of chunks up to this size have their columns merged by how the chunks agree.
MERGED = 48
SYMBOLS_AT_ONCE = 24_000
ABSENT = 0xFF  # in no UTF-8 text

_RANDOM = np.random.Generator(np.random.PCG64(11))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each position of ``data``."""
    x = _BYTE[data]
    kept, size, level = {}, 1, 0
    while True:
        kept[size] = x
        if size * 2 > GRAM:
            break
        x = x[:-size] * _ODD[level] + x[size:]
        size, level = size * 2, level + 1
    while size < GRAM:
        more = max(s for s in kept if size + s <= GRAM)
        n = len(x) - more
        x = x[:n] * _ODD[7] + kept[more][size : size + n]
        size += more
    return x * _ODD[6]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def _slice_anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of the texts that ``bounds`` cuts ``data`` into: text, first and last window, anchor, hash."""
    h = gram_hashes(data)
    at = np.arange(len(h), dtype=np.uint64)
    least = _least((h & ~_PLACE) | (_PLACE - at), GRAMS)
    place = (_PLACE - (least & _PLACE)).astype(np.int32)
    n = len(place)
    inside = np.ones(n + 1, bool)
    for end in bounds[1:]:
        inside[max(0, end - MATCH + 1) : end] = False
    inside = inside[:n]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(place[1:], place[:-1], out=first[1:])
    starts = bounds[:-1]
    first[starts[(starts < n)]] = True
    first &= inside
    lo = np.flatnonzero(first)
    text = np.searchsorted(bounds, lo, side="right") - 1
    limit = bounds[text + 1] - MATCH
    hi = np.minimum(np.r_[lo[1:] - 1, n - 1][: len(lo)], limit)
    anchor = place[lo]
    return text, lo, hi, anchor, h[anchor]


def anchors(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, lo, hi, anchor, hash)`` of the chunks of all texts; places are within the text."""
    sizes = np.diff(offsets)
    out = []
    i, n = 0, len(sizes)
    ends = offsets[1:]
    while i < n:
        if sizes[i] > PIECE:
            for a in range(0, int(sizes[i]) - MATCH + 1, PIECE):
                b = min(int(sizes[i]), a + PIECE + MATCH - 1)
                _, lo, hi, anchor, h = _slice_anchors(raw[offsets[i] + a : offsets[i] + b], np.array([0, b - a]))
                out.append((np.full(len(lo), i), lo + a, hi + a, anchor + a, h))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, offsets[i] + SLICE, side="right")))
        while j > i + 1 and sizes[j - 1] > PIECE:
            j -= 1
        big = np.flatnonzero(sizes[i:j] > PIECE)
        j = i + int(big[0]) if len(big) else j
        if offsets[j] - offsets[i] >= MATCH:
            text, lo, hi, anchor, h = _slice_anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            base = (offsets[i : j + 1] - offsets[i])[text]
            out.append((text + i, lo - base, hi - base, anchor - base, h))
        i = j
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bucket_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the hash's lower half below it."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_COUNTS = "block int, bucket int, hashes binary, counts binary"


def hashes_of_blocks(buckets: int):
    """Each block's anchor hashes by bucket, with how often they occur in the batch (up to 65,535)."""

    def run(batches):
        for b in batches:
            offsets, raw = binary_parts(b.column(2))
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            blocks = np.asarray(b.column(0))
            text, *_, h = anchors(offsets, raw)
            ok = known[text]
            owner, key = blocks[text[ok]], _bucket_keys(h[ok], buckets)
            out = ([], [], [], [])
            for block in np.unique(owner):
                keys, counts = np.unique(key[owner == block], return_counts=True)
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                low, counts = keys.astype(np.uint32), np.minimum(counts, 65_535).astype(np.uint16)
                for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
                    for column, value in zip(out, (int(block), int(bucket[lo]), _blob(low[lo:hi]), _blob(counts[lo:hi])), strict=True):
                        column.append(value)
            if out[0]:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["block", "bucket", "hashes", "counts"])

    return run


def repeated_hashes(hot: int):
    """Of a bucket: to each block those of its hashes that occur again, and which of them are hot."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in rows.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("counts").to_pylist()])
        found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, counts, minlength=len(found))[inverse]
        again, is_hot = total > 1, total > hot
        ends = np.cumsum([len(p) for p in parts])
        out, hots = [], []
        for p, end in zip(parts, ends, strict=True):
            s = slice(end - len(p), end)
            out.append(_blob(p[again[s]]))
            hots.append(_blob(p[is_hot[s]]))
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "hashes": pa.array(out, pa.binary()), "hot": pa.array(hots, pa.binary())})

    return run


def _members(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys


def _in_order(ids: pa.ChunkedArray, texts: pa.ChunkedArray) -> np.ndarray:
    """Rows of a block by id, then text, so that every pass numbers them alike; null ids last."""
    ids, texts = ids.to_pylist(), texts.to_pylist()
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i])), np.int64)


def _block_of(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    order = _in_order(rows.column("doc_id"), rows.column("text"))
    rows = rows.take(pa.array(order))
    offsets, raw = binary_parts(rows.column("text"))
    return rows.column("doc_id").to_pylist(), offsets, raw


_CHUNKS = "bucket int, block int, kind int, gkey binary, doc binary, row binary, place binary, windows binary, rel binary, data binary"


def _chunk_rows(buckets: int, block: int, gkey, doc, row, place, windows, rel, data: list[bytes], covered: list[tuple[int, int, int]]) -> pa.Table:
    out = []
    if len(gkey):
        bucket = (gkey % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            k = order[lo:hi]
            out.append((int(bucket[k[0]]), block, 0, _blob(gkey[k]), _blob(doc[k]), _blob(row[k]), _blob(place[k]), _blob(windows[k]), _blob(rel[k]), b"".join([data[i] for i in k.tolist()])))
    if covered:
        c = np.array(covered, np.int32)
        out.append((block % buckets, block, 1, b"", b"", _blob(c), b"", b"", b"", b""))
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 7
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def chunks_of_block(count_buckets: int, buckets: int):
    """Chunks of a block whose anchor repeats; a chunk equal to one of a smaller id in the block is covered at once."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not rows.num_rows or not replies.num_rows:
            return _chunk_rows(buckets, 0, empty.astype(np.uint64), *[empty] * 5, [], [])
        block = rows.column("block")[0].as_py()

        def keys_of(name: str) -> np.ndarray:
            parts = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for x, b in zip(replies.column(name).to_pylist(), replies.column("bucket").to_pylist(), strict=True)]
            return np.unique(np.concatenate(parts))

        again, hot = keys_of("hashes"), keys_of("hot")
        ids, offsets, raw = _block_of(rows)
        text, lo, hi, anchor, h = anchors(offsets, raw)
        keys = _bucket_keys(h, count_buckets)
        ok = _members(keys, again) & np.array([i is not None for i in ids], bool)[text]
        text, lo, hi, anchor, h, keys = (x[ok] for x in (text, lo, hi, anchor, h, keys))
        data = raw.tobytes()
        covered: list[tuple[int, int, int]] = []

        def sent_once(text, lo, hi, h) -> np.ndarray:
            """The first of equal chunks; the others of larger ids are covered."""
            first: dict[tuple[int, bytes], int] = {}
            sent = []
            for i, (a, b, t, key) in enumerate(zip((offsets[text] + lo).tolist(), (offsets[text] + hi + MATCH).tolist(), text.tolist(), h.tolist(), strict=True)):
                if first.setdefault((key, data[a:b]), ids[t]) < ids[t]:
                    base = int(offsets[t])
                    if covered and covered[-1][0] == t and covered[-1][1] <= a - base <= covered[-1][2]:
                        covered[-1] = (t, covered[-1][1], max(covered[-1][2], b - base))
                    else:
                        covered.append((t, a - base, b - base))
                else:
                    sent.append(i)
            return np.array(sent, np.int64)

        k = sent_once(text, lo, hi, h)
        text, lo, hi, anchor, h, keys = (x[k] for x in (text, lo, hi, anchor, h, keys))
        if len(hot) and (single := _members(keys, hot)).any():
            # windows of hot anchors singly, under a key of their own bytes
            n = (hi - lo + 1)[single]
            src = np.repeat(np.flatnonzero(single), n)
            at = lo[src] + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
            key = window_hashes(raw, offsets[text[src]] + at)
            k = sent_once(text[src], at, at, key)
            rest = ~single
            text, lo, hi, anchor, h = (np.r_[x[rest], y[k]] for x, y in ((text, text[src]), (lo, at), (hi, at), (anchor, at), (h, key)))
        begin, end = (offsets[text] + lo).tolist(), (offsets[text] + hi + MATCH).tolist()
        cuts = [data[a:b] for a, b in zip(begin, end, strict=True)]
        doc = np.array([ids[t] for t in text.tolist()], np.int64)
        return _chunk_rows(buckets, block, h, doc, text.astype(np.int32), lo.astype(np.int32), (hi - lo + 1).astype(np.uint8), (anchor - lo).astype(np.uint8), cuts, covered)

    return run


def window_hashes(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the window at each place of ``raw``."""
    out = np.zeros(len(begin), np.uint64)
    for lo in range(0, len(begin), SLICE):
        rows = np.zeros((len(begin[lo : lo + SLICE]), -(-MATCH // 8) * 8), np.uint8)
        rows[:, :MATCH] = raw[begin[lo : lo + SLICE, None] + np.arange(MATCH)]
        x = np.zeros(len(rows), np.uint64)
        for w in rows.view(np.uint64).T:
            x = (x ^ w) * _ODD[5]
            x ^= x >> np.uint64(31)
        out[lo : lo + SLICE] = x
    return out


def _merge_columns(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(agree, cut)``: names of equal bytes in a column of a group, and where a new symbol starts in it.

    In groups up to ``MERGED`` the name is the first chunk with that byte, and
    columns are cut where any name changes; in larger ones the name is the byte,
    and only columns on which all agree are merged.
    """
    n, width = rows.shape
    nth = np.arange(n) - np.repeat(starts, sizes)
    small = sizes <= MERGED
    few = np.repeat(small, sizes)
    agree = rows.astype(np.int16)
    agree[few] = nth[few, None]
    for back in range(1, int(sizes[small].max()) if small.any() else 0):
        i = np.flatnonzero(few & (nth >= back))
        same = rows[i] == rows[i - back]
        part = agree[i]
        np.copyto(part, (nth[i] - back).astype(np.int16)[:, None], where=same)
        agree[i] = part
    change = np.zeros((n, width), bool)
    change[:, 1:] = agree[:, 1:] != agree[:, :-1]
    cut = np.logical_or.reduceat(change, starts, axis=0)
    if not small.all():
        other = rows != rows[np.repeat(starts, sizes)]
        differs = np.logical_or.reduceat(other, starts, axis=0)
        big = ~small
        edge = differs.copy()
        edge[:, 1:] |= differs[:, :-1]
        cut[big] = edge[big]
        name = agree[~few]
        name[~np.repeat(differs[big], sizes[big], axis=0)] = 0
        agree[~few] = name
    cut[:, 0] = True
    return agree, cut


def covered_windows(rows: np.ndarray, group: np.ndarray, doc: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows of each chunk also start under a smaller id; ``rows`` are aligned chunks sorted by ``group``.

    ``first`` is the column of a chunk's first window; the result has a row per
    chunk and a column per window.
    """
    n = len(rows)
    out = np.zeros((n, GRAMS), bool)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    agree, cut = _merge_columns(rows, starts, sizes)
    number = np.cumsum(cut, axis=1) - 1  # of each column's symbol, by group
    of_group = np.repeat(np.arange(len(starts)), sizes)
    number = number[of_group]
    last = first + windows.astype(np.int64) + MATCH - 2
    row_at = np.arange(n)
    b_first, b_last = number[row_at, first], number[row_at, last]
    length = b_last - b_first + 2  # and a separator
    total = np.cumsum(length)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + SYMBOLS_AT_ONCE, side="right")))
        while hi < n and of_group[hi] == of_group[hi - 1]:  # a group stays together
            hi += 1
        s = slice(lo, hi)
        out[s] = _covered(agree[s], cut[of_group[s]], number[s], of_group[s], doc[s], first[s], windows[s], b_first[s], length[s])
        lo = hi
    return out


def _covered(agree, cut, number, of_group, doc, first, windows, b_first, length) -> np.ndarray:
    n = len(agree)
    start = np.cumsum(length) - length
    text = np.zeros(int(length.sum()), np.int64)
    i, c = np.nonzero(cut | (np.arange(cut.shape[1])[None, :] == first[:, None]))  # where a symbol starts, or the chunk in it
    at = number[i, c] - b_first[i]
    ok = (at >= 0) & (at < length[i] - 1) & (c >= first[i])
    i, c, at = i[ok], c[ok], at[ok]
    name = (of_group[i] * (WIDTH + 1) + number[i, c]) * 1024 + agree[i, c] + 1
    text[start[i] + at] = np.unique(name, return_inverse=True)[1] + 1
    order = np.array(suffix_array(text.tolist()), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    window = np.arange(GRAMS)
    valid = window[None, :] < windows[:, None]
    wi, wr = np.nonzero(valid)
    col = first[wi] + wr
    b, e = number[wi, col], number[wi, col + MATCH - 1]
    need = e - b + 1
    at = rank[start[wi] + b - b_first[wi]]

    deepest = int(need.max())
    common = np.zeros(len(order) - 1, np.int64)
    live = np.arange(len(order) - 1)
    left, right = order[:-1], order[1:]
    for t in range(deepest):
        live = live[(left[live] + t < len(text)) & (right[live] + t < len(text))]
        live = live[text[left[live] + t] == text[right[live] + t]]
        if not len(live):
            break
        common[live] = t + 1
    owner = np.repeat(np.arange(n), length)
    doc_in_order = doc[owner[order]]
    out = np.zeros((n, GRAMS), bool)
    for size in np.unique(need):
        runs = np.r_[0, np.cumsum(common < size)]
        heads = np.flatnonzero(np.r_[True, common < size])
        least = np.minimum.reduceat(doc_in_order, heads)
        k = need == size
        out[wi[k], wr[k]] = least[runs[at[k]]] < doc[wi[k]]
    return out


def resolve_bucket(rows: pa.Table) -> pa.Table:
    """Covered byte ranges of the chunks of a bucket, by block."""
    blocks, kinds = rows.column("block").to_pylist(), rows.column("kind").to_pylist()
    ranges: dict[int, list[np.ndarray]] = {}
    gkey, doc, row, place, windows, rel, block, pieces = ([] for _ in range(8))
    for i, (b, kind) in enumerate(zip(blocks, kinds, strict=True)):
        col = {c: rows.column(c)[i].as_py() for c in ("gkey", "doc", "row", "place", "windows", "rel", "data")}
        if kind == 1:
            ranges.setdefault(b, []).append(np.frombuffer(col["row"], np.int32).reshape(-1, 3))
            continue
        gkey.append(np.frombuffer(col["gkey"], np.uint64))
        doc.append(np.frombuffer(col["doc"], np.int64))
        row.append(np.frombuffer(col["row"], np.int32))
        place.append(np.frombuffer(col["place"], np.int32))
        windows.append(np.frombuffer(col["windows"], np.uint8))
        rel.append(np.frombuffer(col["rel"], np.uint8))
        block.append(np.full(len(gkey[-1]), b))
        data, at = col["data"], 0
        for w in windows[-1].tolist():
            pieces.append(data[at : at + w + MATCH - 1])
            at += w + MATCH - 1
    if gkey:
        gkey, doc, row, place, windows, rel, block = (np.concatenate(x) for x in (gkey, doc, row, place, windows, rel, block))
        # equal chunks: the least id stands for all, the others are covered whole
        number: dict[tuple[int, int, bytes], int] = {}
        keys = zip(gkey.tolist(), rel.tolist(), pieces, strict=True)
        same = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(pieces))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        whole = doc > least[same]
        begin = [np.stack([row[whole], place[whole], place[whole] + windows[whole].astype(np.int32) + MATCH - 1], axis=1)]
        owner = [block[whole]]

        one = np.full(len(number), -1, np.int64)
        own = np.flatnonzero(~whole)
        one[same[own]] = own
        k = one[np.argsort(gkey[one], kind="stable")]
        g = gkey[k]
        lonely = np.r_[True, g[1:] != g[:-1]] & np.r_[g[1:] != g[:-1], True]
        k = k[~lonely]
        if len(k):
            laid = np.full((len(k), WIDTH), ABSENT, np.uint8)
            first = (GRAMS - 1) - rel[k].astype(np.int64)
            for i, j in enumerate(k.tolist()):
                p = pieces[j]
                laid[i, first[i] : first[i] + len(p)] = np.frombuffer(p, np.uint8)
            hit = covered_windows(laid, gkey[k], doc[k], first, windows[k])
            some = hit.any(axis=1)
            by_chunk = np.full(len(number), -1, np.int64)
            by_chunk[same[k[some]]] = np.flatnonzero(some)
            at = own[by_chunk[same[own]] >= 0]  # every place of the chunk under its least id
            runs = hit[by_chunk[same[at]]].astype(np.int8)
            edge = np.diff(np.pad(runs, ((0, 0), (1, 1))), axis=1)
            i, lo = np.nonzero(edge == 1)
            _, hi = np.nonzero(edge == -1)
            begin.append(np.stack([row[at[i]], place[at[i]] + lo.astype(np.int32), place[at[i]] + hi.astype(np.int32) + MATCH - 1], axis=1))
            owner.append(block[at[i]])
        begin, owner = np.concatenate(begin).astype(np.int32), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        begin, owner = begin[order], owner[order]
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
        for lo, hi in zip(heads, np.r_[heads[1:], len(owner)] if len(owner) else [], strict=True):
            ranges.setdefault(int(owner[lo]), []).append(begin[lo:hi])
    out = [(b, _blob(np.concatenate(x))) for b, x in ranges.items()]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "ranges": pa.array([x for _, x in out], pa.binary())})


def _united(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of byte ranges sorted by start."""
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.r_[True, ranges[1:, 0] > ends[:-1]]
    lo = ranges[new, 0]
    hi = ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ranges) - 1]]
    return np.stack([lo, hi], axis=1)


def removed_from_block(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Each row of a block with its removed spans and the bytes that remain."""
    ids, offsets, raw = _block_of(rows)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spans: list[list] = [[] for _ in ids]
    kept = [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    parts = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in found.column("ranges").to_pylist()]
    if parts:
        every = np.concatenate(parts)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        heads = np.flatnonzero(np.r_[True, every[1:, 0] != every[:-1, 0]]) if len(every) else []
        for lo, hi in zip(heads, np.r_[heads[1:], len(every)] if len(every) else [], strict=True):
            i = int(every[lo, 0])
            united = _united(every[lo:hi, 1:]).tolist()
            spans[i] = [{"start": a, "end": b} for a, b in united]
            text, at, out = kept[i], 0, []
            for a, b in united:
                out.append(text[at:a])
                at = b
            kept[i] = b"".join([*out, text[at:]])
    sizes = np.diff(offsets)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, span_type), "kept": pa.array(kept, pa.binary())})


_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def deduplicate(docs: DataFrame, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, spans, kept)``, one row per input row; spans are the maximal removed runs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("md5", F.md5(F.col("text").cast("binary")))
    size = F.octet_length("text").cast("long")
    copies = rows.where((size >= MATCH) & F.col("doc_id").isNotNull()).groupBy("md5").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("md5", "least")
    copies = cut(copies)
    marked = rows.join(F.broadcast(copies) if small_enough(copies) else copies, "md5", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    total = rows.agg(F.sum(size)).first()[0] or 0
    blocks = max(8, -(-total // block_bytes))
    buckets, count_buckets = blocks, max(8, blocks // BLOCKS_A_BUCKET)

    block = F.pmod(F.xxhash64("doc_id", "md5"), F.lit(blocks)).cast("int")
    dealt = marked.where("not copy and doc_id is not null").select(block.alias("block"), "doc_id", "text").repartition("block")
    seen = dealt.mapInArrow(hashes_of_blocks(count_buckets), _COUNTS)
    again = seen.groupBy("bucket").applyInArrow(repeated_hashes(hot), "block int, bucket int, hashes binary, hot binary")
    chunks = dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(chunks_of_block(count_buckets, buckets), _CHUNKS)
    found = chunks.groupBy("bucket").applyInArrow(resolve_bucket, "block int, ranges binary")
    kept = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(removed_from_block, _RESULT)

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    gone = marked.where("copy").select("doc_id", size.alias("n_bytes"), whole.alias("spans"), F.lit(b"").alias("kept"))
    nameless = rows.where("doc_id is null").select("doc_id", size.alias("n_bytes"), F.slice(whole, 1, 0).alias("spans"), F.col("text").cast("binary").alias("kept"))
    out = kept.unionByName(gone).unionByName(nameless)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
