import random

import numpy as np
import pytest

from tomeflow.llm import suffix_dedup, suffix_sort


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        t = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert suffix_sort.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(5)]
    docs = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(words) + p[k + 3 :]
            k = rng.randrange(len(t) + 1)
            t = t[:k] + p + t[k:]
        if rng.random() < 0.15:
            t = rng.choice(["For ", "a", "xy"]) * rng.randint(10, 80)
        if docs and rng.random() < 0.15:
            t = rng.choice(docs)[1]
        docs.append((i, t))
    return docs


def brute(docs):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, t in raw:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in raw:
        cover = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                cover[k + 1 : k + 51] = True
        edge = np.flatnonzero(np.diff(cover.astype(np.int8)))
        spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out[i] = (len(t), spans, bytes(c for c, gone in zip(t, cover[1:], strict=False) if not gone))
    return out


def mine(spark, docs, **options):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, md5 int")
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.deduplicate(rows, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}, {"hot": 2, "block_bytes": 2000}])
def test_removal_equals_brute_force(spark, options):
    docs = corpus(5)
    assert mine(spark, docs, **options) == brute(docs)


def test_a_frequent_phrase_in_distinct_surroundings(spark):
    """Hot anchors: windows are dealt singly, and the phrase itself goes from all but the first document."""
    rng = random.Random(7)
    junk = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    docs = [(i, junk(rng.randint(0, 90)) + ("The one phrase that stands in each of these texts, whatever is around it." if i % 3 else "of 26 bytes, too short, it ") + junk(rng.randint(0, 90))) for i in range(300)]
    docs += [(300 + i, "x" * 120 + junk(40)) for i in range(20)]
    assert mine(spark, docs, hot=20, block_bytes=3000) == mine(spark, docs) == brute(docs)


def test_window_hashes():
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8)
    got = suffix_dedup.window_hashes(np.r_[data, data], np.array([3, 403, 4]))
    assert got[0] == got[1] != got[2]


def test_whole_groups_and_large_groups_agree(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MERGED", 1)
    docs = corpus(6)
    assert mine(spark, docs) == brute(docs)


def test_long_texts_are_cut_into_pieces():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(np.array([0, 5000]), data)
    old = suffix_dedup.PIECE
    try:
        suffix_dedup.PIECE = 700
        parts = suffix_dedup.anchors(np.array([0, 5000]), data)
    finally:
        suffix_dedup.PIECE = old

    def by_window(found):
        _, lo, hi, anchor, _ = found
        return {w: int(a) for x, y, a in zip(lo, hi, anchor, strict=True) for w in range(x, y + 1)}

    assert by_window(whole) == by_window(parts)
    assert set(by_window(whole)) == set(range(5000 - 49))


def test_nulls_short_texts_and_repeated_rows(spark):
    same = "0123456789" * 7
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "short"), (None, same), (5, same), (5, same), (6, same)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.deduplicate(rows).collect())
    assert got == [(0, 70, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0), (4, 5, 0, 0), (5, 70, 0, 0), (5, 70, 0, 0), (6, 70, 70, 1)]
    assert suffix_dedup.deduplicate(rows.limit(0)).count() == 0
