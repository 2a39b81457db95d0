import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tomeflow.llm import simhash

DOCS = "doc_id long, text string, fp string, rep int, lang string"


def frame(spark, rows):
    """Documents with further columns named like the operator's own."""
    return spark.createDataFrame([(i, t, "x", 1, "en") for i, t in rows], DOCS)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_components(fps):
    ids = sorted(fps)
    return union([(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4], ids)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeß É") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(250):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        rows.append((i * 7 % 251, t))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A  b\x0bC"), (1004, "a b c"), (1005, "a b c")]


def test_fingerprints_are_those_of_the_definition(spark):
    rows = corpus()
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(frame(spark, rows)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in rows}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(i) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_components_equal_brute_force(spark):
    rows = corpus()
    wanted = brute_components({i: brute_fingerprint(t) for i, t in rows})
    for limit in (simhash.GROUP_LIMIT, 12, 2):  # with 12, large groups are dealt out again, with 2, into blocks at last
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), group_limit=limit).collect()}
        assert got == wanted


def test_large_clouds_are_spanned(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(200)])
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    edges = [(r.rep, r.other) for r in simhash.links(classes).collect()]
    wanted = union([(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps.astype(np.uint64) ^ np.uint64(fps[i])) <= 4).tolist()], range(len(fps)))
    assert union(edges, range(len(fps))) == wanted
    assert len(edges) < 15 * len(fps)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (5, "a b c d e")]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (5, 2, False)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    if not sets[0] or not sets[1]:
        return float(sets[0] == sets[1])
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def near_copies(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(800)]
    rows = []
    for i in range(160):
        w = [rng.choice(words) for _ in range(rng.randint(80, 200))]
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(max(1, round(len(w) * rng.choice([0.005, 0.015, 0.08])))):
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def test_similar_groups_equal_brute_force(spark, monkeypatch):
    rows = near_copies()
    texts = dict(rows)
    wanted = union([(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8], texts)
    assert len(set(wanted.values())) < len(rows) - 20
    for pairs in (simhash.ALL_PAIRS, 0):
        monkeypatch.setattr(simhash, "ALL_PAIRS", pairs)
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
        assert got == wanted


def test_texts_that_share_an_id_stay_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (3, b + " end"), (9, a + " end"), (9, "other words altogether"), (None, a), (None, "alone")]
    docs = frame(spark, rows)
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.similar_groups(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 3), (3, 3), (9, 5), (9, 9), (0, 5), (0, None)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(docs).collect()) == sorted([(5, a), (3, b + " end"), (9, "other words altogether"), (0, "alone")])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_similar_pairs_at_two_sizes(spark, sf):
    """All pairs of the documents tables at 0.8 by an inverted index, against the groups."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_set((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    holders, shared = {}, {}
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[s].append(i)
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    pairs += [(a, b) for a in sets for b in sets if a < b and not sets[a] and not sets[b]]
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert len(pairs) > 10
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.99 * len(pairs)
    wanted = union(pairs, sets)
    assert all(wanted[i] == wanted[c] for i, c in group.items())  # nothing is grouped that isn't linked


def test_deduplicate_keeps_one_of_each_group(spark):
    text = " ".join(str(i * 37 % 101) for i in range(150))
    rows = [(3, text), (1, text.replace(" 5 ", " five ")), (1, text.replace(" 5 ", " five ")), (7, "other words"), (None, text), (8, None), (9, "")]
    out = simhash.deduplicate(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "rep", "lang"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 7, 8]
    assert simhash.deduplicate(frame(spark, [])).count() == 0


def test_links_in_a_large_group_of_texts_just_below_the_threshold(spark, monkeypatch):
    rng = random.Random(5)
    base, rows = [str(rng.randrange(10**6)) for _ in range(300)], []
    for _ in range(150):
        w = [*base]
        for k in rng.sample(range(300), 6):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    for i in range(50, 100):
        rows.append((len(rows), rows[i][1].rsplit(" ", 1)[0] + " end"))
    texts, n = dict(rows), len(rows)
    wanted = union([(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8], texts)
    assert 40 <= n - len(set(wanted.values())) <= 120
    zero = np.zeros(n, np.int64)  # one key whose fingerprints are all near
    group = pa.RecordBatch.from_arrays([pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(np.arange(n)), pa.array(zero), pa.array(zero)], names=["key", "probe", "id", "p0", "p1"])
    assert n * n > simhash.ALL_PAIRS
    pairs = [p for b in simhash._candidates(iter([group])) for p in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    table = spark.createDataFrame([(str(i), t) for i, t in rows], "rep_key string, text string")
    classes = spark.createDataFrame([(i, str(i)) for i, _ in rows], "id long, rep_key string")
    for block in (1 << 19, 10_000):  # one block, then six
        monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
        found = [(r.a, r.b) for r in simhash.verified(pairs, classes, table, 5, 0.8).collect()]
        assert union(found, texts) == wanted


def test_texts_whose_lines_repeat_differently_have_one_sketch(spark):
    rng = random.Random(6)
    body, line = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (200, 12))
    rows = [(i, " ".join(body + line * n)) for i, n in enumerate((2, 20, 60))]
    assert jaccard(rows[0][1], rows[2][1]) == 1
    once, often, oftener = (simhash._sketch(t.encode(), 5, 2, 16, 4)[1:] for _, t in rows)
    assert once == often == oftener
    assert {r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()} == {0}


def test_pairs_that_meet_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(0, 300, 2):
        w = [f"w{rng.randrange(10**9)}" for _ in range(64)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-6] + [f"v{k}" for k in rng.sample(range(10**9), 6)]))]
    assert all(0.8 <= jaccard(rows[i][1], rows[i + 1][1]) < 0.83 for i in range(0, 300, 2))
    docs = frame(spark, rows)
    few = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect())
    monkeypatch.setattr(type(docs), "count", lambda self: 1 << 24)
    many = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect())
    assert few == many
    assert sum(i != c for i, c in few) >= 147


def test_links_of_many_keys_leave_a_task_as_a_forest():
    n, keys = 50, 3
    zero = np.zeros(n * keys, np.int64)
    group = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(keys), n)), pa.array(zero.astype(np.int32)), pa.array(np.tile(np.arange(n), keys)), pa.array(zero), pa.array(zero)], names=["key", "probe", "id", "p0", "p1"])
    pieces = [group.slice(i, n) for i in range(0, n * keys, n)]
    pairs = [p for b in simhash._candidates(iter(pieces)) for p in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert sorted(pairs) == [(0, i) for i in range(1, n)]
