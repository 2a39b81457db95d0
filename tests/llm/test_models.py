"""Mixing, the n-gram model, archive revisits, NN-descent and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, rows_of
from tomeflow.llm import mixing, ngram_lm, nndescent, queries, warc

# --- mixing ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert rows_of(queries.QUERIES[name](spark, small)) == duck_rows(queries.ORACLE_SQL[name], small)


def sources(spark, n=400):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}", 1) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "big", 1), (n + 1, "", None, 1), (n + 2, "x y", None, 1)], "doc_id long, text string, source string, tokens int")


def test_mixture_meets_its_entropy_and_quotas(spark):
    docs = sources(spark)
    plan = mixing.plan(docs, budget=5000, entropy_share=0.9).collect()
    drawn = Counter()
    for r in plan:
        drawn[r.source] += r.tokens
    total = sum(drawn.values())
    assert 5000 - 7 * len(drawn) <= total <= 5000
    entropy = -sum(v / total * math.log(v / total) for v in drawn.values())
    assert abs(entropy / math.log(len(drawn)) - 0.9) < 0.02
    size = defaultdict(Counter)
    for r in plan:
        size[r.source][r.pass_no, r.doc_id] += 1
    for of_source in size.values():
        assert set(of_source.values()) == {1}  # a document once in each pass
        passes = Counter(p for p, _ in of_source)
        assert all(passes[p] >= passes[p + 1] for p in range(max(passes)))


def test_mixture_holds_a_repetition_limit(spark):
    docs = sources(spark)
    plan = mixing.plan(docs, budget=3000, max_repeats=2.0)
    worst = plan.groupBy("source").agg(F.max("pass_no").alias("p")).agg(F.max("p")).first()[0]
    assert worst <= 2
    assert mixing.plan(docs.limit(0)).count() == 0
    assert {r.source for r in mixing.plan(docs.where("source is null")).collect()} == {""}


def test_mixed_keeps_the_columns(spark):
    out = mixing.mixed(sources(spark).drop("tokens"))
    assert out.columns == ["doc_id", "text", "source", "pass_no", "block_rank", "slot", "order_key"]
    assert out.where("text is null").count() == 0


def ids_of(rows):
    return Counter((r.doc_id, r.pass_no, r.slot) for r in rows)


@pytest.mark.parametrize("budget", [300, 777, 2000])
def test_mixed_has_the_draws_of_the_plan(spark, budget):
    """Repeated ids, null ids, repeated rows and clashing names; blocks are few, so some are taken in part."""
    rows = [(i % 40 if i % 5 else None, "w " * (1 + i % 9), "a" if i % 4 else None, i, "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, *[(7, "same same", "a", 0, "x")] * 30, (8, "word " * 5000, "b", 0, "x")], "doc_id long, text string, source string, slot int, pass_no string")
    plan = mixing.plan(docs, budget=budget, blocks=3).collect()
    out = mixing.mixed(docs, budget=budget, blocks=3)
    assert out.columns == ["doc_id", "text", "source", "slot", "pass_no", "_pass_no", "block_rank", "_slot", "order_key"]
    assert ids_of(plan) == Counter((r.doc_id, r._pass_no, r._slot) for r in out.collect())
    assert sum(r.tokens for r in plan) == sum(len(r.text.split()) for r in out.collect()) <= budget


def test_a_repetition_limit_that_cannot_be_met_is_an_error(spark):
    with pytest.raises(ValueError, match="passes"):
        mixing.plan(sources(spark), budget=60_000, max_repeats=2)
    one = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="passes"):
        mixing.plan(one, budget=20, max_repeats=3)
    assert mixing.plan(one, budget=20, max_repeats=10).count() == 10


# --- n-gram model ---


def plain_model(texts):
    """Interpolated modified Kneser-Ney by its definition."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        t = "\2\2\2" + t
        counts[4].update(t[i : i + 4] for i in range(len(t) - 3))
    for k in (3, 2, 1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discounts = [None] * 5
    for k in range(1, 5):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        discounts[k] = [0.0] + [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]

    def p(context, ch):
        if context is None:
            return 1 / (len(counts[1]) + 1)
        k = len(context) + 1
        lower = p(context[1:] if context else None, ch)
        follow = {g: c for g, c in counts[k].items() if g[:-1] == context}
        if not follow:
            return lower
        d = lambda c: discounts[k][min(c, 3)]
        total = sum(follow.values())
        weight = max(sum(min(d(c), c) for c in follow.values()), 1e-9) / total
        c = follow.get(context + ch, 0)
        return max(c - d(c), 0) / total + weight * lower

    return p


@pytest.mark.parametrize("block_bytes", [64, 1 << 24])
def test_perplexity_equals_the_definition(spark, block_bytes):
    good = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on the mat", "it", "the cat and the mat", "sat on a dog", "and it sat"]
    test = [*good, "the zebra", "qq", "t", "", None, "cat  \n mat 42", "\u4e2d\U0001f600 the", "the " * 3000]
    docs = spark.createDataFrame([(i, t, "en", 1.0) for i, t in enumerate(test)] + [(None, "the cat", None, 1.0)] * 2, "doc_id long, text string, lang string, low double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(0, 1, None), (9, 0, 0), (10, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    fold = lambda t: zlib.crc32((t or "").encode()) % 2
    models = [plain_model([t for t in good if fold(t) != f]) for f in (0, 1)]
    assert len({fold(t) for t in good}) == 2
    rows = ngram_lm.classify(docs, labels, block_bytes=block_bytes).collect()
    assert len(rows) == len(test) + 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate([*test, "the cat"]):
        plain, r = " ".join((t or "").split(" ")) if t == "the " * 3000 else " ".join((t or "").split()).replace("42", "00"), got[i if i < len(test) else None]
        if not plain:
            assert (r.perplexity, r.worst, r.kept) == (None, None, False)
            continue
        padded = "\2\2\2" + plain.replace("\U0001f600", chr(0xD800 + 0x1F600 % 0x2100))
        logs = [math.log(models[fold(t)](padded[j : j + 3], padded[j + 3])) for j in range(len(plain) if len(plain) < 9000 else 0)]
        if logs:
            assert math.isclose(math.log(r.perplexity), -sum(logs) / len(logs), rel_tol=1e-9), t
            worst = min(sum(logs[j : j + 8]) / len(logs[j : j + 8]) for j in range(max(1, len(logs) - 7)))
            assert math.isclose(math.log(r.worst), -worst, rel_tol=1e-9), t
    assert all(got[i].kept for i in range(8))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "text", None), (1, "text", None), (None, "text", "xx"), (2, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.kept) for r in ngram_lm.classify(docs, labels).collect())
    assert got == [(0, True), (1, True), (1, True), (2, False)]
    assert ngram_lm.classify(docs.limit(0), labels).count() == 0
    assert ngram_lm.keep_good(docs, labels).columns == docs.columns
    assert ngram_lm.keep_good(docs, labels).count() == 3


def test_noise_goes_and_clean_text_stays(spark):
    """On the tables of sf0.1: labelled clean text, held out of its model, and English toxic text, which has words that no clean text has."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = ngram_lm.classify(docs, labels).join(labels, "doc_id")
    rates = {(r.quality, r.toxic, r.en): r.kept for r in judged.groupBy("quality", "toxic", (F.col("lang") == "en").alias("en")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert min(rates[1, 0, True], rates[1, 0, False]) > 0.99
    assert max(rates[0, 0, True], rates[0, 0, False]) < 0.05
    assert rates[1, 1, True] < 0.05


# --- revisits ---

RECORD = "record_id long, url string, at timestamp, kind string, headers map<string,string>, payload string, status int"


def test_revisits(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [
        (1, "http://www.A.com/x/#f", t(0), "response", {"ETag": 'W/"a"', "Content-Length": "9", "X": "1", "Date": "d0"}, "p1"),
        (2, "https://a.com/x?utm_source=q", t(50), "revisit", {"etag": '"a"', "DATE": "d1", "Content-Length": "0"}, None),
        (3, "a.com/x", t(51), "response", {"etag": '"b"'}, "p3"),
        (4, "a.com/x", t(51), "revisit", {"etag": '"a"'}, None),
        (5, "a.com/x", t(52), "revisit", {"etag": '"a"'}, None),
        (6, "a.com/x", t(53), "revisit", {"date": "d"}, None),
        (7, "a.com/y", t(53), "revisit", {}, None),
        (8, None, t(53), "revisit", None, None),
        (9, "a.com/x", None, "revisit", {"etag": '"b"'}, None),
        (10, "a.com/z?b=2&a=1", t(1), "response", {"Last-Modified": "m"}, "p10"),
        (11, "a.com/z?a=1&b=2&ref=x", t(200), "revisit", {"last-modified": "m", "ETAG": None}, None),
        (11, "a.com/z?a=1&b=2&ref=x", t(200), "revisit", {"last-modified": "m", "ETAG": None}, None),
    ]
    frame = spark.createDataFrame([(*r, 0) for r in rows], RECORD)
    for span in (3600, warc.SPAN_SECONDS, 10**7):
        found = warc.resolve(frame, span).collect()
        got = {r.record_id: (r.status, r.resolved_id, r.payload) for r in found}
        assert got == {
            2: ("resolved", 1, "p1"), 4: ("resolved", 1, "p1"), 5: ("validator_mismatch", None, None), 6: ("no_validator", 3, None), 7: ("no_earlier_response", None, None),
            8: ("no_earlier_response", None, None), 9: ("no_earlier_response", None, None), 11: ("resolved", 10, "p10"),
        }
        assert len(found) == 9
        assert next(r.headers for r in found if r.record_id == 2) == {"etag": '"a"', "content-length": "9", "x": "1", "date": "d1"}
    assert warc.resolve(frame.limit(0)).count() == 0
    dates = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994"]
    pairs = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in dates for b in [*dates, "Sun, 06 Nov 1994 08:49:38 GMT", "yesterday"]])] + [(99, "yesterday", "yesterday")]
    rows = [r for i, a, b in pairs for r in ((2 * i, f"b.com/{i}", t(0), "response", {"Last-Modified": a}, "p", 0), (2 * i + 1, f"b.com/{i}", t(1), "revisit", {"last-modified": b}, None, 0))]
    got = {r.record_id // 2: r.status for r in warc.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {i: "resolved" if b in dates or b == a else "validator_mismatch" for i, a, b in pairs}


# --- NN-descent ---


def cloud(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 16))
    near = [base[rng.integers(0, 300)] + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.25]) for _ in range(200)]
    hot = base[0] + rng.normal(size=(120, 16)) * 0.02
    return np.concatenate([base, near, hot, base[:5]]).astype(np.float32)


def test_links_equal_brute_force(spark):
    x = cloud()
    rows = [(i * 3 % (len(x) * 3), v.tolist(), 1, "x") for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in rows])
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in nndescent.near_duplicates(vectors).collect()}
    found = np.array([got[i].n_links for i in ids])
    assert (found <= near.sum(axis=1)).all()
    assert (found == near.sum(axis=1)).mean() > 0.99
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label, strict=True)]) > 0.99
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_components_are_counted_in_blocks(spark):
    x = cloud(2)[500:620]
    nodes = nndescent.classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))[1]
    comps = spark.createDataFrame([(i, 0) for i in range(len(x))], "node long, component long")
    whole, parts = ({r.id: r.n for r in nndescent.count_links(nodes, comps, 0.95, block).collect()} for block in (1024, 16))
    assert whole == parts
    assert set(whole.values()) == {len(x) - 1}


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [3.0, 0.0]), (8, [3.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), *[(i, 0, i, True) for i in range(1, 7)], (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 0, 9, True), (10, 2, 7, False)]
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_saturated_lists_widen_the_search(spark):
    """Clouds far larger than a list, and copies; every link counts, and ties are many."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((3, 16))
    x = np.concatenate([centres[np.repeat([0, 1, 2], [400, 150, 60])] + 0.12 * rng.standard_normal((610, 16)), rng.standard_normal((400, 16))]).round(3)
    x = np.concatenate([x, x[:200]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nndescent.near_duplicates(rows, tables=2).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    component = list(range(len(x)))
    for i in range(len(x)):  # in order of id, so the first to reach a vector is its least
        todo = [i] if component[i] == i else []
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if component[j] > i:
                    component[j] = i
                    todo.append(j)
    assert [got[i].component_id for i in range(len(x))] == component


def test_the_audit_counts_what_it_compared(spark):
    x = np.random.default_rng(1).standard_normal((40, 64))
    far = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.warns(UserWarning, match="unmeasured"):
        assert {r.n_links for r in nndescent.near_duplicates(far).collect()} == {0}
    close = spark.createDataFrame([(i, (x[0] + 0.001 * v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = nndescent.classes(close)[1]
    lost = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    assert nndescent.audit(nodes, lost, 0.95) == (40 * 39, 2 / (40 * 39))



# --- pipeline ---


def test_pipeline_on_the_small_tables(spark, small):
    import corpus_pipeline
    from tomeflow.llm import decontaminate, pii

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns
        assert 0 < docs.count() <= last
        last = docs.count()
    assert decontaminate.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    assert pii.extract(docs).where("base <> ''").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.where("pass_no = 0").count() > 0.5 * last


def test_pipeline_equals_its_stages_by_brute_force(spark, small):
    """With columns that clash with the stages' own, repeated rows, null ids, an empty and a very long text."""
    import corpus_pipeline
    from tests.llm.test_texts import brute_leaks, plain_spans
    from tomeflow.llm import pii, simhash

    base = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    own = {"row_key": "k", "fold": 3, "id": "i", "slot": 1.5, "pass_no": "p", "key": 1, "seed": 2, "cluster": None, "row": "r"}
    longest = base.orderBy(F.length("text").desc(), "doc_id").first()
    rows = [*base.collect(), *base.limit(2).collect(), (None, None, "en", "a"), (None, "", "en", "a"), (9000, longest.text + " mail someone@example.com" * 200, longest.lang, None), (None, "Of the re ndhewh, and the thing was on it.", "en", None)]
    schema = "doc_id long, text string, lang string, source string, row_key string, fold int, id string, slot double, pass_no string, key int, seed int, cluster string, row string"
    docs = spark.createDataFrame([(*tuple(r), *own.values()) for r in rows], schema).cache()
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, small).cache()
    assert good.columns == docs.columns

    texts = [(r.doc_id, r.text) for r in good.collect()]
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    wanted = []
    for g in set(group):
        ids = [texts[i][0] for i in range(len(texts)) if group[i] == g]
        wanted.append(min((i for i in ids if i is not None), default=None))
    one = stages["near_duplicates"](spark, good, small).cache()
    assert Counter(r.doc_id for r in one.collect()) == Counter(wanted)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in one.collect() if len(r.text) < 20_000], items)}
    clean = stages["decontamination"](spark, one, small).cache()
    short = lambda rows: {r.doc_id for r in rows.collect() if len(r.text) < 20_000}
    assert short(clean) == short(one) - leaking

    masked = stages["personal_data"](spark, clean, small).cache()
    given = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(given[r.doc_id]))
        assert r.text == pii.masked(given[r.doc_id], spans)
        assert r.asDict() | own == r.asDict()

    out = stages["mixture"](spark, masked, small)
    assert out.columns == [*docs.columns, "_pass_no", "block_rank", "_slot", "order_key"]
    assert ids_of(mixing.plan(masked).collect()) == Counter((r.doc_id, r._pass_no, r._slot) for r in out.collect())
    assert out.drop("_pass_no", "block_rank", "_slot", "order_key").exceptAll(masked).count() <= out.where("_pass_no > 0").count()


def test_pipeline_of_an_empty_table(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
