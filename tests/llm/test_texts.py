"""Language identification, HTML text, personal data and decontamination."""

import math
import random
import re
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pytest

from tomeflow.llm import decontaminate, html_text, langid, pii

# --- language identification ---


def greedy_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1) if text[i : i + 1] in sample else 1
        n += 1
    return n


def test_phrases_equal_greedy_parsing():
    rng = random.Random(2)
    samples = {x: "".join(rng.choice("abc d") for _ in range(80)) for x in ("aa", "bb")}
    samples = {k: langid.letters_only(v) for k, v in samples.items()}
    parser = langid.Parser(samples)
    for _ in range(200):
        text = "".join(rng.choice("abcdZ") for _ in range(rng.randint(1, 40)))
        symbols = parser.symbols[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        got = parser.phrases(symbols, np.array([0]), np.array([len(text)]))[:, 0].tolist()
        assert got == [greedy_phrases(text.lower(), samples[x]) for x in parser.langs]


def test_a_wide_alphabet_needs_little_memory():
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    samples = {"zh": "".join(rng.choice(letters) for _ in range(32_768)), "en": "".join(rng.choice("abcdefghij ") for _ in range(32_768))}
    tracemalloc.start()
    parser = langid.Parser(samples)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 50e6
    assert peak < 200e6
    text = samples["zh"][100:140] + "xyz" + letters[0] * 3 + samples["zh"][5000:5100]
    symbols = parser.symbols[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    got = parser.phrases(symbols, np.array([0]), np.array([len(text)]))[:, 0].tolist()
    assert got == [greedy_phrases(text, samples[x]) for x in parser.langs]


def test_ties_repeated_and_null_ids(spark):
    rows = [(1, "same words here", "aa"), (1, "same words here", "aa"), (2, "same words here", "bb"), (None, "other letters", "cc"), (3, "same words", None), (3, "same words", None), (4, "x" * 200_000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    learned = {r.lang_pred for r in got}
    assert learned <= {"aa", "bb"}
    both = [r for r in got if r.doc_id == 3]
    assert len(both) == 2 and both[0] == both[1]
    assert (both[0].lang_pred, both[0].score) == ("aa", 0.0) if learned == {"aa"} else True


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (6, "THE dog", None), (7, "ünd " * 9000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert [got[i].score for i in (3, 4, 5)] == [0.0] * 3
    assert got[6].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


# --- HTML ---


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p><b>One two\n three.<br>four<p>Five.</article><footer><p>x</footer>", "T & U\nOne two three. four\nFive."),
        ('<body><div class="ad">Buy</div><div id="content"><p>Long enough text of a paragraph here.</p><p>Another one of these.</p></div><div class="comments"><p>I liked it very much, great article.</p></div></body>', "Long enough text of a paragraph here.\nAnother one of these."),
        ('<article><form><p>Name</p></form><p>Text</p><script>var t="</p>";</script><style>p{}</style><aside>no</aside></article>', "Text"),
        ('<div hidden>h</div><p>shown</p><p style="display: none">h</p><p aria-hidden=true>h</p>', "shown"),
        ("<p>a &lt;b&gt; &#233;&nbsp;c</p>", "a <b> é c"),
        ("plain < text", "plain < text"), ("", ""), (None, ""), ("<p></p>", ""), ("<a title='x > y' href=z>link</a>", "link"), ("<!-- c --><p>x<!-- d -->y</p><!-- open", "xy"),
        ('<main><div><p>First section text here.</p></div><div><p>Second section.</p><ul><li>i<li>j</ul></div></main>', "First section text here.\nSecond section.\ni\nj"),
    ],
)
def test_main_text(page, wanted):
    assert html_text.main_text(page) == wanted


FURNITURE_NAMES = ["register", "notice-of-meeting", "related-work", "share-price", "form-10k", "promotion-history", "search-results", "widget", "ad", "comments", "sidebar", "menu"]


@pytest.mark.parametrize("name", FURNITURE_NAMES)
@pytest.mark.parametrize("around", ["article", "main", "div", "section"])
def test_paragraphs_survive_whatever_their_names(name, around):
    page = f'<body><nav><a href=x>Home</a></nav><{around}><h2 id="{name}">Head line</h2><p>First paragraph of some length.</p><p class="{name}">Named paragraph, as long as others.</p></{around}></body>'
    assert html_text.main_text(page) == "Head line\nFirst paragraph of some length.\nNamed paragraph, as long as others."


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_menus_and_boxes_of_furniture_go_wherever_they_are(around):
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(30))
    text = "<p>First paragraph of the text, of some length.</p><p>Second one, with <a href=x>a link</a> in it.</p>"
    wanted = "First paragraph of the text, of some length.\nSecond one, with a link in it."
    for box in (f"<ul>{links}</ul>", '<div class="ad-slot">Buy this now, it is cheap and good.</div>', '<div id="comments"><p>I liked it very much, thank you.</p></div>', '<section class="newsletter box">Get our letters every week.</section>'):
        assert html_text.main_text(f"<body><{around}>{box}{text}</{around}></body>") == wanted, box
        assert html_text.main_text(f"<body>{box}<{around}>{text}</{around}></body>") == wanted, box
    assert html_text.main_text(f'<body><div class="widget"><h1>H</h1>{text}</div></body>') == f"H\n{wanted}"
    assert html_text.main_text("<p>A text of a few words with</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul>") == "A text of a few words with\none\ntwo"


def test_densities_by_their_definition():
    """On random trees without furniture: counts over whole subtrees, one by one."""
    rng = random.Random(5)

    def tree(depth):
        name = rng.choice(["div", "section", "p", "a", "ul", "blockquote"])
        kids = [] if depth == 0 or name in ("p", "a") else [tree(depth - 1) for _ in range(rng.randint(0, 4))]
        return (name, "".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 40, 200]))), kids)

    def html(t):
        return f"<{t[0]}>{t[1]}{''.join(map(html, t[2]))}</{t[0]}>"

    def subtree(t, linked=False):
        linked = linked or t[0] == "a"
        return [(len(t[1]), linked), *(x for k in t[2] for x in subtree(k, linked))]

    for _ in range(60):
        root = ("body", "", [tree(4) for _ in range(rng.randint(1, 4))])
        page = html_text.Page(html(root))
        body, density, total = page.densities()
        whole = subtree(root)
        share = sum(n for n, link in whole if link) / max(1, sum(n for n, _ in whole))

        def wanted(t, share=share):
            got = subtree(t)
            c, n = sum(k for k, _ in got), len(got)
            lc, lt = sum(k for k, link in got if link), sum(link for _, link in got)
            if not c:
                return 0.0
            return c / n * math.log(c / max(lc, 1) * n / max(lt, 1)) / math.log(math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e))

        nodes, todo = [], [root]
        while todo:
            t = todo.pop(0)
            nodes.append(t)
            todo = [*t[2], *todo]
        assert page.tag[body:] == [t[0] for t in nodes]
        assert density[body:] == pytest.approx([wanted(t) for t in nodes])
        assert total[body:] == pytest.approx([len(t[1]) + sum(map(wanted, t[2])) for t in nodes])


def test_broken_markup_takes_linear_time():
    for page in ("<!--" * 200_000, "<p>x<!-- y " * 100_000, "<textarea>" * 100_000, '<a b="' * 100_000, "<p" * 100_000, "</p>" * 100_000, "<li><div>" * 50_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10
    assert html_text.main_text("<p>a</p><!--><p>b</p><!---><p>c</p><!-- d --!><p>e</p><!-- <p>f</p>") == "a\nb\nc\ne"


def test_deep_pages_do_not_recurse():
    assert html_text.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"


def test_pages(spark, small):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>é</p>", "x"), (None, "u", "<p>é</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_text.extract(rows).collect()) == [(0, "u", "é", 1), (1, "", "", 0), (1, "u", "é", 1)]
    assert html_text.extract(rows.limit(0)).count() == 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in html_text.extract(spark.read.parquet(f"{small}/pages.parquet")).collect():
        article = re.search("(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        blocks = [" ".join(html_text._html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "@", "x", ".", "..", "1", "12", "255", "256", "0001.2.3.4", "1.2.3.4.5", "+", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", " ", "-", "  ", "é", "a.b@c-d.ee.f", "_%+-", "\n", "1.2.3", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 300_000, "a@" * 100_000, "1 " * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)
        pii.occurrences(text, [])


def test_bootstrap_finds_identifiers_in_learned_contexts(spark):
    rows = [(i, f"please call me now: +1 555 010 {1000 + i} thanks a lot", "x") for i in range(30)]
    rows += [(100, "please call me now: 5550109876 thanks", "x"), (101, "some other number 5550109871 here", "x"), (102, None, "x"), (103, "", "x"), (None, "mail a@b.cd", "x"), (100, "nothing", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {}
    for r in pii.extract(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_phone, r.n_email, r.base, r.spans))
    assert got[0] == [(1, 0, "phone:20:35", "phone:20:35")]
    assert sorted(got[100]) == [(0, 0, "", ""), (0, 0, "", "phone:20:30")]
    assert got[101] == got[102] == got[103] == [(0, 0, "", "")]
    assert got[None] == [(0, 1, "email:5:11", "email:5:11")]
    masked = {(r.doc_id, r.text) for r in pii.mask(docs).collect()}
    assert (0, "please call me now: [PHONE] thanks a lot") in masked
    assert (100, "please call me now: [PHONE] thanks") in masked
    assert (100, "nothing") in masked
    assert (102, None) in masked
    assert (None, "mail [EMAIL]") in masked
    assert pii.mask(docs).columns == docs.columns
    assert pii.extract(docs.limit(0)).count() == pii.mask(docs.limit(0)).count() == 0


def plain_bootstrap(texts, rounds=pii.ROUNDS):
    """The pattern-instance graph by its definition: spans added to each text."""
    seen = [(i, o) for i, t in enumerate(texts) for o in pii.occurrences(t, pii.base_spans(t))]
    instances, kinds = {}, {}
    for _, (kind, _, _, instance, patterns) in seen:
        for p in patterns:
            instances.setdefault(p, set()).add(instance)
            if kind:
                kinds[p, instance] = min(kind, kinds.get((p, instance), kind))
    known = {(instance, kind) for _, (kind, _, _, instance, _) in seen if kind}
    for _ in range(rounds):
        confident = {}
        for p, members in instances.items():
            for k in pii.KINDS:
                hits = sum((m, k) in known for m in members)
                if hits >= pii.MIN_SUPPORT and hits >= pii.MIN_PATTERN * len(members):
                    confident[p, k] = hits / len(members)
        scores = {}
        for (p, k), c in confident.items():
            for m in instances[p]:
                if (p, m) not in kinds:
                    scores[m, k] = scores.get((m, k), 1.0) * max(1e-6, 1 - c)
        new = {}
        for (m, k), doubt in sorted(scores.items(), key=lambda x: (x[1], x[0][1])):
            if 1 - doubt >= pii.MIN_INSTANCE:
                new.setdefault(m, k)
        if set(new.items()) <= known:
            break
        known |= set(new.items())
    out = {}
    for i, (kind, start, end, instance, patterns) in seen:
        if kind is None:
            out.setdefault(i, set()).update((k, start, end) for k in pii.KINDS if (instance, k) in known and any((p, k) in confident for p in patterns))
    return {i: x for i, x in out.items() if x}


def test_bootstrap_equals_the_graph_by_its_definition(spark):
    """Planted identifiers that no base pattern matches, in contexts learned directly, over a skipped word, and from one another."""
    rng = random.Random(12)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + rng.choice("xyz") * rng.randint(1, 3)
    phone, loose = lambda: f"+1 555 {rng.randint(1000000, 9999999)}", lambda: f"555{rng.randint(1000000, 9999999)}"
    card, decoy = lambda: rng.choice(["4111111111111111", "5500000000000004", "4012888888881881", "378282246310005"]), lambda: str(rng.randint(10**15, 10**16))
    texts, planted = [], set()
    for i in range(400):
        fill = [" ".join(word() for _ in range(rng.randint(2, 6))) for _ in range(3)]
        if i % 4 == 0:  # learned: next to it, and over a skipped word
            texts.append(f"{fill[0]} ring me: {phone()} {fill[1]} dial {word()} at {phone()} soon")
        elif i % 40 == 1:
            n = loose()
            texts.append(f"{fill[0]} ring me: {n} {fill[1]}")
            planted.add((i, n))
        elif i % 40 == 2:
            n = loose()
            texts.append(f"{fill[0]} dial {word()} at {n} soon")
            planted.add((i, n))
        else:  # cards and decoys in the same contexts
            texts.append(f"{fill[0]} number {card() if rng.random() < 0.5 else decoy()} {fill[1]} " + ("x" * 500 + "1234 tail" if i % 50 == 3 else ""))
    texts += [texts[1], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wanted = plain_bootstrap([t or "" for t in texts])
    got = {}
    for r in pii.extract(docs).collect():
        more = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} - {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.base.split(",") if x)}
        if more:
            got[r.doc_id] = more
    assert got == wanted
    assert {(i, texts[i][s:e]) for i, x in got.items() for _, s, e in x if i < 400} == planted
    assert len(planted) == 20


def test_masking_of_overlapping_spans():
    assert pii.masked("0123456789", "ip:1:4,card:3:6,phone:8:9") == "0[IP]67[PHONE]9"
    assert pii.masked("abc", "") == "abc"


# --- decontamination ---


def plain_words(text):
    return re.findall(rf"[{decontaminate.UNSPACED}]|[^\W{decontaminate.UNSPACED}]+", (text or "").lower())


def leak_corpus():
    """Items of 1 to 40 words, whole or cut out of and into documents, with random substitutions; some twice, some very long."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20, 20, 40, 40])] + [(50, ["rare"]), (51, [])]
    docs = []
    for d in range(400):
        w = text(rng.randint(0, 60) if d % 50 else 30_000)
        part = [*rng.choice(items)[1]]
        lo = rng.randint(0, max(0, len(part) - 13)) if d % 3 else 0
        part = [x if rng.random() > 0.15 else "CHANGED" for x in part[lo:]]
        at = rng.randint(0, len(w))
        w[at:at] = part
        docs.append((d, " ".join(f"\u201c{x.upper()}\u201d," if rng.random() < 0.1 else x for x in w)))
    docs += [docs[3], docs[3], (500, "一二三四五六七八九十甲乙丙丁戊己"), (501, "x一二三四五六七八九十甲乙丙丁戊x")]
    return docs, [(i, " ".join(w)) for i, w in items] + [(60, "一二三四五六七八九十甲乙丙丁戊己"), (61, "一二三四五六七八九十甲乙丙丁戊己")]


def brute_leaks(docs, items):
    """By the criterion alone: some window of 13 aligned words, or the whole item, agrees in 0.8 of them."""
    out = set()
    for d, t in docs:
        w = np.array(plain_words(t), object)
        for i, u in items:
            v = np.array(plain_words(u), object)
            size = min(13, len(v))
            for shift in range(1 - len(v), len(w)) if size else ():
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                if hi - lo >= size and (np.convolve(w[lo + shift : hi + shift] == v[lo:hi], np.ones(size, int), "valid") >= 0.8 * size).any():
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force_either_way(spark):
    docs, items = leak_corpus()
    wanted = brute_leaks([(d, t) for d, t in docs if len(t) < 10_000], items)
    long = {d for d, t in docs if len(t) >= 10_000}
    assert {i for _, i in wanted} >= set(range(16)) | {60, 61}
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(900, None, "x", 1), (901, "", "x", 1)], "doc_id long, text string, item_id string, seed int")
    test = spark.createDataFrame([*items, (70, None)], "item_id long, text string")
    small = decontaminate.leaks(rows, test)
    large = decontaminate.leaks(rows, test, seed_limit=0)
    assert {(r.doc_id, r.item_id) for r in small.collect() if r.doc_id not in long} == wanted
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(small.columns).collect()))
    few = {(d, i) for d, i in wanted if len(plain_words(dict(items)[i])) >= 9}
    for limit in (decontaminate.SEED_LIMIT, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, test, seed_limit=limit, min_words=9).collect() if r.doc_id not in long} == few
    kept = decontaminate.clean(rows, test)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.collect()} - {r.doc_id for r in small.collect()}
    assert decontaminate.leaks(rows.limit(0), test).count() == decontaminate.leaks(rows, test.limit(0)).count() == 0


@pytest.mark.parametrize(("window", "similarity"), [(13, 0.8), (8, 0.8), (13, 0.6)])
def test_every_placing_of_substitutions_is_found(window, similarity):
    for n in range(1, 17):
        size = min(window, n)
        differ = max(k for k in range(size) if size - k >= similarity * size)
        item = [f"w{i}" for i in range(n)]
        seeds = decontaminate.Seeds([(0, " ".join(item))], window, similarity)
        for at in range(n - size + 1):
            for bad in combinations(range(at, at + size), min(differ, 3)):
                text = ["x"] * 3 + [f"y{i}" if i in bad or not at <= i < at + size else w for i, w in enumerate(item)] + ["z"]
                words = decontaminate.words_of(" ".join(text))
                assert decontaminate.best_links(words, seeds.alignments(words), seeds.words, window, similarity), (n, at, bad)


def test_substitutions_in_short_items_are_found_either_way(spark):
    rng = random.Random(10)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(5, 15)]
    docs = []
    for n, w in items:
        for bad in [*combinations(range(n), 1), *rng.sample([*combinations(range(n), 2)], 10)]:
            docs.append((len(docs), " ".join(["a", "b", *("x" if k in bad else v for k, v in enumerate(w)), "c"])))
    wanted = set()
    for d, t in docs:
        w = t.split()
        for i, v in items:
            size = min(13, len(v))
            if any(sum(w[a + k] == v[b + k] for k in range(size)) >= 0.8 * size for a in range(len(w) - size + 1) for b in range(len(v) - size + 1)):
                wanted.add((d, i))
    rows, test = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for limit in (decontaminate.SEED_LIMIT, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, test, seed_limit=limit).collect()} == wanted
