import pytest
from pyspark.sql import functions as F

from tomeflow.functions import answers, text, tokens, trees


def value(spark, column_of, given):
    return spark.createDataFrame([(given,)], "t string").select(column_of(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a \r\nb\rc", "a\nb\nc"), ("a\x07b\tc", "ab\tc"), ("x　\ny", "x\ny"), ("a\n\n\n\n\n\nb", "a\n\n\nb"), ("a\n \n \n \nb", "a\n\n\nb"), ("  \n", ""), (None, ""), ("", ""),
    ],
)
def test_normalize_text(spark, given, wanted):
    assert value(spark, text.normalize_text, given) == wanted
    assert value(spark, text.normalize_text, wanted) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("\ufeffharbour  \r\nlight house\r\n", "harbour\nlight house"), ("one\rtwo\rthree", "one\ntwo\nthree"), ("\t head \u3000\nfirst row \t \nlast row\n \n", "head\nfirst row\nlast row"), ("top\n\nbottom", "top\n\nbottom"), ("a\x07", "a\x07")],
)
def test_plain_text(spark, given, wanted):
    assert value(spark, text.plain_text, given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("```markdown\nx\n```", "x"), ("```md x```", "x"), ("```\nx```", "x"), ("```python\nx```", "python\nx"), ("```mdx```", "x"), ("```", ""), ("``` x", "``` x"), ("x", "x")],
)
def test_fence(spark, given, wanted):
    assert value(spark, text.strip_fence, given) == wanted


def test_text_layer_joins_vertical_text(spark):
    upright = "\n".join("海港仓库租借守则第三条货箱不得叠放过高第四条夜间须有看守")
    assert value(spark, text.normalize_text_layer, upright) == "海港仓库租借守则\n第三条货箱不得叠放过高\n第四条夜间须有看守"
    assert value(spark, text.normalize_text_layer, "long line\n\n  other line") == "long line\nother line"
    assert value(spark, text.normalize_text_layer, " \n") == ""


def test_titles_from_lines(spark):
    assert value(spark, text.first_heading, "intro\n\n###\n### Tide tables of 1903\nrows") == "Tide tables of 1903"
    assert value(spark, text.first_heading, "no heading") is None
    assert value(spark, text.first_line, "\n#\n  # A b\nc") == "A b"
    assert value(spark, text.first_line, " ") is None


@pytest.mark.parametrize(("given", "size", "wanted"), [("abcdef", 3, "def"), ("ab\ncd", 4, "cd"), ("ab\ncd", 2, "cd"), ("abc", 0, ""), ("abc", 9, "abc"), ("\nabc", 4, "abc"), ("", 3, "")])
def test_overlap_tail(spark, given, size, wanted):
    assert value(spark, lambda c: text.overlap_tail(c, size), given) == wanted


def test_paths(spark):
    assert value(spark, text.suffix, "a/b.tar.PDF") == ".pdf"
    assert value(spark, text.stem, "a/b.tar.PDF") == "b.tar"
    assert value(spark, text.stem, "a/【7】港务（丙）(b)") == "【7】港务（丙）(b)"
    rows = spark.createDataFrame([(p,) for p in ("p/8_10.md", "q/8_2.md", "p/8_0.md", "p/8_02b.md", "p/a.md")], "p string")
    assert [r.p for r in rows.orderBy(text.natural_key(F.col("p"))).collect()] == ["p/8_0.md", "q/8_2.md", "p/8_02b.md", "p/8_10.md", "p/a.md"]


def test_tokens_of_unspaced_text_meet_spaced_ones(spark):
    asked = value(spark, tokens.tokenize, "灯塔高度超过桥梁吗？B7 1903")
    told = value(spark, tokens.tokenize, "灯塔 的 高度 桥梁")
    assert {"灯塔", "高度", "桥梁"} <= set(asked) & set(told)
    assert {"b7", "1903"} <= set(asked)
    assert value(spark, tokens.tokenize, None) == []


@pytest.mark.parametrize(("raw", "kind", "wanted"), [("选 D。理由是", "mcq", "D"), ("(F) or (A)", "mcq", "A"), ("D, B and D", "multi", "BD"), ("final: BCD!", "multi", "BCD"), ("Answer: D", "tf", ""), ("B", "tf", "B"), ("Besides", "mcq", ""), (None, "mcq", "")])
def test_normalize_answer(spark, raw, kind, wanted):
    assert value(spark, lambda c: answers.normalize_answer(c, F.lit(kind)), raw) == wanted


@pytest.mark.parametrize(("answer", "kind", "ok"), [("D", "mcq", True), ("BD", "mcq", False), ("BCD", "multi", True), ("DB", "multi", False), ("BB", "multi", False), ("", "multi", False), ("D", "tf", False), ("A", "tf", True), (None, "tf", False), ("D", "essay", False)])
def test_valid_answer(spark, answer, kind, ok):
    assert value(spark, lambda c: answers.is_valid_answer(c, F.lit(kind)), answer) is ok


def test_scores(spark):
    row = spark.range(1).select(answers.token_score(F.lit(9_200_000)).alias("t"), answers.final_score(F.lit(0.2), F.lit(9_200_000)).alias("f"), answers.token_score(F.lit(1_000_000)).alias("u")).first()
    assert (row.t, round(row.f, 9), row.u) == (0.0, 14.0, 0.8)


def test_json_object(spark):
    got = value(spark, lambda c: answers.json_object(c, "answer string"), 'Sure: {"answer": "B"} ok')
    assert got.answer == "B"


# --- pages and JSON ---


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<html><body><div class="a detail-news"><p>Pier <b>No.</b><i> 9 </i></p><p>closed</p></div></body></html>', "PierNo.9\nclosed"),
        ('<body><p>menu</p><div class="main"><p>low</p></div><div class="detail-news"><p>Ships left at noon.</p></div><p>imprint</p></body>', "Ships left at noon."),
        ('<div class="content"><p>kept</p><style>p{}</style><script>document.write("<p>no</p>")</script></div>', "kept"),
        ("<body><section><p>alone</p></section></body>", "alone"),
        ('<div class="main">m<div class="x content"><p>c</p></div></div>', "c"),
        ("<body>one<br>two <b>three</b></body>", "one\ntwo\nthree"),
        ("<body><p>a<p>b</body>", "ab\nb"),
        ("", ""), (None, ""),
    ],
)
def test_main_paragraphs(page, wanted):
    assert trees.main_paragraphs(page) == wanted


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<head><title>Notice 4_port</title><meta content="Notice 4 (pilots)" name="ArticleTitle"></head>', "Notice 4 (pilots)"),
        ("<meta content='x &amp; y' name='ArticleTitle'>", "x & y"),
        ("<title> Tide table_1903_x </title>", "Tide table"), ("<head></head><p>x</p>", None), ("<title>_</title>", None), ('<meta name="ArticleTitle" content=" "><title>t</title>', "t"),
    ],
)
def test_html_title(spark, page, wanted):
    assert value(spark, trees.html_title, page) == wanted


def test_markdown_strings_keep_the_order_of_keys():
    assert trees.markdown_strings('{"z": [{"MD": "1"}, "no"], "a": {"markdown": {"md_text": "2"}}, "md": 3, "markdown_text": "4"}') == ["1", "2", "4"]
    assert trees.markdown_strings("{broken") == []
    assert trees.markdown_strings('"md"') == []
    assert trees.markdown_strings(None) == []
