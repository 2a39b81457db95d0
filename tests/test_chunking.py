import pytest

from tomeflow.operators import chunking

DOCS = "doc_id string, title string, domain string, text string"


def made(spark, text, size, overlap):
    rows = chunking.make_chunks(spark.createDataFrame([("d", None, "x", text)], DOCS), size, overlap).orderBy("chunk_id").collect()
    return [(r.start, r.end, r.text) for r in rows]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "wanted"),
    [
        ("aaaa\n\nbbbb\n\ncccc", 10, 4, [(0, 10, "aaaa\n\nbbbb"), (6, 16, "bbbb\n\ncccc")]),
        ("aaaaaaaa\n\nbbbbbbbb", 10, 4, [(0, 8, "aaaaaaaa"), (4, 18, "aaaa\n\nbbbbbbbb")]),
        ("aaaa\n\n\nbbbb", 20, 4, [(0, 10, "aaaa\n\nbbbb")]),
        ("x" * 25, 10, 4, [(0, 10, "x" * 10), (6, 16, "x" * 10), (12, 22, "x" * 10), (18, 25, "x" * 7)]),
        ("p1\n\n　p2", 20, 0, [(0, 7, "p1\n\n　p2")]),
        ("", 10, 4, []), (None, 10, 4, []), (" \n ", 10, 4, []),
    ],
)
def test_examples(spark, text, size, overlap, wanted):
    assert made(spark, text, size, overlap) == wanted


def test_ids_count_from_one_and_are_not_cut(spark):
    rows = chunking.make_chunks(spark.createDataFrame([("k", "t", "d", "a" * 10_001)], DOCS), 1, 0).orderBy("start").collect()
    assert rows[0].chunk_id == "k::0001"
    assert rows[-1].chunk_id == "k::10001"


def test_no_chunk_exceeds_its_bound(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("cast(doc_id as string) doc_id", "'' title", "'' domain", "replace(text, '\n', '\n\n') text")
    assert chunking.make_chunks(docs).selectExpr("max(length(text)) n").first().n <= 1800 + 240 + 2


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, -1), (10, 10)])
def test_sizes_are_checked(spark, size, overlap):
    with pytest.raises(ValueError, match="chars"):
        chunking.check_sizes(size, overlap)


def test_blocks(spark):
    rows = chunking.blocks(spark.createDataFrame([("d", "", "", "a\n\nb c\n\n\n d\n\ne")], DOCS)).orderBy("block_no").collect()
    assert [(r.start, r.block) for r in rows] == [(0, "a"), (3, "b c\n\n\n d"), (13, "e")]
