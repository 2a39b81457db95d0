"""Blocks, windows and retrieval chunks of texts.

Everything is an expression over one row, so chunking needs no shuffle; rows with
null text have no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeflow.functions.text import bind, normalize_text, overlap_tail, strip

CHUNK_CHARS, OVERLAP_CHARS = 1800, 240
#: Tokens tile a normalized text: a block and the line feeds after it.
_BLOCK = r"(?Us)\S.*?(?=\n{2,}\S|\z)\n*"
_PIECE = "struct<start:int,text:string>"


def check_sizes(chunk_chars: int, overlap_chars: int) -> None:
    if chunk_chars <= 0:
        raise ValueError("chunk_chars must be positive")
    if overlap_chars < 0:
        raise ValueError("overlap_chars must not be negative")
    if overlap_chars >= chunk_chars:
        raise ValueError("overlap_chars must be under chunk_chars")


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(_BLOCK), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n)


def starts(lengths: Column, width: int = 64) -> Column:
    """Sum of the lengths before each one; groups of ``width`` are summed first, so the work grows with the array."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / width).cast("int"), F.lit(0))), lambda g: F.slice(lengths, g * width + 1, width))
    before = F.aggregate(groups, F.array(F.lit(0)), lambda done, g: F.concat(done, F.array(F.element_at(done, -1) + _sum(g))))
    return F.flatten(F.zip_with(groups, F.slice(before, F.lit(1), F.size(before) - 1), lambda g, at: F.transform(g, lambda _, i: at + _sum(F.slice(g, F.lit(1), i)))))


def blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, block_no, start, block)``: paragraphs with their place in the normalized text."""
    tiles = docs.select("doc_id", tokens(normalize_text(F.col("text"))).alias("tiles"))
    measured = tiles.withColumn("starts", starts(F.transform("tiles", F.length)))
    placed = measured.select("doc_id", F.posexplode(F.arrays_zip("tiles", "starts")).alias("n", "b"))
    return placed.select("doc_id", (F.col("n") + 1).alias("block_no"), F.col("b.starts").alias("start"), strip(F.col("b.tiles")).alias("block"))


def windows(text: Column, start: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each ``size - overlap`` after the one before; stripped, empty ones dropped."""
    step = size - overlap
    last = F.when(F.length(text) <= size, F.lit(0)).otherwise(F.ceil((F.length(text) - size) / F.lit(step)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((start + i * step).alias("start"), strip(F.substring(text, i * step + 1, F.lit(size))).alias("text")))
    return F.filter(pieces, lambda p: p["text"] != "")


def pieces(text: Column, chunk_chars: int, overlap_chars: int) -> Column:
    """Array of ``(start, text)``: blocks packed up to ``chunk_chars``, each chunk starting with the tail of the one before; longer blocks in windows."""
    none = F.array().cast(f"array<{_PIECE}>")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("cur"), F.lit(0).alias("cur_start"), none.alias("out"))

    def flushed(s: Column) -> Column:
        return F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["cur_start"].alias("start"), s["cur"].alias("text")))))

    def continued(s: Column, tile: Column, tail: Column) -> Column:
        text = F.when(tail == "", tile["part"]).otherwise(F.concat(tail, F.lit("\n\n"), tile["part"]))
        begin = F.when(tail == "", s["at"]).otherwise(F.greatest(s["at"] - F.length(tail) - 2, F.lit(0)))
        return F.struct((s["at"] + tile["size"]).alias("at"), text.alias("cur"), begin.alias("cur_start"), flushed(s).alias("out"))

    def step(s: Column, tile: Column) -> Column:
        part, after = tile["part"], (s["at"] + tile["size"]).alias("at")
        too_long = tile["length"] > chunk_chars
        full = (s["cur"] != "") & (F.length(s["cur"]) + 2 + tile["length"] > chunk_chars)
        cut = F.struct(after, F.lit("").alias("cur"), F.lit(0).alias("cur_start"), F.concat(flushed(s), windows(part, s["at"], chunk_chars, overlap_chars)).alias("out"))
        new = bind(overlap_tail(s["cur"], overlap_chars), lambda tail: continued(s, tile, tail))
        more = F.struct(after, F.when(s["cur"] == "", part).otherwise(F.concat(s["cur"], F.lit("\n\n"), part)).alias("cur"), F.when(s["cur"] == "", s["at"]).otherwise(s["cur_start"]).alias("cur_start"), s["out"].alias("out"))
        return F.when(too_long, cut).when(full, new).otherwise(more)

    tiles = F.transform(tokens(normalize_text(text)), lambda t: bind(strip(t), lambda part: F.struct(part.alias("part"), F.length(part).alias("length"), F.length(t).alias("size"))))
    return F.aggregate(tiles, state, step, flushed)


def make_chunks(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Retrieval chunks of ``docs (doc_id, title, domain, text)``, numbered from 1 in each document."""
    check_sizes(chunk_chars, overlap_chars)
    found = docs.select("doc_id", "title", "domain", F.posexplode(pieces(F.col("text"), chunk_chars, overlap_chars)).alias("n", "c"))
    text = strip(F.col("c.text"))
    return found.select(
        F.format_string("%s::%04d", F.col("doc_id").cast("string"), F.col("n") + 1).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("domain", F.lit("")).alias("domain"),
        text.alias("text"), F.col("c.start").alias("start"), (F.col("c.start") + F.length(text)).alias("end"),
    )


def window_rows(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(doc_id, window_no, start, text)`` of whole texts, whatever their blocks."""
    check_sizes(size, overlap)
    rows = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(windows(F.col("text"), F.lit(0), size, overlap)).alias("n", "w"))
    return rows.select("doc_id", (F.col("n") + 1).alias("window_no"), F.col("w.start").alias("start"), F.col("w.text").alias("text"))
