"""Choosing and assembling parses of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.functions.text import first_heading, is_blank, natural_key, nonempty, normalize_markdown, strip
from tomeflow.functions.trees import json_markdown
from tomeflow.schemas import PARSE_MODELS


def model_rank(model: Column) -> Column:
    """Place of a model in the order of preference; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in PARSE_MODELS]), model), F.lit(0))


def best_parse(parses: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, model, text)``: of each document's parses the first by preference that isn't blank, stripped.

    ``model`` restricts the choice to it, whatever its name. Blank and unknown
    parses are dropped before the one aggregation, which combines map-side.
    """
    rank = model_rank(F.col("model")) if model is None else F.when(F.col("model") == model, F.lit(1))
    ranked = parses.select("doc_id", "model", strip(F.col("text")).alias("text"), rank.alias("rank")).where("rank is not null and text <> ''")
    return ranked.groupBy("doc_id").agg(F.min_by(F.struct("model", "text"), "rank").alias("best")).select("doc_id", "best.model", "best.text")


def require_parses(doc_ids: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen``, or an error that names a document without any parse."""
    found = doc_ids.join(chosen, "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("no parse for "), F.col("doc_id").cast("string")))
    return found.withColumn("text", F.when(F.col("text").isNull(), missing).otherwise(F.col("text")))


def available_models(parses: DataFrame) -> DataFrame:
    """``(doc_id, models)``: the models with text for each document, by preference."""
    ranked = parses.select("doc_id", "model", model_rank(F.col("model")).alias("rank")).where(F.col("rank").isNotNull() & ~is_blank(F.col("text")))
    listed = F.array_sort(F.collect_set(F.struct("rank", "model")))
    return ranked.groupBy("doc_id").agg(F.transform(listed, lambda x: x["model"]).alias("models"))


def parse_titles(parses: DataFrame) -> DataFrame:
    """``(doc_id, title)``: first heading of the chosen parse, null if it has none."""
    return best_parse(parses).select("doc_id", first_heading(F.col("text")).alias("title"))


def _joined(rows: DataFrame, key: str, order: Column, text: Column, sep: str = "\n\n") -> DataFrame:
    """Texts of a key in order, blank ones left out."""
    kept = rows.select(key, order.alias("__order"), text.alias("__text")).where("__text <> ''")
    listed = F.array_sort(F.collect_list(F.struct("__order", "__text")))
    return kept.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["__text"]), sep).alias("text"))


def concat_pages(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of page files ``(doc_id, path, text)`` in natural order of their stems, then path."""
    return _joined(pages, "doc_id", F.struct(natural_key(F.col("path")), F.col("path")), strip(F.coalesce("text", F.lit(""))))


def marked_pages(pages: Column) -> Column:
    """An array of pages as one text, each under a marker with its place."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("<!-- page:"), (i + 1).cast("string"), F.lit(" -->\n\n"), p)), "\n\n")


def mark_pages(pages: DataFrame, physical: bool = False) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, page, text)``, each page under a marker with its number.

    The number is the page's, if ``physical``, else its rank among the pages with
    text (for parsers that hand on only those).
    """
    text = normalize_markdown(F.col("text"))
    rows = pages.select("doc_id", "page", text.alias("md")).where("md <> ''")
    if physical:
        rows = rows.withColumn("no", F.col("page").cast("long"))
        marked = F.concat(F.lit("<!-- page:"), F.col("no").cast("string"), F.lit(" -->\n\n"), F.col("md"))
        return _joined(rows, "doc_id", F.col("page"), marked)
    listed = F.array_sort(F.collect_list(F.struct("page", "md")))
    return rows.groupBy("doc_id").agg(marked_pages(F.transform(listed, lambda x: x["md"])).alias("text"))


def page_report(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_count, result_count, blank_pages)``."""
    blank = is_blank(F.col("text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum((~blank).cast("long")).alias("result_count"), F.array_sort(F.collect_list(F.when(blank, F.col("page")))).alias("blank_pages"))


def json_pages(files: DataFrame) -> DataFrame:
    """``(doc_id, text)``: Markdown strings of JSON files ``(doc_id, path, json)``; files that are no JSON give nothing."""
    texts = F.filter(F.transform(json_markdown(F.col("json")), normalize_markdown), lambda x: x != "")
    return _joined(files.select("doc_id", "path", F.array_join(texts, "\n\n").alias("text")), "doc_id", F.struct(natural_key(F.col("path")), F.col("path")), F.col("text"))


def pages_or_json(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Markdown pages where any has text, else the JSON files' strings."""
    both = concat_pages(pages).withColumnRenamed("text", "md").join(json_pages(files).withColumnRenamed("text", "js"), "doc_id", "full")
    return both.select("doc_id", nonempty(F.col("md"), F.col("js")).alias("text"))


def todo(pdfs: DataFrame, done: DataFrame, models: tuple[str, ...] = PARSE_MODELS, overwrite: bool = False) -> DataFrame:
    """``(doc_id, model)`` still to parse: each document by each model, without those done.

    The models are few and fixed, so each document is exploded rather than joined.
    """
    wanted = pdfs.select("doc_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return wanted if overwrite else wanted.join(done.select("doc_id", "model").distinct(), ["doc_id", "model"], "left_anti")


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result of each model and document; ``at`` orders them."""
    last = Window.partitionBy("model", "doc_id").orderBy(F.desc("at"))
    return results.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
