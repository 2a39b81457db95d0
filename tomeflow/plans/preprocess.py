"""Raw documents to parsed documents and chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.functions.text import first_heading, first_line, nonempty, normalize_text, stem
from tomeflow.operators.catalog import source_kind
from tomeflow.operators.chunking import CHUNK_CHARS, OVERLAP_CHARS, make_chunks
from tomeflow.operators.parses import best_parse, require_parses
from tomeflow.sources.readers import read_documents, read_files, read_html, read_parses, read_plain
from tomeflow.sources.runners import TIMEOUT, parse_files
from tomeflow.sources.writers import write_jsonl, write_parses, write_table


def file_key(path: Column, root: str) -> Column:
    """Path of a file below ``root``, however its URI is written."""
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    return F.when(plain.startswith(root.rstrip("/") + "/"), F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))).otherwise(plain)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of its file system, with one slash after the scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    made = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", made)


def parse_documents(meta: DataFrame, plain: DataFrame, html: DataFrame, parses: DataFrame, root: str, pdf_model: str | None = None) -> DataFrame:
    """``(doc_id, title, domain, text)`` of all documents, by the kind of their file.

    A document's file is the one at its path below ``root`` (as ``qualified``), so
    files of equal names in different folders stay apart. Titles: of text files the
    given one, else the first line; of pages the page's, else the given one; of PDFs
    the first heading, else the given one; at last the id.
    """
    routed = meta.withColumn("kind", source_kind(F.col("path")))
    keyed = lambda rows: rows.withColumn("key", file_key(F.col("path"), root)).drop("path", "doc_id")
    left = routed.select("doc_id", F.col("title").alias("given"), "domain", "kind", F.regexp_replace("path", "^(\\./)+|/(?=/)", "").alias("key"))
    columns = ["doc_id", "title", "domain", "text"]

    def found(kind: str, rows: DataFrame, title) -> DataFrame:
        joined = left.where(F.col("kind") == kind).join(rows, "key", "left")
        text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("missing file: "), F.col("key")))).otherwise(F.col("text"))
        return joined.withColumn("text", text).withColumn("title", title).select(*columns)

    texts = found("txt", keyed(plain), nonempty(F.col("given"), first_line(F.col("text")), F.col("doc_id")))
    pages = found("html", keyed(html), nonempty(F.col("title"), F.col("given"), F.col("doc_id")))
    pdfs = left.where("kind = 'pdf'")
    chosen = require_parses(pdfs, best_parse(parses, pdf_model))
    parsed = chosen.withColumn("title", nonempty(first_heading(F.col("text")), F.col("given"), F.col("doc_id"))).select(*columns)
    return texts.unionByName(pages).unionByName(parsed).withColumn("text", normalize_text(F.col("text")))


def run(spark: SparkSession, data_dir: str, parsed_dir: str, out_dir: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, pdf_model: str | None = None) -> dict[str, int]:
    """Write ``parsed_documents`` and ``chunks`` as tables and JSON lines; returns their counts."""
    meta = read_documents(spark, f"{data_dir}/documents.jsonl")
    parsed = parse_documents(meta, read_plain(spark, f"{data_dir}/raw"), read_html(spark, f"{data_dir}/raw"), read_parses(spark, parsed_dir), qualified(spark, data_dir), pdf_model)
    write_table(parsed, f"{out_dir}/parsed_documents")
    parsed = spark.read.parquet(f"{out_dir}/parsed_documents")
    write_table(make_chunks(parsed, chunk_chars, overlap_chars), f"{out_dir}/chunks")
    chunks = spark.read.parquet(f"{out_dir}/chunks")
    write_jsonl(parsed, f"{out_dir}/parsed_documents.jsonl", ["doc_id"])
    write_jsonl(chunks, f"{out_dir}/chunks.jsonl", ["doc_id", "chunk_id"])
    return {"documents": parsed.count(), "chunks": chunks.count()}


def parse_new(spark: SparkSession, inputs: list[str], model: str, out_root: str, timeout: float = TIMEOUT, overwrite: bool = False) -> DataFrame:
    """Parse the PDF files of ``inputs`` that ``model`` has no Markdown of in ``out_root`` yet; ``(model, doc_id, ok, markdown_path)``."""
    files = read_files(spark, inputs, "*.[pP][dD][fF]").select("path", stem(F.col("path")).alias("doc_id"), "content")
    if not overwrite:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_root}/{model}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = read_files(spark, f"{out_root}/{model}", "*.md").select(stem(F.col("path")).alias("doc_id"))
            files = files.join(done, "doc_id", "left_anti")
    written = write_parses(parse_files(files.dropDuplicates(["doc_id"]), model, timeout), out_root)
    # written as a table, as reading the rows does the work
    status = f"{out_root}/_status/{model}"
    write_table(written, status)
    return spark.read.schema(written.schema).parquet(status)
