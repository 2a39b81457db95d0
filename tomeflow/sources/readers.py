"""Readers of catalogue files, raw files and parses."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeflow.functions.text import is_blank, plain_text, stem, suffix
from tomeflow.functions.trees import html_paragraphs, html_title
from tomeflow.operators.catalog import document_meta, question_rows, questions
from tomeflow.schemas import CHUNK, DOCUMENT_META, DOMAINS, QUESTION_ROW


@dataclass(frozen=True)
class Config:
    """Settings of a run; read by the driver from a JSON object."""

    model: str = ""
    base_url: str = ""
    temperature: float = 0.0
    max_context_chars: int = 18_000
    top_k: int = 8
    candidate_docs: int = 5
    data_dir: str = "data"
    processed_dir: str = "processed_data"
    submission_dir: str = "submission"

    @classmethod
    def load(cls, root: str | Path, config_path: str | Path | None = None) -> Config:
        """Settings of ``config_path``, or of ``config.json`` in ``root`` if there is one; folders are relative to ``root``."""
        root = Path(root)
        path = Path(config_path) if config_path else root / "config.json"
        given = json.loads(path.read_text(encoding="utf-8")) if config_path or path.exists() else {}
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        made = cls(**given)
        return cls(**{f.name: str(root / getattr(made, f.name)) if f.name.endswith("_dir") else getattr(made, f.name) for f in fields(cls)})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a bad one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return document_meta(read_jsonl(spark, path, DOCUMENT_META))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions(read_jsonl(spark, path, QUESTION_ROW))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records; missing titles and domains are empty, missing offsets 0."""
    return read_jsonl(spark, path, CHUNK).fillna({"title": "", "domain": "", "start": 0, "end": 0})


def read_question_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Questions of one JSON array per domain, in the domains' order. A missing file, or one that holds no array, is an error."""
    element = T.ArrayType(QUESTION_ROW)
    files = {}
    for domain in (d for d in DOMAINS if d in paths):
        whole = spark.read.text(paths[domain], wholetext=True)
        parsed = F.from_json("value", element, {"mode": "FAILFAST"})
        checked = F.when(F.ltrim(F.regexp_replace("value", r"^\x{FEFF}", "")).rlike(r"^\s*\["), parsed).otherwise(F.raise_error(F.lit(f"{domain}: not a JSON array")).cast(element))
        files[domain] = whole.select(F.posexplode(checked).alias("pos", "q")).select("pos", "q.*")
    return question_rows(files)


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, content)`` of files, folders taken recursively."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def read_plain(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, doc_id, text)`` of UTF-8 text files."""
    rows = read_files(spark, path, "*.[tT][xX][tT]")
    return rows.select("path", stem(F.col("path")).alias("doc_id"), plain_text(F.decode("content", "UTF-8")).alias("text"))


def read_html(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, doc_id, title, text)`` of HTML files; the title is null if the page has none."""
    rows = read_files(spark, path, "*.[hH][tT][mM]*").select("path", F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "").alias("html"))
    return rows.select("path", stem(F.col("path")).alias("doc_id"), html_title(F.col("html")).alias("title"), html_paragraphs("html").alias("text"))


def read_parses(spark: SparkSession, parsed_dir: str) -> DataFrame:
    """``(model, doc_id, text)`` of ready Markdown at ``<dir>/<model>/<doc_id>.md``."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(f"{parsed_dir}/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return rows.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("model"), stem(path).alias("doc_id"), F.col("value").alias("text"))


def discover_pdfs(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """``(path, doc_id)`` of PDF files and of those below folders, distinct, by path; contents aren't read."""
    rows = read_files(spark, inputs, "*.[pP][dD][fF]").select("path").distinct()
    return rows.select("path", stem(F.col("path")).alias("doc_id")).orderBy("path")


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """``(domain, path, size)`` of the files below ``<root>/<domain>``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return rows.select(F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("domain"), "path", "size")


def page_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``(doc_id, path, text)`` of ``md`` or ``json`` page files below ``<root>/<doc_id>``."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").text(root, wholetext=True)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, rf"/{base}/([^/]+)/", 1).alias("doc_id"), path.alias("path"), F.col("value").alias("text"))


def nonblank(rows: DataFrame) -> DataFrame:
    return rows.where(~is_blank(F.col("text")))


def by_suffix(rows: DataFrame, *endings: str) -> DataFrame:
    return rows.where(suffix(F.col("path")).isin(*endings))
