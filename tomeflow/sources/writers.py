"""Writers: Parquet tables for the engine, and the exchange formats."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, order_by: list[str] | None = None, single: bool = False) -> None:
    """JSON lines with nulls and non-ASCII kept. Files sort in the order of ``order_by``; ``single`` makes one file of a small table."""
    ordered = df.orderBy(*order_by) if order_by else df
    drop = [c for c in order_by or [] if c.startswith("__")]
    lines = ordered.select(F.to_json(F.struct(*[c for c in df.columns if c not in drop]), {"ignoreNullFields": "false"}).alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def write_answer_csv(rows: DataFrame, path: str) -> None:
    """Answer rows with a header line, the summary first, then by question; one file, as there is a row per question."""
    columns = ["qid", "answer", "prompt_tokens", "completion_tokens", "total_tokens"]
    rows.orderBy("ord", "qid").select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_evidence(kept: DataFrame, path: str) -> None:
    """Evidence of each question as JSON lines: ``qid`` and its list of document, clause and reasoning."""
    item = F.struct("doc_id", F.col("text").alias("quoted_clause"), F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(", score "), F.col("score").cast("string")).alias("reasoning"))
    rows = kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("evidence"))
    write_jsonl(rows, path, ["qid"])


def _folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a shared folder, given as a URI or an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _put(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """Write under another name first, so that a lost task leaves no half file."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        out.write(data)
    fs.move(f"{path}.part", path)


def _remove(fs: pyarrow.fs.FileSystem, path: str) -> None:
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(path)


def write_parses(results: DataFrame, root: str) -> DataFrame:
    """Parse results as files: ``<root>/<model>/<doc_id>.md`` with ``.meta.json``, or ``.error.txt`` for those that failed.

    Returns what was written, ``(model, doc_id, ok, markdown_path)``; reading it
    does the writing, on the workers, into a folder that all of them share. A
    result that is fine removes the error file of an earlier try.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder(root)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                stem = f"{base.rstrip('/')}/{r.model}/{r.doc_id}"
                meta = {"ok": bool(r.ok), "model": r.model, "doc_id": r.doc_id, "pdf_path": r.path}
                if r.ok:
                    _put(fs, f"{stem}.md", f"{r.text}\n".encode())
                    meta |= {"markdown_path": f"{stem}.md", "seconds": r.seconds}
                    if r.page_count == r.page_count and r.page_count is not None:
                        meta |= {"pages": int(r.page_count), "blank_pages": [int(p) for p in r.blank_pages]}
                else:
                    _put(fs, f"{stem}.error.txt", f"{r.error}\n".encode())
                    meta |= {"seconds": r.seconds, "error": r.error}
                _put(fs, f"{stem}.meta.json", json.dumps(meta, ensure_ascii=False, indent=2).encode())
                if r.ok:
                    _remove(fs, f"{stem}.error.txt")
                rows.append((r.model, r.doc_id, bool(r.ok), meta.get("markdown_path")))
            yield pd.DataFrame(rows, columns=["model", "doc_id", "ok", "markdown_path"])

    columns = ["ok", "model", "doc_id", "path", "text", "page_count", "blank_pages", "error", "seconds"]
    return results.select(*columns).mapInPandas(run, "model string, doc_id string, ok boolean, markdown_path string")


def write_page_texts(pages: DataFrame, root: str) -> DataFrame:
    """Each page of ``(doc_id, page, text)`` as ``<root>/<doc_id>/pages_text/page_NNNN.txt``; returns ``(doc_id, page, path)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder(root)
        for batch in batches:
            rows = []
            for doc_id, page, text in zip(batch.doc_id, batch.page, batch.text, strict=True):
                path = f"{base.rstrip('/')}/{doc_id}/pages_text/page_{int(page):04d}.txt"
                _put(fs, path, f"{text or ''}\n".encode())
                rows.append((doc_id, int(page), path))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "path"])

    return pages.select("doc_id", "page", "text").mapInPandas(run, "doc_id string, page int, path string")


def stage_files(documents: DataFrame, out_dir: str) -> DataFrame:
    """Copy ``source`` of each document to ``<out_dir>/<path>`` unless a file of the same size is there; ``(doc_id, path, copied)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _folder(out_dir)
        for batch in batches:
            rows = []
            for doc_id, path, source in zip(batch.doc_id, batch.path, batch.source, strict=True):
                from_fs, given = _folder(source)
                target = f"{base.rstrip('/')}/{path}"
                there, size = fs.get_file_info(target), from_fs.get_file_info(given).size
                copied = there.type != pyarrow.fs.FileType.File or there.size != size
                if copied:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    pyarrow.fs.copy_files(given, f"{target}.part", source_filesystem=from_fs, destination_filesystem=fs)
                    fs.move(f"{target}.part", target)
                rows.append((doc_id, path, copied))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "copied"])

    return documents.select("doc_id", "path", "source").mapInPandas(run, "doc_id string, path string, copied boolean")
