"""External parsers and models as pluggable per-partition runners.

A runner is made once in each partition by its factory, called once a row, and
closed. What it raises becomes a row with ``ok`` false and the error; the others
go on. Calls that exceed ``timeout`` seconds count as failed (0: no limit).
"""

from __future__ import annotations

import queue
import re
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.functions.text import normalize_markdown, normalize_text_layer
from tomeflow.functions.trees import markdown_strings
from tomeflow.operators.parses import marked_pages

RUNNERS: dict[str, Callable[[], Any]] = {}
TIMEOUT = 1800.0


def register(model: str, factory: Callable[[], Any]) -> None:
    """Make ``factory`` the source of runners for a model; a runner has ``parse(content)``, which gives Markdown or a list of pages, and may have ``close()``."""
    RUNNERS[model] = factory


def runner_for(model: str) -> Callable[[], Any]:
    if model not in RUNNERS:
        raise ValueError(f"unknown model: {model}")
    return RUNNERS[model]


def _timed(call: Callable[[], Any], timeout: float) -> Any:
    """``call()``; after ``timeout`` seconds it is left alone, on a thread that doesn't keep the worker from ending."""
    if not timeout:
        return call()
    done: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            done.put((call(), None))
        except Exception as e:  # noqa: BLE001  handed to the caller
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = done.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"over {timeout:g} s") from None
    if error is not None:
        raise error
    return value


_PARSED = "ok boolean, model string, doc_id string, path string, pages array<string>, whole boolean, error string, seconds double"


def parse_files(files: DataFrame, model: str, timeout: float = TIMEOUT) -> DataFrame:
    """``(ok, model, doc_id, path, text, page_count, blank_pages, error, seconds)`` of ``files (doc_id, path, content)``.

    A runner returns a file's Markdown, or the list of its pages' text layers:
    these are repaired one by one and joined under markers with their rank among
    the pages that have text; the others are listed as blank. A file without any
    text is an error. After a timeout the next file gets a new runner.
    """
    factory = runner_for(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = None
        try:
            for batch in batches:
                rows = []
                for doc_id, path, content in zip(batch.doc_id, batch.path, batch.content, strict=True):
                    began = time.time()
                    pages, whole, error = None, False, None
                    try:
                        runner = runner or factory()
                        text = _timed(lambda r=runner, c=content: r.parse(c), timeout)
                        pages, whole = ([text], True) if isinstance(text, str) else (None if text is None else list(text), False)
                    except Exception as e:  # noqa: BLE001  an error row, whatever went wrong
                        error = f"{type(e).__name__}: {e}"
                        if isinstance(e, TimeoutError):
                            runner = None
                    rows.append((error is None, model, doc_id, path, pages, whole, error, round(time.time() - began, 3)))
                yield pd.DataFrame(rows, columns=["ok", "model", "doc_id", "path", "pages", "whole", "error", "seconds"])
        finally:
            if runner is not None and hasattr(runner, "close"):
                runner.close()

    parsed = files.select("doc_id", "path", "content").mapInPandas(run, _PARSED)
    pages = F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.when(F.col("whole"), normalize_markdown(p)).otherwise(normalize_text_layer(F.coalesce(p, F.lit("")))))
    parsed = parsed.withColumn("pages", pages)
    text = F.when(F.col("whole"), F.get("pages", 0)).otherwise(marked_pages(F.filter("pages", lambda p: p != "")))
    blank = F.filter(F.transform("pages", lambda p, i: F.when(p == "", i + 1)), lambda i: i.isNotNull())
    none = F.col("error").isNull() & (F.col("text") == "")
    return parsed.withColumn("text", text).select(
        (F.col("ok") & (F.col("text") != "")).alias("ok"), "model", "doc_id", "path", F.when(F.col("text") != "", F.col("text")).alias("text"),
        F.when(~F.col("whole"), F.size("pages")).alias("page_count"), F.when(~F.col("whole"), blank).alias("blank_pages"), F.when(none, F.lit("ValueError: no text")).otherwise(F.col("error")).alias("error"), "seconds",
    )


def split_pages(files: DataFrame, factory: Callable[[], Callable[[bytes], Iterator[bytes]]]) -> DataFrame:
    """``(doc_id, path, page, content, error)``: a row a page, by a splitter or renderer made once a partition.

    The splitter maps a file to its pages, in order; they are numbered from 1. A
    file that it fails on gives one row with page 0 and the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = None
        columns = ["doc_id", "path", "page", "content", "error"]
        for batch in batches:
            for doc_id, path, content in zip(batch.doc_id, batch.path, batch.content, strict=True):
                try:
                    split = split or factory()
                    for n, page in enumerate(split(content), 1):
                        yield pd.DataFrame([(doc_id, path, n, page, None)], columns=columns)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(doc_id, path, 0, None, f"{type(e).__name__}: {e}")], columns=columns)

    return files.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, page int, content binary, error string")


def settings(given: list[str]) -> dict[str, str]:
    """``KEY=VALUE`` options; an error where either is empty."""
    out = {}
    for item in given:
        key, sep, value = item.partition("=")
        if not (sep and key and value):
            raise ValueError(f"expected KEY=VALUE, got {item!r}")
        out[key] = value
    return out


class CommandRunner:
    """A parser that is a command: ``{input}`` and ``{output}`` in it stand for the file and a folder for results.

    Markdown files in the folder, in natural order, are the text; where none has
    any, the Markdown strings of its JSON files are. The worker's own temporary
    folder holds both for the time of one call. A failed command's last words
    become the error.
    """

    def __init__(self, command: list[str], ending: str = ".pdf", options: dict[str, str] | None = None, option: str = "--set") -> None:
        self.command = [*command, *(x for k, v in (options or {}).items() for x in (option, f"{k}={v}"))]
        self.ending = ending

    def parse(self, content: bytes) -> str:
        with tempfile.TemporaryDirectory() as folder:
            given, out = Path(folder, f"input{self.ending}"), Path(folder, "output")
            given.write_bytes(content)
            out.mkdir()
            done = subprocess.run([x.format(input=given, output=out) for x in self.command], capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
            if done.returncode:
                raise RuntimeError(f"exit {done.returncode}: {(done.stderr or done.stdout).strip()[-500:]}")
            found = sorted((p for p in out.rglob("*") if p.suffix in (".md", ".json")), key=lambda p: ([(0, int(x), "") if x.isdecimal() else (1, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", p.stem)], str(p)))
            read = lambda kind: [p.read_text(encoding="utf-8", errors="replace") for p in found if p.suffix == kind]
            texts = [t.strip() for t in read(".md")]
            if not any(texts):
                texts = [s.strip() for t in read(".json") for s in markdown_strings(t)]
            return "\n\n".join(t for t in texts if t)


def chat(prompts: DataFrame, factory: Callable[[], Callable[[str, str], dict]], system: str) -> DataFrame:
    """``(qid, answer_format, raw, prompt_tokens, completion_tokens, error)`` of ``prompts (qid, answer_format, prompt)``.

    The client, made once a partition, maps system and user prompt to a dict
    with ``content``, ``prompt_tokens`` and ``completion_tokens``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            rows = []
            for qid, answer_format, prompt in zip(batch.qid, batch.answer_format, batch.prompt, strict=True):
                try:
                    client = client or factory()
                    said = client(system, prompt)
                    rows.append((qid, answer_format, said["content"], int(said["prompt_tokens"]), int(said["completion_tokens"]), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((qid, answer_format, "", 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["qid", "answer_format", "raw", "prompt_tokens", "completion_tokens", "error"])

    return prompts.select("qid", "answer_format", "prompt").mapInPandas(run, "qid string, answer_format string, raw string, prompt_tokens long, completion_tokens long, error string")


class TextLayer:
    """Text layer of PDFs, where a reader for them is installed."""

    def __init__(self) -> None:
        try:
            import pypdf
        except ImportError as e:
            raise RuntimeError("the pypdf runner needs pypdf") from e
        self.reader = pypdf.PdfReader

    def parse(self, content: bytes) -> list[str]:
        import io

        return [page.extract_text() or "" for page in self.reader(io.BytesIO(content)).pages]


register("pypdf", TextLayer)
