"""Jobs from a shell: ``python -m tomeflow preprocess | build-datasets | preview | run | parse``."""

from __future__ import annotations

import argparse
import csv
import importlib
import shlex
import sys

from pyspark.sql import SparkSession

from tomeflow.operators.chunking import CHUNK_CHARS, OVERLAP_CHARS
from tomeflow.plans import answering, datasets, preprocess
from tomeflow.schemas import DOMAINS, PARSE_MODELS
from tomeflow.sources import readers, runners, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tomeflow")
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("preprocess", help="raw documents to parsed documents and chunks")
    job.add_argument("--data-dir", default="data")
    job.add_argument("--parsed-dir", default="parsed")
    job.add_argument("--processed-dir", default="processed_data")
    job.add_argument("--chunk-chars", type=int, default=CHUNK_CHARS)
    job.add_argument("--overlap-chars", type=int, default=OVERLAP_CHARS)
    job.add_argument("--pdf-model", default=None)

    job = jobs.add_parser("build-datasets", help="question files and raw files to the catalogue")
    job.add_argument("--questions-dir", required=True, help="folder with <domain>.json")
    job.add_argument("--raw-root", required=True)
    job.add_argument("--out-dir", default="data")
    job.add_argument("--no-stage", action="store_true", help="don't copy the documents' files")

    job = jobs.add_parser("parse", help="PDF files to Markdown, by models that aren't done yet")
    job.add_argument("inputs", nargs="+")
    job.add_argument("--models", nargs="+", default=["pypdf"], choices=PARSE_MODELS)
    job.add_argument("--out-root", default="parsed")
    job.add_argument("--timeout", type=float, default=runners.TIMEOUT)
    job.add_argument("--overwrite", action="store_true")
    job.add_argument("--command", default=None, help="command line of a model without a runner, with {input} and {output}")
    job.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="setting handed to the command")

    for name, about in (("preview", "hits of the first questions"), ("run", "answers of all questions")):
        job = jobs.add_parser(name, help=about)
        job.add_argument("--root", default=".")
        job.add_argument("--config", default=None)
        if name == "preview":
            job.add_argument("--questions", type=int, default=3)
        else:
            job.add_argument("--client", required=True, help="module:function that makes the model's client")
    return top


def _asked(spark: SparkSession, config: readers.Config):
    return readers.read_questions(spark, f"{config.data_dir}/questions.jsonl"), spark.read.parquet(f"{config.processed_dir}/chunks")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tomeflow-{args.job}").getOrCreate()
    if args.job == "preprocess":
        print(preprocess.run(spark, args.data_dir, args.parsed_dir, args.processed_dir, args.chunk_chars, args.overlap_chars, args.pdf_model))
    elif args.job == "build-datasets":
        files = {d: f"{args.questions_dir}/{d}.json" for d in DOMAINS}
        for name, rows in datasets.run(spark, files, args.raw_root, args.out_dir, not args.no_stage).items():
            print(name, *[" ".join(str(x) for x in r) for r in rows], sep="\n")
    elif args.job == "parse":
        for model in args.models:
            if args.command:
                command, options = shlex.split(args.command), runners.settings(args.set)
                runners.register(model, lambda: runners.CommandRunner(command, options=options))
            found = preprocess.parse_new(spark, args.inputs, model, preprocess.qualified(spark, args.out_root), args.timeout, args.overwrite)
            print(model, {("ok" if r.ok else "failed"): r["count"] for r in found.groupBy("ok").count().collect()})
    elif args.job == "preview":
        config = readers.Config.load(args.root, args.config)
        questions, chunks = _asked(spark, config)
        hits = answering.retrieve(questions.orderBy("qid").limit(args.questions), chunks, config.top_k, config.candidate_docs)
        out = csv.writer(sys.stdout)
        for r in hits.orderBy("qid", "rank").select("qid", "rank", "score", "chunk_id", "text").collect():
            out.writerow([r.qid, r.rank, r.score, r.chunk_id, " ".join(r.text.split())[:80]])
    else:
        config = readers.Config.load(args.root, args.config)
        module, _, name = args.client.partition(":")
        questions, chunks = _asked(spark, config)
        answers, kept = answering.answer(questions, chunks, getattr(importlib.import_module(module), name), config.top_k, config.candidate_docs, config.max_context_chars)
        writers.write_answer_csv(answers, f"{config.submission_dir}/answers")
        writers.write_evidence(kept, f"{config.submission_dir}/evidence")
    return 0


if __name__ == "__main__":
    sys.exit(main())
