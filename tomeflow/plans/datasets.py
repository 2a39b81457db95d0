"""Official question files and raw files to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.operators.catalog import counts_by, document_rows, documents_by_domain, domain_rank, referenced_docs, resolve_docs, stem_index, validated_questions
from tomeflow.sources.readers import raw_files, read_question_files
from tomeflow.sources.writers import stage_files, write_jsonl


def build(questions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(questions, documents)``, both validated; questions carry ``ord``, documents their place of first reference."""
    checked = validated_questions(questions)
    ordered = checked.withColumn("ord", F.col("domain_no").cast("long") * 1_000_000_000 + F.col("pos"))
    resolved = resolve_docs(referenced_docs(ordered), stem_index(files))
    documents = document_rows(resolved).withColumn("domain_no", domain_rank(F.col("domain")))
    return ordered.drop("file_domain", "domain_no", "pos"), documents


def run(spark: SparkSession, question_files: dict[str, str], raw_root: str, out_dir: str, stage: bool = False) -> dict[str, list]:
    """Write ``questions`` and ``documents`` as JSON lines, with ``stage`` also the documents' files; returns the report's rows."""
    questions, documents = build(read_question_files(spark, question_files), raw_files(spark, raw_root))
    write_jsonl(questions.withColumnRenamed("ord", "__ord"), f"{out_dir}/questions.jsonl", ["__ord"], single=True)
    ordered = documents.select("doc_id", "path", "title", "domain", F.struct("domain_no", "first_question", "first_pos").alias("__ord"))
    write_jsonl(ordered, f"{out_dir}/documents.jsonl", ["__ord"], single=True)
    if stage:
        copied = stage_files(documents.select("doc_id", "path", F.url_decode(F.replace("source", F.lit("+"), F.lit("%2B"))).alias("source")), out_dir)
        copied.agg(F.sum(F.col("copied").cast("long"))).collect()
    return {"questions": counts_by(questions).orderBy("domain", "answer_format").collect(), "documents": documents_by_domain(documents).collect()}
