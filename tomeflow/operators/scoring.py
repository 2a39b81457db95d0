"""Answers, token sums and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.functions.answers import final_score, is_valid_answer, normalize_answer, token_score


def answer_rows(results: DataFrame) -> DataFrame:
    """Answer records of ``results (qid, answer_format, raw, prompt_tokens, completion_tokens)``; ``valid`` says if the letters fit the format."""
    answer = normalize_answer(F.col("raw"), F.col("answer_format"))
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return results.select("qid", answer.alias("answer"), F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens"), total.cast("long").alias("total_tokens"), is_valid_answer(answer, F.col("answer_format")).alias("valid"))


def with_summary(answers: DataFrame) -> DataFrame:
    """The answers and a row ``summary`` with the token sums, to be written first (``ord`` 0)."""
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    rows = answers.select(F.lit(1).alias("ord"), "qid", "answer", *tokens)
    summary = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens]).select(F.lit(0).alias("ord"), F.lit("summary").alias("qid"), F.lit("").alias("answer"), *tokens)
    return summary.unionByName(rows)


def graded(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``gold (qid, domain, answer_format, answer)`` with ``correct``; questions without an answer are wrong."""
    said = answers.select("qid", F.col("answer").alias("__said"))
    return gold.join(said, "qid", "left").withColumn("correct", F.coalesce(F.col("__said") == F.col("answer"), F.lit(False))).drop("__said")


def accuracy(grades: DataFrame) -> DataFrame:
    """``(domain, answer_format, n, accuracy)`` by both, by each, and overall (nulls)."""
    return grades.cube("domain", "answer_format").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def score(grades: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: accuracy, tokens, token score and final score."""
    tokens = answers.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")).first()[0]
    return grades.agg(F.avg(F.col("correct").cast("double")).alias("accuracy")).select("accuracy", F.lit(int(tokens)).alias("tokens"), token_score(F.lit(int(tokens))).alias("token_score"), final_score(F.col("accuracy"), F.lit(int(tokens))).alias("final_score"))
