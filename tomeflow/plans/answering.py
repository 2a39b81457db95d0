"""Questions to answers: retrieve, assemble evidence, ask, normalize, score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeflow.functions.tokens import SYSTEM_PROMPT, user_prompt
from tomeflow.operators.retrieval import CANDIDATE_DOCS, CONTEXT_CHARS, TOP_K, candidate_docs, evidence, evidence_blocks, search
from tomeflow.operators.scoring import answer_rows, with_summary
from tomeflow.sources.runners import chat

#: Hits from which the candidate documents of a question without documents are taken.
POOL = 50


def retrieve(questions: DataFrame, chunks: DataFrame, top_k: int = TOP_K, candidates: int = CANDIDATE_DOCS) -> DataFrame:
    """Hits within a question's documents; where it names none, within its candidate documents."""
    named = questions.select("qid", F.explode("doc_ids").alias("doc_id"))
    blind = questions.where(F.size("doc_ids") <= 0)
    pool = candidate_docs(search(blind, chunks, POOL), candidates).select("qid", "doc_id")
    return search(questions, chunks, top_k, named.unionByName(pool))


def prompts(questions: DataFrame, hits: DataFrame, max_context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``(qid, answer_format, prompt)``; a question without hits is asked without evidence."""
    blocks = evidence_blocks(evidence(hits, max_context_chars))
    joined = questions.join(blocks, "qid", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    return joined.select("qid", "answer_format", user_prompt(F.col("question"), F.col("options"), F.col("answer_format"), F.col("blocks")).alias("prompt"))


def answer(questions: DataFrame, chunks: DataFrame, client: Callable[[], Callable[[str, str], dict]], top_k: int = TOP_K, candidates: int = CANDIDATE_DOCS, max_context_chars: int = CONTEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(answers, hits)``: answer records with a summary row, and the evidence they rest on."""
    hits = retrieve(questions, chunks, top_k, candidates)
    said = chat(prompts(questions, hits, max_context_chars), client, SYSTEM_PROMPT)
    content = F.get_json_object(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "$.answer")
    answers = answer_rows(said.withColumn("raw", F.coalesce(content, F.col("raw"))))
    return with_summary(answers), evidence(hits, max_context_chars)
