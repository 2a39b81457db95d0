"""Lexical retrieval (Okapi BM25) of chunks and documents for questions.

Chunks are reduced to the questions' terms before anything is shuffled; the
terms are broadcast while they are few (``BROADCAST_TERMS``), and joined by
shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.functions.tokens import query_text, tokenize

K1, B = 1.2, 0.75
TOP_K, CANDIDATE_DOCS, CONTEXT_CHARS = 8, 5, 18_000
DIGITS = 4
BROADCAST_TERMS = 200_000


def small_side(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """``rows``, marked for broadcast if they are at most ``limit``, and whether they are."""
    few = rows.limit(limit + 1).count() <= limit
    return (F.broadcast(rows) if few else rows), few


def question_terms(questions: DataFrame) -> DataFrame:
    """``(qid, term)`` of ``questions (qid, question, options)``, distinct."""
    return questions.select("qid", F.explode(F.array_distinct(tokenize(query_text(F.col("question"), F.col("options"))))).alias("term"))


def search(questions: DataFrame, chunks: DataFrame, top_k: int = TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """``(qid, rank, score)`` and the chunk's columns: the ``top_k`` best chunks of each question.

    ``allowed (qid, doc_id)`` restricts a question to its documents; questions
    that it doesn't name stay free. Frequencies are those of all ``chunks``. Ties
    go by chunk id.

    The chunks are made once for the terms that questions have, a row a chunk;
    document frequencies and scores read that one exchange, and no shuffle is keyed
    on a term. The best of each partition are taken before the best of all; only
    documents that have one are chunked again for their columns.
    """
    terms = question_terms(questions)
    counter = terms.sparkSession.createDataFrame([("",)], "term string")  # a term that each chunk has once
    wanted, few = small_side(terms.select("term").unionByName(counter).distinct(), BROADCAST_TERMS)
    words = chunks.select(F.struct("chunk_id", "doc_id").alias("chunk"), tokenize(F.col("text")).alias("words"))
    said = words.select("chunk", F.size("words").alias("size"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    said = said.join(wanted, "term", "left_semi").groupBy("chunk", "size").agg(F.collect_list("term").alias("terms"))
    postings = said.select("chunk", "size", F.explode_outer("terms").alias("term")).groupBy("chunk", "size", "term").agg(F.count("*").alias("tf"))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("size").alias("sizes"))
    counted = F.max(F.when(F.col("term") == "", F.col("df")))
    total = frequencies.agg(counted.alias("total"), (F.max(F.when(F.col("term") == "", F.col("sizes"))) / counted).alias("mean"))
    asked = frequencies.select("term", "df").join(terms.groupBy("term").agg(F.collect_list("qid").alias("qids")), "term")
    asked = asked.crossJoin(F.broadcast(total)).withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0))
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    hits = postings.join(F.broadcast(asked) if few else asked, "term").select("chunk", "size", part.alias("part"), F.explode("qids").alias("qid"))
    scored = hits.groupBy("qid", "chunk", "size").agg(F.round(F.sum("part"), DIGITS).alias("score")).select("qid", "chunk.*", "score")
    if allowed is not None:
        named = allowed.select("qid").distinct().withColumn("named", F.lit(True))
        may = allowed.select("qid", F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("may", F.lit(True))
        scored = scored.join(named, "qid", "left").join(may, ["qid", "doc_id"], "left").where("named is null or may")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("qid", "rank", "score", "chunk_id", "doc_id")
    texts = chunks.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    return best.join(texts, ["chunk_id", "doc_id"]).select("qid", "rank", "score", *chunks.columns)


def candidate_docs(hits: DataFrame, limit: int = CANDIDATE_DOCS) -> DataFrame:
    """``(qid, doc_id, score, rank)``: each question's documents by their best chunk, ties by id."""
    best = hits.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def evidence(hits: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Hits in rank order while their texts fit ``max_chars`` together; ``used`` is the sum so far."""
    so_far = F.sum(F.length("text")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", so_far).where(F.col("used") <= max_chars)


def evidence_blocks(kept: DataFrame) -> DataFrame:
    """``(qid, blocks)``: the texts of each question's evidence, in order, each under its document."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text")))
    return kept.groupBy("qid").agg(F.transform(listed, lambda x: F.concat(F.lit("["), x["doc_id"], F.lit("]\n"), x["text"])).alias("blocks"))


def recall_at_k(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """``(qid, recall)``: share of a question's target documents ``(qid, doc_id)`` among its hits."""
    found = hits.select("qid", F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("hit", F.lit(1.0))
    wanted = targets.select("qid", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return wanted.join(found, ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
