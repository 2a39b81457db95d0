"""The operators of this package as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.llm import decontaminate, html_text, langid, mixing, ngram_lm, nndescent, pii, simhash, suffix_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, one row per pair."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_key")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, thresholds and decision for every document."""
    return ngram_lm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_key")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a crawl made of all pages; times and headers as text."""
    out = warc.resolve(warc.records_of_pages(_table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("headers", fields).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("at", "resolved_at")})


def op7_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_mixing, op4_quality, op5_pii, op6_warc, op7_nndescent, op8_suffix_dedup, op9_html_text, op10_langid)
}

#: The others have no SQL form: hashing, models, graphs and parsers; their tests are against brute force.
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.oracle(), "op6_warc": warc.oracle()}
