"""Incremental runs: only files that no earlier run has seen, with exactly-once bookkeeping by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tomeflow.operators.chunking import CHUNK_CHARS, OVERLAP_CHARS, make_chunks
from tomeflow.schemas import PARSED_DOCUMENT


def chunk_new_documents(spark: SparkSession, source: str, target: str, checkpoint: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> StreamingQuery:
    """Chunk the parsed documents (Parquet) that arrived in ``source`` since the last run into ``target``, then end."""
    arrived = spark.readStream.schema(PARSED_DOCUMENT).parquet(source)
    return make_chunks(arrived, chunk_chars, overlap_chars).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def without_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
