"""Shared pieces of the training-data operators.

* ``cut`` ends a lineage in the cluster's shared checkpoint folder.
* ``connected_components`` labels links by the smallest reachable id.
* ``sorted_groups`` streams the groups of a hash-partitioned, sorted frame.
* ``Fold`` / ``row_slices`` bound what one Python worker holds at a time.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of a NumPy kernel takes at a time.
SLICE_BYTES = 4 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local session that names none gets a folder of this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tomeflow-checkpoints")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` units each; one row is never split here."""
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of a string or binary column; nulls read as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables that hold whole groups each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        last = values[batch.num_rows - 1]
        if held and values[0].equals(last) and held[-1].column(key)[held[-1].num_rows - 1].equals(last):
            held.append(batch)
            continue
        keys = np.asarray(values)
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        if start:
            held.append(batch.slice(0, start))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, key: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *, then: tuple[str, ...] = ()) -> DataFrame:
    """Hash-partition by ``key``, sort, and stream each partition through ``fn``."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *then).mapInArrow(fn, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is its smallest id.

    Large-star and small-star rounds: each round is an aggregation that combines
    on the map side and an equi-join that AQE may split, so that a hub of any
    degree is never gathered in one task. Nulls and self-loops are ignored. An
    error if ``max_rounds`` don't settle it.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null and hi > lo").distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x")).select("x.*").where("hi > lo").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return nodes.unionByName(roots)


#: Rows up to which a small side may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def row_key() -> Column:
    """128-bit key of a document's row by id and text; null ids and repeated ids stay apart, null text is as empty."""
    doc_id = F.col("doc_id").cast("string")
    return F.md5(F.concat_ws("|", F.when(doc_id.isNull(), "n").otherwise("i"), doc_id, F.col("text").cast("string")).cast("binary"))


def keep_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the rows whose ``row_key`` is in ``keys``."""
    keys = cut(keys.select(F.col("row_key").alias("__key")).distinct())
    side = F.broadcast(keys) if small_enough(keys) else keys
    return docs.withColumn("__key", row_key()).join(side, "__key", how).select(*docs.columns)
