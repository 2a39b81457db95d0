"""Near-duplicate embeddings by NN-descent.

Vectors of equal bits collapse to a class first. Then:

1. Start: in each of ``TABLES`` tables, vectors are sorted by a signature of
   random hyperplanes and cut into runs of ``RUN``; within a run every vector
   keeps its ``K`` nearest. Ties in the signature are dealt by a hash, so that no
   signature can fill a task.
2. Descent: each vector brings its neighbours and those that name it together
   (neighbours of neighbours), and each keeps the nearest seen. Lists whose
   ``K``-th entry still reaches the threshold are saturated: they are enlarged to
   the ``WIDE`` nearest that reach it, and all of these take part in the rounds
   that follow, the nearest together and the others in parts of that size, dealt
   anew each round. Rounds end when under ``SETTLED`` of the entries change.
3. Audit: ``AUDIT`` vectors of all and as many of those that have links are
   compared with all others. While recall of links is under ``RECALL``, or no link
   was compared, further tables and rounds follow (``MORE`` times at most). Then
   recall under ``LEAST_RECALL`` is an error; what else is short of ``RECALL``, or
   couldn't be measured, is a warning.
4. Edges at the threshold give the components. Within a component, where all
   links of its members lie, blocks of ``BLOCK`` vectors are compared to count
   each member's links exactly, so that lists bound no vector's links; no pair is
   written.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and stay; so do rows with a null id (their component
is null); vectors of different lengths never link; repeated rows come back as
often as they came in and are no links of each other, as the id is the same.
Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.llm.common import by_key, connected_components, cut, sorted_groups

THRESHOLD = 0.95
K = 10
WIDE = 80
TABLES = 8
RUN = 64
ROUNDS = 4
SETTLED = 0.01
AUDIT = 256
RECALL = 0.999
LEAST_RECALL = 0.9
MORE = 3
BLOCK = 1024


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of ``raw`` as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ids, classes)``: ``(vec_id, data)`` of the usable rows, and ``(id, data, dim, size)`` of equal vectors."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            lists = b.column(1)
            for i, key in enumerate(b.column(0).to_pylist()):
                item = lists[i].values if lists[i].is_valid else None
                if key is None or item is None or not len(item) or item.null_count:
                    continue
                x = np.asarray(item.cast(pa.float32() if single else pa.float64())) + kind(0)  # -0 is 0
                if np.isfinite(x).all() and x.any():
                    ids.append(key)
                    rows.append(x.astype(kind).tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "data"])

    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).mapInArrow(run, "vec_id long, data binary").distinct()
    usable = cut(usable)
    width = kind().itemsize
    grouped = usable.groupBy("data").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    return usable, cut(grouped.select("id", "data", (F.octet_length("data") / width).cast("int").alias("dim"), "size", F.lit(width).alias("width")))


def _matrix(data: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = data.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32 if width == 4 else np.float64).reshape(len(rows), -1)


def _planes(table: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([table, dim])).standard_normal((dim, 32))


def signatures(nodes: DataFrame, tables: range) -> DataFrame:
    """Each vector once per table, with its place in the table's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, width = np.asarray(b.column("dim")), b.column("width")
            for dim in np.unique(dims):
                rows = b.filter(pa.array(dims == dim))
                x = _unit(_matrix(rows.column("data"), width[0].as_py()))
                for t in tables:
                    bits = x @ _planes(t, int(dim)) > 0
                    sig = np.packbits(bits, axis=1).view(">u4").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), rows.column("dim"), pa.array(sig), rows.column("id"), rows.column("data"), rows.column("width")], names=["table", "dim", "sig", "id", "data", "width"])

    return nodes.select("id", "data", "dim", "width").mapInArrow(run, "table int, dim int, sig long, id long, data binary, width int").withColumn("tie", F.xxhash64("id", "table"))


_LIST = "u long, v long, sim double"


def _nearest(ids: np.ndarray, sims: np.ndarray, floor: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` largest above its floor, and all that reach the threshold."""
    n = len(ids)
    np.fill_diagonal(sims, -2)
    want = sims >= threshold
    if n > k + 1:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        want[np.arange(n)[:, None], part] = True
    else:
        want[:] = True
    want &= sims > floor[:, None]
    i, j = np.nonzero(want)
    return ids[i], ids[j], sims[i, j]


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["u", "v", "sim"])


def start(nodes: DataFrame, tables: range, k: int, threshold: float, run_size: int = RUN) -> DataFrame:
    """Neighbours within runs of the sorted signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table, last: bool):
            order = np.asarray(rows.column("table")).astype(np.int64) << 32 | np.asarray(rows.column("dim"))
            starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]])
            out, done = [], 0
            for lo, hi in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                for a in range(lo, hi, run_size):
                    z = min(hi, a + run_size)
                    if z == len(order) and z - a < run_size and not last:
                        return out, a
                    part = rows.slice(a, z - a)
                    x = _unit(_matrix(part.column("data"), part.column("width")[0].as_py()))
                    ids = np.asarray(part.column("id"))
                    out.append(_nearest(ids, x @ x.T, np.full(len(ids), -1.5), k, threshold))
                    done = z
            return out, done

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * run_size:
                continue
            rows = pa.Table.from_batches(held)
            out, done = pairs(rows, False)
            if out:
                yield _batch(out)
            held = rows.slice(done).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            out, _ = pairs(pa.Table.from_batches(held), True)
            if out:
                yield _batch(out)

    place = ["table", "dim", "sig", "tie"]
    return signatures(nodes, tables).repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, _LIST)


def trimmed(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """With ``nth``: the ``k`` nearest of each list, and of saturated ones up to ``WIDE`` that reach the threshold."""
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    first = lists.withColumn("nth", nth).where(F.col("nth") <= max(WIDE, k))  # kept in each task before the shuffle
    return first.where((F.col("nth") <= k) | (F.col("sim") >= threshold))


def best(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """The trimmed lists of pairs that may repeat."""
    return trimmed(lists.groupBy("u", "v").agg(F.max("sim").alias("sim")), k, threshold).drop("nth")


def descend(nodes: DataFrame, lists: DataFrame, k: int, threshold: float, nth_round: int = 0) -> DataFrame:
    """Nearer neighbours found among the neighbours, either way, of each vector of ``lists (u, v, sim, new)``.

    A vector around which nothing is new brings nobody together, so its neighbours'
    vectors stay where they are.
    """
    both = lists.unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "new"))
    pairs = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
    around = Window.partitionBy("u")
    near = trimmed(pairs, 2 * k, threshold).withColumn("size", F.count("*").over(around)).withColumn("fresh", F.max("new").over(around)).where("fresh = 1 and size > 1")
    parts = F.ceil(F.col("size") / (2 * k)) - 1
    part = F.when(F.col("nth") <= 2 * k, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("u", "v", F.lit(nth_round)), parts)).cast("int")
    centre = near.select(F.xxhash64("u", part).alias("u"), F.col("v").alias("member"))
    floor = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    # a full list takes what is nearer than its last; a saturated one that has room what reaches the threshold
    least = F.when(F.col("n") >= max(WIDE, k), F.col("least")).otherwise(F.least("least", F.lit(float(np.nextafter(threshold, -1)))))
    floor = floor.select(F.col("u").alias("id"), F.when(F.col("n") >= k, least).otherwise(-1.5).alias("floor"))
    data = nodes.select("id", "data", "dim", "width").join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.5)))
    joined = centre.join(data, centre.member == data.id).select("u", "id", "data", "dim", "width", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "u"):
            rows = rows.combine_chunks()
            u = np.asarray(rows.column("u"))
            starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            width = rows.column("width")[0].as_py()
            ids, floors, dims = (np.asarray(rows.column(c)) for c in ("id", "floor", "dim"))
            same = dims.min() == dims.max()
            x = _unit(_matrix(rows.column("data"), width)) if same else None
            out = []
            for lo, hi in zip(starts, np.r_[starts[1:], len(u)], strict=True):
                if hi - lo < 2:
                    continue
                own = x[lo:hi] if same else _unit(_matrix(rows.column("data").slice(lo, hi - lo), width))
                out.append(_nearest(ids[lo:hi], own @ own.T, floors[lo:hi], k, threshold))
            if out:
                yield _batch(out)

    return by_key(joined, "u", run, _LIST)


def audit(nodes: DataFrame, lists: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[int, float]:
    """``(links, recall)``: the links of sampled vectors, found by comparing them with all, and the share of them within the components ``lists (node, component)``.

    ``sample`` vectors are of all, and ``sample`` of those in components.
    """
    order = (F.xxhash64("id"), "id")
    columns = ["id", "data", "width"]
    linked = nodes.join(lists.select(F.col("node").alias("id")).orderBy(*order).limit(sample), "id", "left_semi")
    queries = nodes.orderBy(*order).limit(sample).select(*columns).unionByName(linked.select(*columns)).distinct().collect()
    sent = nodes.sparkSession.sparkContext.broadcast([(r.id, bytes(r.data), r.width) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[list[int], list[bytes]]] = {}
        for key, data, _ in sent.value:
            ids, rows = by_dim.setdefault(len(data), ([], []))
            ids.append(key)
            rows.append(data)
        for b in batches:
            width = b.column("width")[0].as_py() if b.num_rows else 4
            sizes = np.array([len(d) for d in b.column("data").to_pylist()])
            for size, (ids, rows) in by_dim.items():
                part = b.filter(pa.array(sizes == size))
                if part.num_rows:
                    q = _unit(_matrix(pa.array(rows, pa.binary()), width))
                    i, j = np.nonzero(q @ _unit(_matrix(part.column("data"), width)).T >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[i]), pa.array(np.asarray(part.column("id"))[j])], names=["u", "v"])

    true = nodes.select("id", "data", "width").mapInArrow(run, "u long, v long").where("u != v")
    comps = lists
    found = true.join(comps.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(comps.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    n, got = found.agg(F.count("*"), F.sum((F.col("cu") == F.col("cv")).cast("long"))).first()
    return n, (got or 0) / n if n else 1.0


def count_links(nodes: DataFrame, comps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(id, n)``: members linked to each vector; vectors of a component meet in blocks."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("members"))
    placed = comps.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = nodes.join(placed, nodes.id == placed.node).select("id", "data", "dim", "width", "size", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("key", F.xxhash64("component", "lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "key"):
            rows = rows.combine_chunks()
            key = np.asarray(rows.column("key"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ids, size, own, lo_block, hi_block, comp = (np.asarray(rows.column(c)) for c in ("id", "size", "own", "lo", "hi", "component"))
            x = _unit(_matrix(rows.column("data"), rows.column("width")[0].as_py())) if len(set(rows.column("dim").to_pylist())) == 1 else None
            out_id, out_n = [], []
            for lo, hi in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                y = x[lo:hi] if x is not None else _unit(_matrix(rows.column("data").slice(lo, hi - lo), rows.column("width")[0].as_py()))
                i, s, o, c = ids[lo:hi], size[lo:hi], own[lo:hi], comp[lo:hi]
                for part in np.unique(c) if c.min() != c.max() else c[:1]:
                    at = np.flatnonzero(c == part)
                    near = (y[at] @ y[at].T >= threshold) & (i[at][:, None] != i[at][None, :])
                    if lo_block[lo] != hi_block[lo]:
                        near &= o[at][:, None] != o[at][None, :]
                    out_id.append(i[at])
                    out_n.append(near @ s[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["id", "n"])

    return by_key(rows, "key", run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def neighbour_components(nodes: DataFrame, threshold: float = THRESHOLD, k: int = K, tables: int = TABLES, rounds: int = ROUNDS) -> DataFrame:
    """``(node, component)`` of the threshold graph."""
    lists = cut(best(start(nodes, range(tables), k, threshold), k, threshold).withColumn("new", F.lit(1)))
    for more in range(MORE + 1):
        if more:
            found = start(nodes, range(tables * more, tables * (more + 1)), k, threshold)
            lists = cut(best(lists.select("u", "v", "sim").unionByName(found), k, threshold).withColumn("new", F.lit(1)))
        for nth_round in range(rounds):
            found = descend(nodes, lists, k, threshold, more * rounds + nth_round).withColumn("new", F.lit(1))
            merged = lists.withColumn("new", F.lit(0)).unionByName(found)
            merged = merged.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
            merged = cut(trimmed(merged, k, threshold))
            total, changed = merged.agg(F.count("*"), F.sum("new")).first()
            lists = merged.select("u", "v", "sim", "new")
            if (changed or 0) <= SETTLED * (total or 1):
                break
        comps = cut(connected_components(lists.where(F.col("sim") >= threshold), "u", "v"))
        compared, recall = audit(nodes, comps, threshold)
        if compared and recall >= RECALL:
            return comps
        if not compared and more:
            break
    if compared and recall < LEAST_RECALL:
        raise RuntimeError(f"recall {recall:.3f} of {compared} audited links after {MORE} further tries")
    warnings.warn(f"recall {recall:.4f} of {compared} audited links" if compared else "recall is unmeasured: no audited vector has a link", stacklevel=2)
    return comps


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row."""
    ids, nodes = classes(vectors)
    comps = neighbour_components(nodes, threshold, **options)
    links = count_links(nodes, comps, threshold)
    per_class = nodes.select("id", "size").join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    per_class = per_class.select("id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    same = nodes.select("data", "id")
    members = ids.join(same, "data").select("vec_id", "id").join(per_class, "id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(members, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
