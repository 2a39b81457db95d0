"""Quality classifier: interpolated modified Kneser-Ney n-gram perplexity.

Character 4-gram models are trained on all trusted text (documents labelled of
good quality and not toxic). Texts fall into two folds by their hash, and each
document, trusted or not, is scored by the model of the other fold, so that copies
share a fold and thresholds come from text that the model hasn't seen. Counts are
combined per task, then summed by key in Spark; lower orders count distinct left
contexts. Discounts come from the counts of counts; each order's probabilities are
joins, on hash-sharded keys, of its counts with its context totals and with the
order below.

Scores are joins of counts, too. Neighbouring documents of a fold form a block,
which asks once for each gram it has, so common grams are no hot keys; the grams
asked for are joined with the model's tables, longest match first; each block gets
its answers and sums them up over its documents. No table is collected or
broadcast, and texts are shuffled once, compressed by the block.

A document's perplexity over its whole text is compared with quantiles of the
trusted documents in its language, on both sides, as noise can be too surprising
and repetition too little; the band narrows with the text's length. Its worst
window of ``WINDOW`` symbols is compared with a quantile, too, as a few foreign
words (insults, say) don't show in a long text's mean. A language with under
``FEW`` trusted documents takes the wider of its own and the pooled bounds, widened
further (``thresholds``); one without any takes the pooled ones.

Nulls and edges: runs of white space read as one blank and digits as 0; code
points beyond 16 bits fold into the private use area; null or empty text has null
perplexity and is rejected; a null language is a group of its own; without trusted
text in the other fold a document is not scored and kept; repeated rows come back
as often as they came in; repeated labels count as trusted if any of them is;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tomeflow.llm.common import binary_parts, cut, keep_rows, row_key, row_slices, small_enough
from tomeflow.llm.langid import code_points

ORDER = 4
LOW, HIGH = 0.001, 0.999
WINDOW, WORST = 8, 0.997
FOLDS = 2
#: Trusted documents below which a language's own quantiles don't stand alone.
FEW = 200
#: A range of ``n < FEW`` documents is widened by this many ``n``-ths of itself at either end.
WIDEN = 10
#: Added beyond the quantiles, so that clean text at the edge stays.
MARGIN = 0.3
#: Symbols beyond which a longer text is not held to a narrower band.
LENGTH_CAP = 1000
BLOCK_BYTES = 16 << 20
MERGE_AT = 2_000_000
PAD = 2


def _symbols(points: np.ndarray) -> np.ndarray:
    """16-bit symbols: white space as one blank, digits as 0."""
    s = np.where(points > 0xFFFF, 0xD800 + points % 0x2100, points).astype(np.uint16)
    white = (points <= 32) | (points == 0xA0)
    s[white] = 32
    s[(points >= 48) & (points <= 57)] = 48
    return s


def grams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, bounds)``: packed 4-grams of each text, one for each of its symbols; contexts start with padding."""
    part = raw[offsets[0] : offsets[-1]]
    points = code_points(part)
    bounds = np.r_[0, np.cumsum((part & 0xC0) != 0x80)][offsets - offsets[0]]
    s = _symbols(points)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    keep[starts] = True
    bounds = np.r_[0, np.cumsum(keep)][bounds]
    s = s[keep].astype(np.uint64)
    size = np.diff(bounds)
    starts, size = bounds[:-1][size > 0], size[size > 0]
    out = s.copy()
    for back in range(1, ORDER):
        prev = np.full(len(s), PAD, np.uint64)
        prev[back:] = s[:-back]
        for k in range(back):  # what stands before the first symbols of a text is padding
            prev[(starts + k)[size > k]] = PAD
        out |= prev << np.uint64(16 * back)
    return out, bounds


def trusted_keys(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return cut(good)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, minlength=len(found)).astype(np.int64)


def fold_of(text: str = "text") -> Column:
    return F.pmod(F.crc32(F.col(text).cast("binary")), F.lit(FOLDS)).cast("int")


def distinct_grams(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, counts)`` of all texts together, grams ascending."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in row_slices(np.diff(offsets), 1 << 20):
        g, _ = grams(offsets[lo : hi + 1], raw)
        held.append(tuple(x.astype(t) for x, t in zip(np.unique(g, return_counts=True), (np.uint64, np.int64), strict=True)))
        if sum(len(k) for k, _ in held) > MERGE_AT:
            held = [_merge(held)]
    return _merge(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_grams(docs: DataFrame) -> DataFrame:
    """``(fold, gram, n)`` over all texts of ``docs (fold, text)``; each task sums its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(fold: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), fold, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["fold", "gram", "n"])

        for b in batches:
            folds = np.asarray(b.column(0))
            for fold in np.unique(folds).tolist():
                mine = held.setdefault(fold, [])
                mine.append(distinct_grams(*binary_parts(b.column(1).filter(pa.array(folds == fold)))))
                if sum(len(k) for k, _ in mine) > MERGE_AT:
                    mine[:] = [_merge(mine)]
                    if len(mine[0][0]) > MERGE_AT // 2:
                        yield out(fold, *mine.pop())
        for fold, mine in held.items():
            if mine:
                yield out(fold, *_merge(mine))

    return docs.select("fold", "text").mapInArrow(run, "fold int, gram long, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _of_fold(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for fold, value in values.items():
        out = F.when(F.col("fold") == fold, F.lit(float(value))).otherwise(out)
    return out


def model(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], dict[int, float]]:
    """``(tables, unseen)`` of ``counts (fold, gram, n)``.

    ``tables[k - 1]`` has the probabilities ``(fold, gram, p)`` of order ``k`` and
    the weights ``(fold, ctx, weight)`` that its contexts leave to the order below;
    ``unseen`` is a fold's probability of a symbol that it doesn't know.
    """
    by_order = {ORDER: cut(counts)}
    for k in range(ORDER, 1, -1):
        by_order[k - 1] = cut(by_order[k].groupBy("fold", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")))
    unseen = {r.fold: 1.0 / (r["count"] + 1) for r in by_order[1].groupBy("fold").count().collect()}
    below: DataFrame | None = None
    tables = []
    for k in range(1, ORDER + 1):
        c = by_order[k]
        d: list[dict[int, float]] = [{}, {}, {}]
        for r in c.groupBy("fold").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
            n1, n2, n3, n4 = (float(r[f"n{i}"]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
            for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
                d[i - 1][r.fold] = min(float(i), max(0.0, i - (i + 1) * y * b / a)) if a else 0.0
        n = F.col("n")
        discount = F.when(n == 1, _of_fold(d[0])).when(n == 2, _of_fold(d[1])).otherwise(_of_fold(d[2]))
        left = c.withColumn("ctx", _context(F.col("gram")) if k > 1 else F.lit(0).cast("long"))
        contexts = left.groupBy("fold", "ctx").agg(F.sum("n").alias("total"), F.sum(F.least(discount, n.cast("double"))).alias("mass")).select("fold", "ctx", "total", (F.greatest("mass", F.lit(1e-9)) / F.col("total")).alias("weight"))
        contexts = cut(contexts)
        joined = left.join(contexts, ["fold", "ctx"])
        if below is None:
            lower = _of_fold(unseen)
        else:
            joined = joined.withColumn("suffix", _suffix(F.col("gram"), k)).join(below, ["fold", "suffix"])
            lower = F.col("lower")
        p = F.greatest(n - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * lower
        probs = cut(joined.select("fold", "gram", p.alias("p")))
        tables.append((probs, contexts.select("fold", "ctx", "weight")))
        below = probs.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return tables, unseen


def log_probs(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]], unseen: dict[int, float]) -> DataFrame:
    """``(fold, gram, log_p)`` of ``wanted (fold, gram)``: the longest known suffix, after the weights of the contexts left behind."""
    rows = wanted
    for k in range(ORDER, 0, -1):
        probs, contexts = tables[k - 1]
        key = F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        rows = rows.withColumn(f"g{k}", key).join(probs.select("fold", F.col("gram").alias(f"g{k}"), F.log("p").alias(f"p{k}")), ["fold", f"g{k}"], "left")
        if k > 1:
            rows = rows.withColumn(f"c{k}", _context(F.col(f"g{k}"))).join(contexts.select("fold", F.col("ctx").alias(f"c{k}"), F.log("weight").alias(f"w{k}")), ["fold", f"c{k}"], "left")
        else:  # one context
            rows = rows.withColumn("w1", _of_fold({r.fold: float(np.log(r.weight)) for r in contexts.collect()}))
    log_p = F.log(_of_fold(unseen))
    for k in range(1, ORDER + 1):
        log_p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(0.0)) + log_p)
    return rows.select("fold", "gram", log_p.alias("log_p"))


_PACKED = "block long, fold int, doc_id array<{id}>, lang array<string>, row_key array<string>, size array<long>, texts binary"


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents as blocks of a fold: a row holds neighbouring documents, their texts compressed together, under a hash of their keys."""
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            folds = np.asarray(b.column("fold"))
            for fold in np.unique(folds).tolist():
                mine = b.filter(pa.array(folds == fold))
                offsets, raw = binary_parts(mine.column("text"))
                for lo, hi in row_slices(np.diff(offsets), block_bytes):
                    keys = mine.column("row_key").slice(lo, hi - lo)
                    block = np.uint64(xxhash.xxh3_64_intdigest("".join(keys.to_pylist()))).astype(np.int64)
                    lists = [mine.column("doc_id").slice(lo, hi - lo), mine.column("lang").slice(lo, hi - lo), keys, pa.array(np.diff(offsets[lo : hi + 1]))]
                    one = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([fold], pa.int32()), *one, pa.array([zip_.compress(raw[offsets[lo] : offsets[hi]].tobytes())], pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("fold", "doc_id", "lang", "row_key", "text").mapInArrow(run, _PACKED.format(id=kind))


def _unpacked(rows: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of the texts of block ``i``."""
    sizes = np.asarray(rows.column("size")[i].values)
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(rows.column("texts")[i].as_py(), max_output_size=int(offsets[-1])) if offsets[-1] else b""
    return offsets, np.frombuffer(raw, np.uint8)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each block, and the fold that answers."""
    for b in batches:
        for i in range(b.num_rows):
            key, _ = distinct_grams(*_unpacked(b, i))
            n = len(key)
            fold = (b.column("fold")[i].as_py() + 1) % FOLDS
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column("block")[i].as_py())), pa.array(np.full(n, fold, np.int32)), pa.array(key.view(np.int64))], names=["block", "fold", "gram"])


def _window_sums(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least mean of ``WINDOW`` neighbouring log probabilities in each text (of all, in shorter ones); ``logs`` are sums so far."""
    size = np.diff(bounds)
    out = np.zeros(len(size))
    short = size < WINDOW
    out[short] = (logs[bounds[1:]] - logs[bounds[:-1]])[short] / np.maximum(size[short], 1)
    if not short.all():
        means = np.full(len(logs), np.inf)
        means[: len(logs) - WINDOW] = (logs[WINDOW:] - logs[:-WINDOW]) / WINDOW
        for end in range(1, WINDOW):  # windows that reach into the next text
            at = bounds[1:] - end
            means[at[at >= 0]] = np.inf
        whole = np.flatnonzero(~short)
        # from the first window of a text to the first of the next with windows
        out[whole] = np.minimum.reduceat(means, bounds[whole])
    return out


def _scored(schema: pa.Schema):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        key, log_p = (np.asarray(answers.column(c).combine_chunks()) for c in ("gram", "log_p"))
        key = key.view(np.uint64)
        order = np.argsort(key)
        key, log_p = key[order], log_p[order]
        known = bool(len(key)) and not np.isnan(log_p).any()
        out = []
        for i in range(rows.num_rows):
            offsets, raw = _unpacked(rows, i)
            n = len(offsets) - 1
            sums, worst, sizes = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for lo, hi in row_slices(np.diff(offsets), 1 << 20):
                g, bounds = grams(offsets[lo : hi + 1], raw)
                sizes[lo:hi] = np.diff(bounds)
                if known:
                    logs = np.r_[0.0, np.cumsum(log_p[np.searchsorted(key, g)])]
                    sums[lo:hi], worst[lo:hi] = np.diff(logs[bounds]), _window_sums(logs, bounds)
            none = pa.nulls(n, pa.float64())
            lists = [rows.column(c)[i].values for c in ("doc_id", "lang", "row_key")]
            out.append(pa.table([*lists, pa.array(sizes), pa.array(sums) if known else none, pa.array(worst) if known else none], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]], unseen: dict[int, float], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, lang, row_key, n_chars, log_prob, worst)`` of ``docs (doc_id, lang, row_key, fold, text)``, by the model of the other fold; without one the last two are null."""
    dealt = packed(docs, block_bytes).repartition("block")
    asked = dealt.mapInArrow(_asked, "block long, fold int, gram long").repartition("fold", "gram")
    # both read one exchange: what is distinct keeps a block, so that the columns are the same
    wanted = asked.groupBy("fold", "gram").agg(F.min("block").alias("first")).where("first is not null").select("fold", "gram")
    answers = asked.join(log_probs(wanted, tables, unseen), ["fold", "gram"]).select("block", "gram", "log_p")
    schema = StructType([docs.schema["doc_id"], StructField("lang", StringType()), StructField("row_key", StringType()), StructField("n_chars", LongType()), StructField("log_prob", DoubleType()), StructField("worst", DoubleType())])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(to_arrow_schema(schema)), schema)


def thresholds(scored: DataFrame, trusted: DataFrame, low: float, high: float, worst: float = WORST) -> DataFrame:
    """``(lang, every, n, centre, low_z, high_z, worst)`` of trusted text by language, and one row over every language.

    ``centre`` is the median log perplexity; ``low_z`` and ``high_z`` are quantiles
    of the distance from it times the square root of the length (up to
    ``LENGTH_CAP``), as the mean over a long text strays less than over a short one;
    ``worst`` is a quantile of the worst windows. The range of ``n`` documents is
    widened by its ``WIDEN / n`` part where they are few, as the next document often
    lies beyond the extremes of a few.
    """
    rows = scored.where("log_ppl is not null").join(trusted, "doc_id", "left_semi").select("lang", "log_ppl", "worst", F.sqrt(F.least(F.col("n_chars"), F.lit(LENGTH_CAP))).alias("spread"))
    both = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("every")).withColumn("lang", F.when(~F.col("every"), F.col("lang")))
    both = both.withColumn("group", F.struct("every", "lang"))
    centre = both.groupBy("group").agg(F.percentile_approx("log_ppl", 0.5, 100_000).alias("centre"))
    centre = cut(centre)
    z = (F.col("log_ppl") - F.col("centre")) * F.col("spread")
    side = F.broadcast(centre) if small_enough(centre, 100_000) else centre
    tails = both.join(side, "group").groupBy("group", "centre").agg(
        F.count("*").alias("n"), F.percentile_approx(z, low, 100_000).alias("low_z"), F.percentile_approx(z, high, 100_000).alias("high_z"),
        F.percentile_approx(-F.col("worst"), worst, 100_000).alias("worst"), F.percentile_approx(-F.col("worst"), 0.5).alias("usual"),
    )
    more = F.when(F.col("n") < FEW, WIDEN / F.col("n")).otherwise(0.0)
    wide = more * (F.col("high_z") - F.col("low_z"))
    found = tails.select("group.*", "n", "centre", (F.col("low_z") - wide).alias("low_z"), (F.col("high_z") + wide).alias("high_z"), (F.col("worst") + more * (F.col("worst") - F.col("usual"))).alias("worst"))
    none = scored.sparkSession.createDataFrame([(True, None, None, None, None, None, None)], "every boolean, lang string, n long, centre double, low_z double, high_z double, worst double")
    return cut(found.unionByName(none).groupBy("lang", "every").agg(*[F.max(c).alias(c) for c in ("n", "centre", "low_z", "high_z", "worst")]))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN, worst: float = WORST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, lang, row_key, n_chars, perplexity, low, high, worst, worst_high, kept)``, one row per input row.

    ``worst`` is the perplexity of the worst window; ``low``, ``high`` and ``worst_high`` are the bounds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), row_key().alias("row_key")).withColumn("fold", fold_of())
    good = trusted_keys(docs, labels)
    side = F.broadcast(good) if small_enough(good) else good
    scored = score(rows, *model(count_grams(rows.join(side, "doc_id", "left_semi"))), block_bytes)
    log_ppl = F.when(F.col("n_chars") > 0, -F.col("log_prob") / F.col("n_chars"))
    scored = cut(scored.withColumn("log_ppl", log_ppl))
    bounds = thresholds(scored, side, low, high, worst)
    everywhere = bounds.where("every").first()
    of_lang = bounds.where("not every").select(F.col("lang").alias("__lang"), "n", "centre", "low_z", "high_z", F.col("worst").alias("worst_lang"))
    of_lang = F.broadcast(of_lang) if small_enough(of_lang, 100_000) else of_lang
    out = scored.join(of_lang, scored["lang"].eqNullSafe(F.col("__lang")), "left")
    pooled = {c: F.lit(everywhere[c]).cast("double") for c in ("centre", "low_z", "high_z", "worst")}
    alone = F.col("n") >= FEW
    middle = F.coalesce("centre", pooled["centre"])
    low_z = F.when(alone, F.col("low_z")).otherwise(F.least("low_z", pooled["low_z"]))
    high_z = F.when(alone, F.col("high_z")).otherwise(F.greatest("high_z", pooled["high_z"]))
    worst_at = F.when(alone, F.col("worst_lang")).otherwise(F.greatest("worst_lang", pooled["worst"]))
    spread = F.sqrt(F.greatest(F.least(F.col("n_chars"), F.lit(LENGTH_CAP)), F.lit(1)))
    low_at, high_at = middle + (low_z - margin) / spread, middle + (high_z + margin) / spread
    inside = F.coalesce(F.col("log_ppl").between(low_at, high_at) & (-F.col("worst") <= worst_at), F.col("n_chars") > 0)
    return out.select("doc_id", "lang", "row_key", "n_chars", F.exp("log_ppl").alias("perplexity"), F.exp(low_at).alias("low"), F.exp(high_at).alias("high"), F.when(F.col("n_chars") > 0, F.exp(-F.col("worst"))).alias("worst"), F.exp(worst_at).alias("worst_high"), inside.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected rows; their columns stay as they are."""
    return keep_rows(docs, classify(docs.select("doc_id", "text", "lang"), labels, **options).where("not kept"), "left_anti")
