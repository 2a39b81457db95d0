"""Mixing sources to target weights by temperature.

A source's share ``p`` of all tokens becomes a weight proportional to
``p ** alpha``. The exponent is bisected in [0, 1]: the largest one whose weights
reach ``entropy_share`` of the greatest possible entropy, or, with
``max_repeats``, the smallest one that passes over no source more than that many
times. Weights times the token budget are the sources' quotas.

A quota is realised as block permutations. A document's block is a hash of its
id within its source; each pass over a source permutes the blocks, and the
documents within a block, by hashes keyed with the pass. Full passes take every
block; the last pass takes blocks in its order while they fit the rest of the
quota, and of the first that doesn't fit the documents in order while they do.
``slot`` is the share of the quota before the block, so sorting all sources by it
interleaves them at their weights.

All of it is DataFrame operations. Tokens are counted once; blocks are summed
before any window, so a window holds the blocks of one source and pass (at most
``blocks``) or the documents of one block, never those of a source.

Nulls and edges: tokens are runs of non-blank characters; null or empty texts
have none and are not drawn; a null source is a source of its own, named ''; a
row with a null id is placed by its text's hash; repeated rows count and are drawn
as often as they come, each at most once a pass; an empty table gives an empty
plan; ``plan`` reads no columns but ``doc_id``, ``text`` and ``source``, and
``mixed`` hands on all, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.llm.common import cut, small_enough

BLOCKS = 1024
ENTROPY_SHARE = 0.95
ROUNDS = 40
#: Halvings in one job.
STEP = 5
#: Passes over a source that one row lists.
PASSES = 4096
WORD = r"[^\x20\x09-\x0D]+"
WEIGHT_DIGITS = 9


def _name() -> Column:
    """What places a document: its id, or its text where that is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))


def _block(source: Column, name: Column, blocks: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", source, name).cast("binary")), 1, 8), 16, 10).cast("long") % blocks


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _tokens() -> Column:
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def token_counts(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``(doc_id, source, tokens, block, name)`` of the documents that have tokens; ``name`` only where the id is null."""
    counted = docs.select("doc_id", _source().alias("source"), _tokens().alias("tokens"), _name().alias("name")).where("tokens > 0")
    return counted.select("doc_id", "source", "tokens", _block(F.col("source"), F.col("name"), blocks).alias("block"), F.when(F.col("doc_id").isNull(), F.col("name")).alias("name"))


def _order(*parts) -> Column:
    """Hash that orders blocks or documents within a pass."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def temperature(sources: DataFrame, budget: int, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = None) -> float:
    """The exponent for ``sources (source, tokens)``; an error if no exponent meets ``max_repeats``.

    Each job tries ``2 ** STEP - 1`` exponents at once, which is as many halvings
    as ``STEP``; only their sums reach the driver.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1 and max_repeats is None:
        return 1.0
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    wanted = None if entropy_share is None else entropy_share * float(shares.agg(F.log(F.lit(float(n)))).first()[0])

    def too_flat(alphas: list[float]) -> list[bool]:
        tried = shares.select("p", F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("i", "a")).select("i", "a", "p", F.pow("p", "a").alias("q"))
        sums = tried.groupBy("i").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("e"), F.max(F.pow("p", F.col("a") - 1)).alias("r")).collect()
        found = {r.i: math.log(r.z) - r.e / r.z >= wanted if max_repeats is None else r.r / r.z * budget / total > max_repeats for r in sums}
        return [found[i] for i in range(len(alphas))]

    if too_flat([1.0])[0]:
        if max_repeats is not None:
            raise ValueError(f"a budget of {budget} tokens needs over {max_repeats} passes of some source; there are {total}")
        return 1.0
    lo, hi = 0.0, 1.0
    for done in range(0, ROUNDS, STEP):
        parts = 2 ** min(STEP, ROUNDS - done)
        alphas = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        flat = sum(too_flat(alphas))  # the lower ones
        lo, hi = lo + (hi - lo) * flat / parts, lo + (hi - lo) * (flat + 1) / parts
    return lo if max_repeats is None else hi


def weights(sources: DataFrame, alpha: float, budget: int) -> DataFrame:
    """``(source, tokens, weight, quota)``."""
    norm = sources.agg(F.sum("tokens").alias("t")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(norm)), F.lit(alpha))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = F.round(power / F.lit(float(z)), WEIGHT_DIGITS)
    return sources.select("source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget))).cast("long").alias("quota"))


def _dealt(counted: DataFrame, budget: int | None, entropy_share: float | None, max_repeats: float | None, seed: str) -> DataFrame:
    """``(source, block, pass_no, block_rank, whole, block_room, slot)``: the blocks that each pass takes."""
    per_block = cut(counted.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")))
    sources = cut(per_block.groupBy("source").agg(F.sum("block_tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    quotas = weights(sources, temperature(sources, budget, entropy_share, max_repeats), budget)

    # passes in two steps, so that no row holds them all
    last = F.expr("quota div tokens")
    passes = quotas.where("quota > 0").withColumn("last", last).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(PASSES).cast("long"))))
    passes = passes.withColumn("pass_no", F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + PASSES - 1))))
    left = (F.col("quota") - F.col("pass_no") * F.col("tokens")).alias("room")
    passes = passes.select("source", "pass_no", "quota", F.col("tokens").alias("source_tokens"), left)
    dealt = passes.join(per_block, "source").withColumn("block_key", _order(seed, "source", F.col("pass_no").cast("string"), F.col("block").cast("string")))
    in_order = Window.partitionBy("source", "pass_no").orderBy("block_key", "block")
    dealt = dealt.withColumn("block_rank", F.row_number().over(in_order).cast("long")).withColumn("upto", F.sum("block_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("block_tokens")
    dealt = dealt.where(before < F.col("room")).withColumn("whole", F.col("upto") <= F.col("room"))
    slot = F.round((F.col("pass_no") * F.col("source_tokens") + before) / F.col("quota"), 6)
    return dealt.select("source", "block", "pass_no", "block_rank", "whole", (F.col("room") - before).alias("block_room"), slot.alias("slot"))


def _doc_key(seed: str, name: Column) -> Column:
    return _order(seed, "doc", F.col("pass_no").cast("string"), name)


def _drawn(counted: DataFrame, dealt: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """The draws of whole blocks, and those of the blocks that are taken in part, with ``drawn``."""
    rows = counted.join(dealt, ["source", "block"]).withColumn("order_key", _doc_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("name"))))
    fits = Window.partitionBy("source", "pass_no", "block").orderBy("order_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.where("not whole").withColumn("drawn", F.sum("tokens").over(fits) <= F.col("block_room"))
    return rows.where("whole"), part


_DRAW = ("pass_no", "block_rank", "slot", "order_key")


def plan(docs: DataFrame, budget: int | None = None, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = None, blocks: int = BLOCKS, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, tokens, pass_no, block_rank, slot, order_key)``: every draw of a document.

    ``budget`` is in tokens, by default as many as there are. Sort by ``slot``,
    ``source``, ``pass_no``, ``block_rank``, ``order_key`` for the training order.
    """
    counted = cut(token_counts(docs.select("doc_id", "text", "source"), blocks))
    whole, part = _drawn(counted, _dealt(counted, budget, entropy_share, max_repeats, seed), seed)
    columns = ["doc_id", "source", "tokens", *_DRAW]
    return whole.select(*columns).unionByName(part.where("drawn").select(*columns))


def mixed(docs: DataFrame, budget: int | None = None, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = None, blocks: int = BLOCKS, seed: str = "mix") -> DataFrame:
    """The plan's draws with the documents' columns: as many rows as the plan has, and the same ids.

    The draw's own columns follow (``pass_no``, ``block_rank``, ``slot``,
    ``order_key``), with underscores before a name that ``docs`` has itself. Texts
    meet the blocks that were dealt, which are few and broadcast; a block taken in
    part gives the documents up to its last order key, and of rows that share that
    key as many as the plan drew.
    """
    counted = cut(token_counts(docs.select("doc_id", "text", "source"), blocks))
    dealt = cut(_dealt(counted, budget, entropy_share, max_repeats, seed))
    _, part = _drawn(counted, dealt, seed)
    at = part.groupBy("source", "block", "pass_no", "order_key").agg(F.count_if("drawn").alias("n"), F.count("*").alias("all")).where("n > 0")
    last = cut(at.groupBy("source", "block", "pass_no").agg(F.max(F.struct("order_key", "n", "all")).alias("last")).select("source", "block", "pass_no", F.col("last.order_key").alias("last_key"), F.col("last.n").alias("n"), F.col("last.all").alias("all")))
    taken = cut(dealt.join(F.broadcast(last) if small_enough(last) else last, ["source", "block", "pass_no"], "left").where("whole or last_key is not null"))

    own = F.struct(*docs.columns).alias("row")
    rows = docs.where(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]")).select(own, F.col("doc_id"), F.col("text"), F.col("source"))
    rows = rows.select("row", _source().alias("source"), _name().alias("name")).withColumn("block", _block(F.col("source"), F.col("name"), blocks))
    rows = rows.join(F.broadcast(taken) if small_enough(taken) else taken, ["source", "block"]).withColumn("order_key", _doc_key(seed, F.col("name")))
    names = list(docs.columns)
    for c in _DRAW:
        names.append(c if c not in names else next(x for k in range(1, 99) if (x := "_" * k + c) not in names))

    def out(found: DataFrame) -> DataFrame:
        return found.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(_DRAW, names[len(docs.columns) :], strict=True)])

    sure = F.col("whole") | (F.col("order_key") < F.col("last_key")) | (F.col("order_key") == F.col("last_key")) & (F.col("n") == F.col("all"))
    kept = out(rows.where(sure))
    if taken.where("n < all").isEmpty():
        return kept
    among = Window.partitionBy("source", "block", "pass_no").orderBy(F.regexp_count(F.col("row")["text"].cast("string"), F.lit(WORD)), F.md5(F.col("row")["text"].cast("binary")))
    tied = rows.where((F.col("order_key") == F.col("last_key")) & (F.col("n") < F.col("all"))).withColumn("nth", F.row_number().over(among)).where("nth <= n")
    return kept.unionByName(out(tied))


def oracle(documents: str = "documents", blocks: int = BLOCKS, entropy_share: float = ENTROPY_SHARE, seed: str = "mix") -> str:
    """The same plan as DuckDB SQL, with the default budget."""
    word = WORD.replace("\\x20", " ").replace("\\x09-\\x0D", "\\t\\n\\x0B\\f\\r")
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, name, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS tokens,
    ('0x' || substr(md5(coalesce(source, '') || '|' || name), 1, 8))::BIGINT % {blocks} AS block
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM {documents})),
counted1 AS MATERIALIZED (SELECT * FROM counted WHERE tokens > 0),
per_block AS MATERIALIZED (SELECT source, block, sum(tokens)::BIGINT AS block_tokens FROM counted1 GROUP BY ALL),
sources AS MATERIALIZED (SELECT source, sum(block_tokens)::BIGINT AS tokens FROM per_block GROUP BY source),
t AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n, list(tokens / (SELECT sum(tokens) FROM sources)::DOUBLE ORDER BY source) AS p FROM sources),
flat1 AS (SELECT n, total, p, -list_sum([x * ln(x) for x in p]) >= {entropy_share} * ln(n::DOUBLE) AS done FROM t),
bisect(i, lo, hi) AS (
  SELECT 0, CASE WHEN n = 1 OR done THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE FROM flat1
  UNION ALL
  SELECT i + 1, CASE WHEN e >= want THEN mid ELSE lo END, CASE WHEN e >= want THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, want, -list_sum([(x / z) * ln(x / z) for x in q]) AS e
    FROM (SELECT i, lo, hi, mid, want, q, list_sum(q) AS z
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, {entropy_share} * ln(n::DOUBLE) AS want, [pow(x, (lo + hi) / 2) for x in p] AS q FROM bisect, flat1 WHERE i < {ROUNDS})))),
alpha AS (SELECT lo AS a FROM bisect WHERE i = {ROUNDS}),
w AS (SELECT source, tokens, pow(tokens / (SELECT total FROM t)::DOUBLE, (SELECT a FROM alpha)) AS q FROM sources),
quotas AS (SELECT source, tokens, floor(round(q / (SELECT sum(q) FROM w), {WEIGHT_DIGITS}) * (SELECT total FROM t)::DOUBLE)::BIGINT AS quota FROM w),
passes AS (SELECT source, tokens AS source_tokens, quota, unnest(range(0, quota // tokens + 1)) AS pass_no FROM quotas WHERE quota > 0),
ranked AS (SELECT p.*, quota - pass_no * source_tokens AS room, b.block, b.block_tokens,
    row_number() OVER o AS block_rank, sum(b.block_tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM passes p JOIN per_block b USING (source)
  WINDOW o AS (PARTITION BY p.source, p.pass_no ORDER BY md5('{seed}|source|' || p.pass_no || '|' || b.block), b.block)),
dealt AS (SELECT *, upto - block_tokens AS before, upto <= room AS whole FROM ranked WHERE upto - block_tokens < room),
drawn AS (SELECT c.doc_id, c.source, c.tokens, d.pass_no, d.block_rank, d.block, d.whole, d.room - d.before AS block_room,
    round((d.pass_no * d.source_tokens + d.before)::DOUBLE / d.quota, 6) AS slot,
    md5('{seed}|doc|' || d.pass_no || '|' || c.name) AS order_key
  FROM counted1 c JOIN dealt d USING (source, block)),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY source, pass_no, block ORDER BY order_key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS doc_upto FROM drawn)
SELECT doc_id, source, tokens, pass_no, block_rank, slot, order_key FROM upto WHERE whole OR doc_upto <= block_room
"""
