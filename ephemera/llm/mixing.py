"""Operator 3, mixing sources to target weights: temperature mixing, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WHITE, Scratch, fresh, table, text_of

#: The most blocks of a source, a power of two. Smaller sources have SPARE blocks a document and more, so that nearly all of these hold one document at
#: most: a budget is met to within half a block, which is half a document there and a part in 8,192 of a source with many.
BLOCKS, SPARE = 4096, 4
#: A plan of at most so many sources (some megabytes) is broadcast, so that texts are not shuffled; a longer one is joined by shuffling.
BROADCAST_SOURCES = 100_000
#: Halvings of the exponent's interval.
STEPS = 60


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected to meet: `entropy` of the weights in nats, at least; or `repeats`, the most times that any source is
    read while the least repeated one is read once, so that no document is left out."""

    entropy: float | None = None
    repeats: float | None = None


def bisect_exponent(sums: DataFrame, target: Target) -> float:
    """The exponent in [0, 1] for source token shares q of sums(t): weights are q**exponent, normalised.

    1 keeps the shares, 0 makes all sources equal. Entropy falls with the exponent, and so do the repeats. For `entropy` the largest exponent that
    reaches it is taken (0 if none does); for `repeats` the smallest that keeps within it. Every step is an aggregate over sums, of which
    no row reaches the driver.
    """
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("give either an entropy or a repetition limit")
    few, many, total, n = sums.agg(F.min("t"), F.max("t"), F.sum("t"), F.count(F.lit(1))).first()
    if n < 2:
        return 1.0
    share = F.col("t") / float(total)

    def ok(exponent: float) -> bool:
        if target.repeats is not None:  # the least source is repeated most, the greatest least
            return (many / few) ** (1 - exponent) <= target.repeats
        raised = F.pow(share, F.lit(exponent))
        z, told = sums.agg(F.sum(raised), F.sum(raised * F.log(share))).first()
        return math.log(z) - exponent * told / z < target.entropy  # still too uneven: go lower

    low, high = _bisect(ok)
    return low if target.entropy is not None else high


def _bisect(ok: Callable[[float], bool]) -> tuple[float, float]:
    low, high = 0.0, 1.0
    if ok(low):
        return low, low
    if not ok(high):
        return high, high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return low, high


def _digits(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 from the md5 of what is given, which any SQL engine can tell."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _turn(block: Column, epoch: Column, blocks: Column, seed: int) -> Column:
    """A block's place in an epoch: multiplied by an odd number and shifted, modulo a power of two, which is a permutation of the blocks."""
    odd = _digits(f"odd {seed}", epoch).bitwiseOR(F.lit(1).cast("long"))
    return ((block * odd + _digits(f"shift {seed}", epoch)) % blocks).cast("long")


def tokens_of(text_col: str) -> Column:
    """Words between white space, and one at least."""
    words = text_of(text_col)
    for c in WHITE[1:]:
        words = F.replace(words, F.lit(c), F.lit(" "))
    return F.greatest(F.size(F.array_remove(F.split(words, " "), "")), F.lit(1)).cast("long")


def plan_sources(cells: DataFrame, target: Target, seed: int = 0) -> DataFrame:
    """(s, epochs, blocks, whole, cutoff) for cells(s, cell, t, n), a saved table: how often each source is read, into how many blocks it falls, its
    whole epochs, and how many blocks of the next epoch's order its budget has room for.

    In the last, partial epoch the blocks come in that epoch's order while their middle lies within the budget. A source has at most
    BLOCKS blocks, which bounds the window over them.
    """
    scratch = Scratch(cells.sparkSession)
    sums = scratch.save(cells.groupBy("s").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    exponent, many = bisect_exponent(sums, target), sums.agg(F.max("t")).first()[0] or 1
    epochs = F.pow(float(many) / F.col("t"), F.lit(1 - exponent))
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.least(F.lit(BLOCKS), SPARE * F.col("n"))) - 1e-9)).cast("long")
    whole = F.floor(F.col("epochs") + 1e-9).cast("long")
    told = sums.select("s", epochs.alias("epochs"), blocks.alias("blocks"), F.col("t").alias("all")).withColumn("whole", whole)
    met = cells.join(told, "s").withColumn("block", F.col("cell") % F.col("blocks"))
    sized = met.groupBy("s", "epochs", "blocks", "whole", "all", "block").agg(F.sum("t").alias("t"))
    turned = sized.withColumn("place", _turn(F.col("block"), F.col("whole"), F.col("blocks"), seed))
    before = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spent = turned.withColumn("over", F.sum("t").over(before) - F.col("t") / 2 >= (F.col("epochs") - F.col("whole")) * F.col("all"))
    cut = F.coalesce(F.min(F.when(F.col("over"), F.col("place"))), F.col("blocks"))
    return scratch.save(spent.groupBy("s", "epochs", "blocks", "whole").agg(cut.alias("cutoff")))


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """docs as often as the mix reads them: all columns, with mix_epoch (int), mix_block (int), mix_at (double) and mix_tokens (long), which replace
    columns of these names.

    A token is a word between white space, and every document counts for one at least. The budget is the least with which every source is read
    once, so nothing is dropped; a source with more is read again, in whole epochs and then as many blocks of the next one as its budget has room
    for, half a block more or less (see BLOCKS). Documents fall into blocks by a hash of their id; every epoch of a source has its own permutation of blocks, and of documents in them.
    mix_at, from 0 to 1, is a row's place in the mix: in any stretch of it sources have their weights. Sort by it and the id for the sequence itself.

    Null sources are the source "". Null and empty texts are one token, texts of any length are counted whole. Repeated rows are mixed each, at the
    same place. Null ids are one id. Other columns may have any names and keep their values; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    added = ("mix_epoch", "mix_block", "mix_at", "mix_tokens")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    place = _digits(f"place {seed}", name) % BLOCKS
    cells = scratch.save(docs.select(source.alias("s"), place.alias("cell"), tokens_of(text_col).alias("t")).groupBy("s", "cell").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")))
    plan = plan_sources(cells, target, seed)
    s, cell, epoch, tokens, block, epochs, blocks, whole, cutoff = fresh(docs, "s", "cell", "epoch", "tokens", "block", "epochs", "blocks", "whole", "cutoff")
    plan = plan.select(F.col("s").alias(s), F.col("epochs").alias(epochs), F.col("blocks").alias(blocks), F.col("whole").alias(whole), F.col("cutoff").alias(cutoff))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = docs.withColumns({s: source, cell: place, tokens: tokens_of(text_col)}).join(plan, s).withColumn(block, F.col(cell) % F.col(blocks))
    once_more = _turn(F.col(block), F.col(whole), F.col(blocks), seed) < F.col(cutoff)
    read = rows.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(whole) - F.when(once_more, 0).otherwise(1))))
    within = _digits(f"within {seed}", F.col(epoch), name) / float(1 << 32)
    # The blocks that are read of a partial epoch share its part of the mix.
    part, of = F.when(F.col(epoch) == F.col(whole), F.col(epochs) - F.col(whole)).otherwise(1.0), F.when(F.col(epoch) == F.col(whole), F.col(cutoff)).otherwise(F.col(blocks))
    at = (F.col(epoch) + part * (_turn(F.col(block), F.col(epoch), F.col(blocks), seed) + within) / of) / F.col(epochs)
    told = [F.col(epoch).cast("int").alias(added[0]), F.col(block).cast("int").alias(added[1]), F.least(F.lit(1.0), at).alias(added[2]), F.col(tokens).alias(added[3])]
    return read.select(*(c for c in docs.columns if c not in added), *told)


#: Repetition limit of the registered query and of the pipeline.
REPEATS = 1.5


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_at is rounded to nine decimals, as engines differ in the last bit of a power."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, Target(repeats=REPEATS))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", F.round("mix_at", 9).alias("mix_at"), "mix_tokens")


def _digits_sql(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _turn_sql(epoch: str) -> str:
    return f"((block * ({_digits_sql("'odd 0'", epoch)} | 1) + {_digits_sql("'shift 0'", epoch)}) % blocks)"


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, {_digits_sql("'place 0'", "doc_id")} % {BLOCKS} AS cell,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS t
  FROM documents),
sums AS (SELECT s, sum(t)::BIGINT AS total, count(*) AS n FROM d GROUP BY s),
ends AS (SELECT max(total) AS many, max(total)::DOUBLE / min(total) AS ratio FROM sums),
halved AS (
  SELECT 0 AS step, 0::DOUBLE AS low, 1::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {REPEATS} THEN low ELSE (low + high) / 2 END,
    CASE WHEN pow(ratio, 1 - (low + high) / 2) <= {REPEATS} THEN (low + high) / 2 ELSE high END
  FROM halved, ends WHERE step < {STEPS}),
told AS (
  SELECT s, total, pow(many::DOUBLE / total, 1 - CASE WHEN ratio <= {REPEATS} THEN 0 ELSE high END) AS epochs,
    pow(2, ceil(log2(least({BLOCKS}, {SPARE} * n)) - 1e-9))::BIGINT AS blocks
  FROM sums, ends, (SELECT high FROM halved WHERE step = {STEPS})),
met AS (SELECT d.*, total, epochs, blocks, floor(epochs + 1e-9)::BIGINT AS whole, cell % blocks AS block FROM d JOIN told USING (s)),
sized AS (SELECT s, epochs, blocks, whole, total, {_turn_sql("whole")} AS place, sum(t) AS t FROM met GROUP BY s, epochs, blocks, whole, total, block),
spent AS (SELECT *, sum(t) OVER (PARTITION BY s ORDER BY place) - t / 2 >= (epochs - whole) * total AS over FROM sized),
plan AS (SELECT s, coalesce(min(place) FILTER (WHERE over), max(blocks)) AS cutoff FROM spent GROUP BY s),
read AS (
  SELECT met.*, cutoff, unnest(range(0, whole + CASE WHEN {_turn_sql("whole")} < cutoff THEN 1 ELSE 0 END)) AS epoch
  FROM met JOIN plan USING (s))
SELECT doc_id, source, epoch::INTEGER AS mix_epoch, block::INTEGER AS mix_block,
  round(least(1.0, (epoch + CASE WHEN epoch = whole THEN epochs - whole ELSE 1.0::DOUBLE END * ({_turn_sql("epoch")} + {_digits_sql("'within 0'", "epoch", "doc_id")} / 4294967296.0::DOUBLE)
    / CASE WHEN epoch = whole THEN cutoff ELSE blocks END) / epochs), 9) AS mix_at,
  t::BIGINT AS mix_tokens
FROM read
"""
