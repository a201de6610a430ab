"""Operator 10, best-fit packing: minimum bin slack over the histogram of piece lengths, then placement of the pieces by rank."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_of

LENGTH = 2048
#: Pieces of one length are ranked in parts of about this many, so that a length that very many pieces share is not one task's work.
PART_ROWS = 20_000
#: Whole texts that a Python worker is sent at a time.
BATCH = 1000
PIECES = "id long, copy long, piece int, start long, length long, ids_crc32 long"


# --- tokens -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(name: str):
    """The byte-level BPE of a vocabulary file, as a tiktoken encoding with the same ids; several times faster than reading the .json file."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


#: Runs that the rank file's encoder cannot be trusted with: its regex engine recurses for every character of white space.
_LONG_RUN = re.compile(r"\s{5000}")


@lru_cache(maxsize=2)
def _plain_encoder(name: str):
    """The vocabulary's .json file itself: slower, but at ease with long runs."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, vocabulary: str = "byte_bpe_50k") -> np.ndarray:
    """Token ids as uint32. A special token's string within a text is that token, as the tokenizer library reads it."""
    if len(text) >= 5000 and _LONG_RUN.search(text):
        return np.asarray(_plain_encoder(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
    encoding, special = _encoder(vocabulary)
    if any(s in text for s in special):
        return np.asarray(encoding.encode(text, allowed_special="all"), np.uint32)
    return np.asarray(encoding.encode_ordinary(text), np.uint32)


def piece_bounds(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only more than `most` tokens are cut, and only the first piece may be shorter."""
    first = n % most or most
    return [(0, min(first, n)), *((at, most) for at in range(first, n, most))]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, most: int) -> Iterator[pa.RecordBatch]:
    end = np.zeros(1, np.uint32)
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[tuple] = []
        for i, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.append(token_ids(text.as_py(), vocabulary), end)
            for k, (at, n) in enumerate(piece_bounds(len(ids), most)):
                out.append((i, copy, k, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names)


# --- plan ---------------------------------------------------------------------------------------------------


def _fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (with repeats) whose sum is the largest that fits in room; bit s of a set says that a sum of s can be reached."""
    reach, seen = 1, []
    within = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:  # binary splitting: 1, 2, 4, ... copies of a length
            take = min(take, left)
            seen.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, []
    for length, take, before in reversed(seen):
        if not before >> at & 1:
            found += [length] * take
            at -= length * take
    return found


def plan_bins(histogram: dict[int, int], most: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by minimum bin slack.

    Each step takes the longest length left and fills the rest of its bin as full as any combination of the lengths left can, by a bitset
    subset sum; the combination is used as often as the counts allow and removed. The work depends on the number of distinct lengths, at most
    `most`, not on the number of pieces.
    """
    left, plan = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = _fullest({k: v for k, v in left.items() if v}, most - longest)
        left[longest] += 1
        bin_ = [longest, *rest]
        need = {k: bin_.count(k) for k in set(bin_)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((bin_, times))
    return plan


# --- operator -----------------------------------------------------------------------------------------------


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LENGTH, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and a 0; over `most` tokens it is cut. Pieces are packed into as few sequences of at most `most` tokens as minimum
    bin slack finds; whole sequences of one piece need no search. The histogram of lengths, at most `most` numbers, is all that the
    driver sees; the pieces of each length get ranks, in parts of about PART_ROWS, and a rank decides the place.

    Null texts count as empty (one token); very long texts and long runs of white space are encoded whole. Repeated rows are packed each, equal
    ones too. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("copy"), text_of(text_col).alias("text"))
    pieces = scratch.save(rows.mapInArrow(partial(_pieces, vocabulary=vocabulary, most=most), PIECES), batch=BATCH)
    # A full piece is a sequence by itself and needs no rank; its number is negative, where no other sequence has one.
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == most).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < most)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    parts = F.array(*(F.lit(-(-histogram.get(n, 0) // PART_ROWS) or 1) for n in range(most)))
    parted = rest.withColumn("part", F.pmod(F.xxhash64("id", "copy", "piece"), F.get(parts, F.col("length").cast("int"))).cast("int"))
    counts = scratch.save(parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))

    # Where each length's ranks go: ranks from `first` on fill bins that hold `per` of it, in the slots at `offsets`.
    runs, base, used = [], 0, dict.fromkeys(histogram, 0)
    for bin_, times in plan_bins(histogram, most):
        slots: dict[int, list[int]] = {}
        at = 0
        for length in bin_:
            slots.setdefault(length, []).append(at)
            at += length
        for length, offsets in slots.items():
            runs.append((length, used[length], used[length] + times * len(offsets), base, offsets))
            used[length] += times * len(offsets)
        base += times
    plan = spark.createDataFrame(runs, "length long, first long, beyond long, base long, offsets array<int>")

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), "n")
    # Each part of a length covers a range of ranks, so it meets few runs of the plan: both tables are bounded by the number of lengths.
    met = starts.join(plan, "length").where((F.col("first") < F.col("ahead") + F.col("n")) & (F.col("beyond") > F.col("ahead")))
    ranges = scratch.save(met.groupBy("length", "part", "ahead").agg(F.array_sort(F.collect_list(F.struct("first", "beyond", "base", "offsets"))).alias("runs")))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "copy", "piece")) - 1
    ranked = parted.withColumn("own", rank).join(ranges, ["length", "part"]).withColumn("rank", F.col("own") + F.col("ahead"))
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["beyond"])), 1)
    placed = ranked.withColumn("run", run).withColumn("at", F.col("rank") - F.col("run.first"))
    per = F.size("run.offsets")
    shared = placed.select(
        *columns,
        (F.col("run.base") + F.floor(F.col("at") / per)).cast("long").alias("sequence_id"),
        F.get("run.offsets", (F.col("at") % per).cast("int")).cast("long").alias("offset"),
    )
    return shared.unionByName(full)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
