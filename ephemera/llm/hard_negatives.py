"""Operator 11, hard-negative mining: positives' upper limits split scores into slots, whose best rows answer all overlapping windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import matrix, of_usual_length, usable, whole

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors, and rows (least and most), that meet in one block. Rows per block are the 256th part of all between the two.
ANCHORS, ROWS_LEAST, ROWS_MOST = 8192, 2048, 32_768
#: Scores that a block computes at a time.
SCORES = 1 << 21
FOUND = "anchor long, slot int, row long, id long, score long"


def block_rows(n: int) -> int:
    return min(ROWS_MOST, max(ROWS_LEAST, n // 256))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b as int64; in floating point where that is exact. Products beyond a long are an error."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.array([[int(v) for v in row] for row in a.astype(object) @ b.T.astype(object)], np.int64)


def best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k positions of `at` (ascending) with the highest scores, by falling score; of equal ones the first."""
    if len(at) > k:
        s = score[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > least]
        at = np.concatenate([above, at[s == least][: k - len(above)]])
    return at[np.lexsort((at, -score[at]))]


def _blocks(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray, pa.Table]]:
    """(anchor's values, its scores with all rows, whether each row has its label, rows by id): rows of equal scores stand in the order of ties."""
    rows = rows.sort_by([("tie", "ascending"), ("row", "ascending")])
    d = len(rows.column("x")[0])
    x, label = matrix(rows.column("x"), d), rows.column("label").to_numpy()
    told = anchors.drop_columns(["vector"]).to_pylist()
    vectors, step = matrix(anchors.column("vector"), d), max(1, SCORES // len(rows))
    for at in range(0, len(told), step):
        got = scores(vectors[at : at + step], x)
        for anchor, score in zip(told[at : at + step], got, strict=True):
            yield anchor, score, label == anchor["own"], rows


def _table(rows: pa.Table | None, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """FOUND from (anchor, slot, places in rows, their scores)."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in FOUND.split(", ")]
    if not found:
        return pa.table([pa.array([], k) for k in kinds], names)
    anchors, slots, places, values = zip(*found, strict=True)
    sizes = [len(at) for at in places]
    picked = rows.select(["row", "id"]).take(pa.array(np.concatenate(places), pa.int64()))
    columns = [pa.array(np.repeat(anchors, sizes), kinds[0]), pa.array(np.repeat(slots, sizes), kinds[1]), picked.column("row"), picked.column("id"), pa.array(np.concatenate(values), kinds[4])]
    return pa.table(columns, names)


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best other rows of its label in the block, for each anchor."""
    if not len(rows) or not len(anchors):
        return _table(None, [])
    found, by_tie = [], None
    for anchor, score, same, by_tie in _blocks(rows, anchors):
        at = best(score, np.flatnonzero(same & (by_tie.column("row").to_numpy() != anchor["anchor"])), k)
        found.append((anchor["anchor"], 0, at, score[at]))  # copies, so that no block's scores are kept
    return _table(by_tie, found)


def _slots(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best rows of other labels in each of an anchor's slots: slot i holds the scores up to limits[i] and above limits[i + 1]."""
    if not len(rows) or not len(anchors):
        return _table(None, [])
    found, by_tie = [], None
    for anchor, score, same, by_tie in _blocks(rows, anchors):
        limits = np.array(anchor["limits"], np.int64)
        at = np.flatnonzero(~same & (score <= limits[0]) & (score >= anchor["least"]))
        slot = len(limits) - 1 - np.searchsorted(limits[::-1], score[at], "left")
        for i in np.unique(slot):
            top = best(score, at[slot == i], k)
            found.append((anchor["anchor"], int(i), top, score[top]))
    return _table(by_tie, found)


def mine(
    rows: DataFrame, anchors: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's hard negatives.

    anchors: a condition on id, the name that id_col has in it. Scores are inner products of floor(256 * entry). An anchor's positives are its
    `positives` best other rows of its label; a positive's negatives are the `negatives` best rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score, ranked from 1. Equal scores: smaller id first, null ids last, then any fixed order.

    Anchors meet all rows in blocks of bounded size, twice. The first pass finds positives. Their upper limits split an anchor's scores into
    disjoint slots; the second keeps the best of each slot by block, then over all blocks. A window of scores is the slots from its upper limit down,
    merged in falling order as far as `negatives` rows and the lower limit, so overlapping windows share what the slots hold.

    Rows take no part whose label or vector is null, or whose vector is empty, of another length than most, or has null or non-finite entries. A
    positive with a score below 0 has no window. Repeated rows are rows of their own: each is an anchor, and a copy of an anchor can be its positive.
    Other columns are ignored; an empty table gives an empty result. Scores that a long cannot hold are an error.
    """
    scratch = Scratch(rows.sparkSession)
    vector = F.col(vector_col)
    told = rows.where(usable(vector) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(vector).alias("x"))
    kept, _ = of_usual_length(told, "x")
    tie = F.coalesce("id", F.lit((1 << 63) - 1))
    taken = scratch.save(kept.select("id", tie.alias("tie"), "label", "x", F.monotonically_increasing_id().alias("row")))
    # Names of their own: a cogroup loses right columns that are the left's.
    chosen = taken.where(anchors).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.col("label").alias("own"), F.col("x").alias("vector"))
    n, m = taken.count(), chosen.count()
    parts, sets = max(1, -(-n // block_rows(n))), max(1, -(-m // ANCHORS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Blocks are dealt by the hash of a row's number, which is its own, so they are of about one size however ids and labels repeat.
    in_blocks = taken.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("s", every(sets)).groupBy("b", "s")

    def meet(asking: DataFrame, work: Callable[[pa.Table, pa.Table, int], pa.Table], k: int) -> DataFrame:
        asked = asking.withColumn("s", F.pmod(F.xxhash64("anchor"), F.lit(sets)).cast("int")).withColumn("b", every(parts))
        return in_blocks.cogroup(asked.groupBy("b", "s")).applyInArrow(lambda rows, anchors: work(rows, anchors, k), FOUND)

    tied = F.coalesce("id", F.lit((1 << 63) - 1))
    by_score = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), tied, "row"))
    met = meet(chosen, _positives, positives).withColumn("at", by_score("anchor")).where(F.col("at") <= positives)
    # A limit on whole scores: 100 * s <= high * p is s <= floor(high * p / 100), and so on. Below 0 no score meets both.
    up, down = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100"), F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100")
    pairs = scratch.save(met.where("score >= 0").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), up.alias("up"), down.alias("down"), "at"))
    limits = pairs.groupBy("anchor").agg(F.sort_array(F.collect_set("up"), asc=False).alias("limits"), F.min("down").alias("least"))
    asking = scratch.save(chosen.join(limits, "anchor"))
    slots = meet(asking.drop("anchor_id"), _slots, negatives).withColumn("at", by_score("anchor", "slot")).where(F.col("at") <= negatives)
    # At most positives * negatives rows an anchor: slots fall, so the sorted list holds every suffix of them as one run.
    falling = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("fall"), tied.alias("tie"), "row", "slot", "id", "score")))
    lists = slots.groupBy("anchor").agg(falling.alias("list"))
    windows = pairs.join(asking.select("anchor", "anchor_id", "limits"), "anchor").join(lists, "anchor")
    first = F.array_position("limits", F.col("up")) - 1
    merged = F.slice(F.filter("list", lambda e: e["slot"] >= first), 1, negatives)
    inside = F.filter(merged, lambda e: e["score"] >= F.col("down"))
    got = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("k", "e"))
    return got.select("anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th row against all; every 7th has a label that is not its own."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), "id % 100 = 0")


OP11_SQL = f"""WITH told AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM told a, told r WHERE a.id % 100 = 0 AND r.id <> a.id),
pos AS (SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
neg AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}"""
