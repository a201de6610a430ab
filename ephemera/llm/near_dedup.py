"""Operator 9, MinHash near-dedup: one-permutation signatures, banded buckets, star-shaped candidate edges, exact links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_of
from .components import connected_components
from .shingles import band_keys, one_permutation, set_digest, shingle_sets

#: Two sets are linked when 100 * intersection >= SHARE * union.
SHARE = 80
#: BANDS keys of ROWS bins each. At a similarity of 0.8 a pair shares no key with probability (1 - 0.8**8)**64 = 8e-6; at 0.4 it shares one in 4 %.
ROWS, BANDS = 8, 64
#: Bins (16 bits of each) that are kept to estimate similarities. The deviation of an estimate is below sqrt(0.25 / bins).
KEPT = 256
DEVIATION = (0.25 / KEPT) ** 0.5

#: Rows that a Python worker is sent at a time: whole texts, or pairs of them.
BATCH = 500
#: Members of a block when the rest of a hub's rays is compared, on either side, and shingles of all of them: about so many at most, so that a group of
#: very long documents falls into blocks of fewer.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 21
#: Pairs of stars that are tried before rays are compared in blocks.
STARS = 2

SIGNED = "id long, n long, d1 long, d2 long, keys array<long>, bins array<short>"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int16())]
    names = [x.split()[0] for x in SIGNED.split(", ")]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        out: list[list] = [[] for _ in names]

        def flush(out: list[list] = out) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
            for x in out:
                x.clear()
            return made

        for i, found in zip(ids, shingle_sets(texts, width), strict=True):
            if len(found):
                bins = one_permutation(found, ROWS * BANDS)
                d = np.frombuffer(set_digest(found), np.int64)
                row = (i, len(found), int(d[0]), int(d[1]), band_keys(bins, ROWS), bins[:KEPT].astype(np.uint16).view(np.int16))
            else:
                row = (i, 0, 0, 0, None, None)
            for x, v in zip(out, row, strict=True):
                x.append(v)
            if len(out[0]) == 500:
                yield flush()
        yield flush()


def _linked(batches: Iterator[pa.RecordBatch], width: int, share: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b) whose whole shingle sets are linked. Pairs with one a stand together, so its set is made once."""
    last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        ids_a, ids_b, texts_a = batch.column(0), batch.column(1), batch.column(2)
        keep = []
        for k, theirs in enumerate(shingle_sets(batch.column(3), width)):
            text = texts_a[k].as_py()
            if text != last[0]:
                last = (text, next(shingle_sets(pa.array([text]), width)))
            both = len(np.intersect1d(last[1], theirs, assume_unique=True))
            keep.append(100 * both >= share * (len(last[1]) + len(theirs) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([ids_a.filter(mask), ids_b.filter(mask)], ["a", "b"])


class _Linker:
    """Tells which candidate edges are links, over whole texts, and keeps account of those already asked."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, width: int, share: int):
        self.docs, self.scratch, self.width, self.share = docs, scratch, width, share
        self.classes = classes
        self.texts: DataFrame | None = None

    def possible(self, edges: DataFrame) -> DataFrame:
        """Edges whose sizes leave room for a link and whose estimated similarity is at most six deviations below the threshold."""
        side = lambda x: self.classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
        both = edges.join(side("a"), "a").join(side("b"), "b")
        sized = 100 * F.least("n_a", "n_b") >= self.share * F.greatest("n_a", "n_b")
        alike = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / KEPT
        return both.where(sized & (alike >= self.share / 100 - 6 * DEVIATION)).select("a", "b")

    def gather(self, ids: DataFrame) -> None:
        """Writes the texts of all documents that share a bucket with another, once: the only time that whole texts are dealt out by id.

        Merged at every size: these ids grow with the documents, so a broadcast on small tables would not hold on large ones.
        """
        self.texts = self.scratch.save(self.docs.join(ids.distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    def links(self, edges: DataFrame) -> DataFrame:
        """The edges that are links, of edges between documents whose texts are gathered."""
        edges = self.scratch.save(edges)
        texts = self.texts
        right = edges.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        pairs = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        links = self.scratch.save(pairs.mapInArrow(partial(_linked, width=self.width, share=self.share), "a long, b long"), batch=BATCH)
        self.scratch.drop(edges)
        return links

    def _dealt(self, groups: DataFrame, *columns: str) -> DataFrame:
        """Rows of groups(hub, id, own, out) as blocks (hub, i, j), with columns of their classes: those that are out (out stays true), and all (false), of at
        most about BLOCK_ROWS members and BLOCK_SHINGLES shingles on either side, so that no task holds a whole group."""
        # Sizes are counted map-side first and joined by a merge, so a hot hub's rows are split while it runs.
        known = groups.join(self.classes.select("id", *{"n", *columns}), "id")
        blocks = lambda some: F.greatest(F.ceil(F.count(F.when(some, 1)) / BLOCK_ROWS), F.ceil(F.sum(F.when(some, F.col("n"))) / BLOCK_SHINGLES))
        sizes = known.groupBy("hub").agg(blocks(F.lit(True)).alias("all"), blocks(F.col("out")).alias("outs"))
        rows = known.join(sizes, "hub")
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = rows.where("out").select("hub", "id", "own", F.lit(True).alias("out"), place("outs").alias("i"), F.explode(span("all")).alias("j"), *columns)
        right = rows.select("hub", "id", "own", F.lit(False).alias("out"), F.explode(span("outs")).alias("i"), place("all").alias("j"), *columns)
        return left.unionByName(right)

    def with_partners(self, groups: DataFrame) -> DataFrame:
        """The rows of groups to which sizes and signatures leave a partner in another component. At most the rows leave a block, never their pairs, and
        signatures are a tenth of usual texts, so few texts are copied into blocks afterwards."""
        share = self.share

        def meet(block: pa.Table) -> pa.Table:
            return _partners_in_block(block, share)

        found = self._dealt(groups, "n", "bins").groupBy("hub", "i", "j").applyInArrow(meet, "hub long, id long")
        return self.scratch.save(groups.join(found.distinct(), ["hub", "id"], "left_semi"))

    def rest(self, groups: DataFrame) -> DataFrame:
        """Links between members of one hub's group(hub, id, own, out) in different components, of which one at least is out.

        The pairs of a block are compared where they stand, and at most one link for a member and a component, which stands for its least node, leaves
        it.
        """
        some = self.with_partners(groups)
        width, share = self.width, self.share

        def compare(block: pa.Table) -> pa.Table:
            return _linked_in_block(block, width, share)

        dealt = self._dealt(some).join(self.texts, "id")
        links = self.scratch.save(dealt.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct())
        self.scratch.drop(some)
        return links


def _partners_in_block(block: pa.Table, share: int) -> pa.Table:
    ids, own, out, n, hub = (block[c].to_numpy() for c in ("id", "own", "out", "n", "hub"))
    bins = np.asarray(block["bins"].combine_chunks().flatten().to_numpy(), np.int16).reshape(len(ids), -1)
    left, right = np.flatnonzero(out), np.flatnonzero(~out)
    some = np.zeros(len(ids), bool)
    for k in left:
        could = (own[right] != own[k]) & (100 * np.minimum(n[right], n[k]) >= share * np.maximum(n[right], n[k]))
        rest = right[could]
        met = rest[(bins[rest] == bins[k]).mean(1) >= share / 100 - 6 * DEVIATION] if len(rest) else rest
        some[k] |= bool(len(met))
        some[met] = True
    return pa.table({"hub": pa.array(hub[some], pa.int64()), "id": pa.array(ids[some], pa.int64())})


def _linked_in_block(block: pa.Table, width: int, share: int) -> pa.Table:
    block = block.combine_chunks()
    text = block["text"].combine_chunks() if isinstance(block["text"], pa.ChunkedArray) else block["text"]
    sets = list(shingle_sets(text, width))
    ids, own, out = (block[c].to_numpy() for c in ("id", "own", "out"))
    sizes = np.array([len(x) for x in sets])
    right = np.flatnonzero(~out)
    if not len(right):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    pool = np.concatenate([sets[k] for k in right])
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], np.repeat(np.arange(len(right)), sizes[right])[order]
    a, b = [], []
    for k in np.flatnonzero(out):
        low, high = np.searchsorted(pool, sets[k], "left"), np.searchsorted(pool, sets[k], "right")
        runs = high - low
        at = np.repeat(low - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(runs.sum())
        both = np.bincount(owner[at], minlength=len(right))
        hit = (own[right] != own[k]) & (100 * both >= share * (sizes[right] + sizes[k] - both))
        other = np.unique(own[right[hit]])
        a += [ids[k]] * len(other)
        b += other.tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id): the classes of near-duplicate documents.

    Words are runs of characters other than space and 0x09-0x0D, with A-Z lowered. A document's set holds its distinct shingles
    of `width` words, or all its words as one shingle if there are fewer. Documents are linked when 100 * intersection
    >= share * union; component_id is the smallest id reachable over links.

    1. Each set gets a 128-bit digest and a one-permutation signature. Documents with equal sets form a class whose
       smallest id stands for it, so copies cost no pairs.
    2. Classes meet in banded buckets. In each bucket the smallest id is the hub of a star: at most one candidate edge for each row.
    3. Edges that sizes or signatures rule out go; the rest is confirmed on full sets: first one edge for each document, then
       those that still join two components.
    4. A star can miss a link between two of its rays. Where a hub's rays are still in several components, STARS more pairs of stars are
       tried, and then each ray outside the hub's component is compared with the hub and its rays in other components, in blocks. So of two
       documents that share a bucket no link is lost.

    Null and empty texts, and texts without words, have an empty set: n_shingles 0, linked with nothing. Rows that share an id are one
    document (the least text counts for links). Rows with a null id join the class of their text, but name no component. Texts of any length are
    read whole. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(partial(_sign, width=width), SIGNED), batch=BATCH)
    classes = scratch.save(
        signed.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bins").alias("bins"))
    )
    members = classes.select(F.explode("keys").alias("key"), "id")
    hubs = scratch.save(members.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "hub"))
    shared = scratch.save(members.join(hubs, "key").select("hub", "id").distinct())
    scratch.drop(hubs)
    linker = _Linker(docs, classes, scratch, width, share)
    linker.gather(shared.select("id"))
    possible = scratch.save(linker.possible(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))))
    found = [linker.links(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))]
    parts = connected_components(found[0], scratch)

    def joined(links: DataFrame) -> DataFrame:
        """The components with further links."""
        found.append(links)
        scratch.drop(parts)
        return connected_components(reduce(DataFrame.union, found), scratch)

    parts = joined(linker.links(_crossing(possible, parts)))
    scratch.drop(possible)
    opened = scratch.save(open_groups(shared, parts))
    for k in range(STARS):  # a few more stars join most of what is apart
        if opened.isEmpty():
            break
        parts = joined(linker.links(linker.possible(second_stars(opened, k))))
        scratch.drop(opened)
        opened = scratch.save(open_groups(shared, parts))
    if not opened.isEmpty():
        parts = joined(linker.rest(opened))
    scratch.drop(linker.texts, shared, opened, *found)
    rep = signed.join(classes.select("d1", "d2", F.col("id").alias("rep")), ["d1", "d2"], "left")
    told = rep.select("id", "n", F.coalesce("rep", "id").alias("rep")).join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    out = told.select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def open_groups(rays: DataFrame, parts: DataFrame) -> DataFrame:
    """(hub, id, own, out): the rays of hubs with rays in other components (out) than the hub's own, where two rays may be linked."""
    at = with_parts(with_parts(rays, parts).withColumnRenamed("component", "own"), parts, "hub")
    told = at.select("hub", "id", "own", (F.col("own") != F.col("component")).alias("out"))
    mixed = told.groupBy("hub").agg(F.max("out").alias("some"), (F.min("own") != F.max("own")).alias("several")).where("some and several")
    return told.join(mixed.select("hub"), "hub", "left_semi")


def second_stars(opened: DataFrame, salt: int = 0) -> DataFrame:
    """(a, b): stars around one further member on either side of each group, to the members of other components."""
    pick = F.struct(F.xxhash64(F.lit(salt), "id"), "id", "own")
    centres = opened.groupBy("hub").agg(F.min(F.when(F.col("out"), pick)).alias("far"), F.min(F.when(~F.col("out"), pick)).alias("near"))
    rows = opened.select("hub", "id", "own").join(centres, "hub").select("id", "own", F.explode(F.array("far", "near")).alias("c"))
    met = rows.where(F.col("own") != F.col("c.own"))
    return met.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def with_parts(df: DataFrame, parts: DataFrame, column: str = "id") -> DataFrame:
    """Adds the component of a column's nodes; a node without links is its own."""
    named = parts.select(F.col("node").alias(column), "component")
    return df.join(named, column, "left").withColumn("component", F.coalesce("component", column))


def _crossing(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose ends are in different components."""
    a = with_parts(edges, parts, "a").withColumnRenamed("component", "part_a")
    return with_parts(a, parts, "b").where("part_a <> component").select("a", "b")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reach JOIN linked ON other = a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
