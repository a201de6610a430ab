"""Operator 12, byte-level BPE: texts in overlapping chunks, pre-tokenised in parallel, stitched where their boundaries meet again, then encoded."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_of

VOCABULARY = "byte_bpe_multi_50k"
#: Code points from one chunk's start to the next one's, and how far each reaches into the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Code points from its start on that the pattern may look at to choose a match's alternative; the contractions need three.
AHEAD = 3
#: Whole texts, or chunks, that a Python worker is sent at a time.
BATCH = 200
#: Different pre-tokens whose ids a worker remembers, and the longest of them.
KNOWN, KNOWN_LONG = 200_000, 64

CHUNKS = "row long, id long, k int, ends boolean, text string, n_tokens long, ids_sha256 string, decoded_sha256 string"
CUT = "row long, id long, k int, ends boolean, text string, starts binary, head array<int>, tail array<int>"
ENCODED = "row long, id long, k int, ids binary"
RESULT = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.large_string(), "binary": pa.large_binary(), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --- the tokenizer ------------------------------------------------------------------------------------------


def _ranges(found: str) -> str:
    """The characters as the inside of a character class."""
    points = np.unique(np.frombuffer(found.encode("utf-32-le"), np.uint32))
    edges = np.flatnonzero(np.diff(points) != 1)
    firsts, lasts = points[np.append(0, edges + 1)], points[np.append(edges, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def _compiled(pattern: str, every: str) -> re.Pattern:
    """The pattern for Python's own engine, its classes listed as the library knows them among the characters `every`."""
    import tiktoken

    for name in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        inside = _ranges(one.decode_bytes(one.encode_ordinary(every)).decode())
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{inside}]")
        # Within brackets a class stands as it is, elsewhere in brackets of its own.
        parts = re.split(r"(\[[^]]*\])", pattern)
        pattern = "".join(x.replace(name, inside) if x.startswith("[") else x.replace(name, f"[{inside}]") for x in parts)
    return re.compile(pattern)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into its matches, as the library does. Engines differ in their versions of Unicode, so classes are listed; and the library's own
    recurses once for each white-space character of a run, so that long runs end it."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    narrow = _compiled(pattern, plane).findall  # several times faster than with lists of characters beyond 16 bits
    wide = _compiled(pattern, plane + "".join(map(chr, range(0x10000, 0x110000)))).findall
    return lambda text: narrow(text) if text.isascii() or max(text) <= "\uffff" else wide(text)


class Tokenizer:
    """A rank file of public_tokenizers: pre-tokens to ids, as the library does it pre-token by pre-token, and back to bytes."""

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = splitter(public_tokenizers.PATTERN)
        self.known = _Known(self.library)

    def encode(self, pieces: list[str]) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return self.library.decode_bytes(np.frombuffer(ids, "<u4").tolist())


class _Known(dict):
    def __init__(self, library):
        super().__init__()
        self.library = library

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.library._encode_single_piece(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(piece) <= KNOWN_LONG:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


# --- chunks -------------------------------------------------------------------------------------------------


def cut(split, text: str, ends: bool) -> tuple[np.ndarray, int]:
    """(starts of a chunk's matches and its length, how many of the starts are certain).

    A match is certain when the text's end, or what its choice may look at, lies within the chunk: its alternative is known, and its run ends at a
    character that is seen. The start after a certain match is certain too. Starts are right where the chunk's own start is a boundary.
    """
    starts = np.append(0, np.cumsum([len(p) for p in split(text)], dtype=np.int64))
    if ends:
        return starts, len(starts)
    sure = (starts[1:] < len(text)) & (starts[:-1] + AHEAD <= len(text))
    return starts, 1 + (len(sure) if sure.all() else int(sure.argmin()))


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """A text of one chunk is done at once; longer ones are cut into chunks that overlap."""
    own = tokenizer(vocabulary)
    for batch in batches:
        out = []
        for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            if len(text) <= chunk:
                ids = own.encode(own.split(text))
                out.append((row, i, None, None, None, len(ids) // 4, sha256(ids).hexdigest(), sha256(own.decode(ids)).hexdigest()))
                continue
            for k, at in enumerate(range(0, len(text), chunk)):
                beyond = at + chunk + overlap
                out.append((row, i, k, beyond >= len(text), text[at:beyond], None, None, None))
                if len(out) >= BATCH:
                    yield _batch(CHUNKS, out)
                    out = []
        yield _batch(CHUNKS, out)


def _cuts(batches: Iterator[pa.RecordBatch], vocabulary: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's boundaries, by themselves where it overlaps the chunk before (head) and the one after (tail, in that one's places)."""
    split = tokenizer(vocabulary).split
    for batch in batches:
        out = []
        for row, i, k, ends, text in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            starts, sure = cut(split, text, ends)
            known = starts[:sure]
            head = known[known < overlap] if k else known[:0]
            tail = known[(known >= chunk) & (known < chunk + overlap)] - chunk
            out.append((row, i, k, ends, text, starts.astype("<u4").tobytes(), head.tolist(), tail.tolist()))
        yield _batch(CUT, out)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Ids of each run of chunks. Rows (row, id, k, head, chunks, sync, until, text, starts) stand in the order of row, head, k.

    A run begins at its first chunk's sync and ends `until` code points after its last chunk's own start (null: at its text's end). One chunk is cut where
    its boundaries are; a run of several, which did not meet again, is put together and cut anew, together with what its last chunk has behind it: so it is
    seen that the run ends at a boundary. It does with every pattern whose boundaries are where kinds of characters change, wherever a cut begins; with another
    that fails, it is an error, and a longer overlap helps.
    """
    own = tokenizer(vocabulary)
    parts: list[str] = []
    for batch in batches:
        out = []
        for row, i, k, head, chunks, sync, until, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunks == 1:
                at = np.frombuffer(starts, "<u4")
                end = len(text) if until is None else until
                at = at[(at >= sync) & (at <= end)].tolist()
                out.append((row, i, head, own.encode([text[a:b] for a, b in zip(at, at[1:], strict=False)])))
                continue
            last = k == head + chunks - 1
            parts.append(text[sync if k == head else 0 : until if last else chunk])
            if last:
                size = sum(map(len, parts))
                pieces = own.split("".join([*parts, text[until:] if until is not None else ""]))
                ends = np.cumsum([len(p) for p in pieces])
                found = int(np.searchsorted(ends, size))
                if ends[found] != size:
                    raise ValueError(f"the chunks of text {i} do not meet again behind chunk {k}; enlarge the overlap")
                parts = []
                out.append((row, i, head, own.encode(pieces[: found + 1])))
        yield _batch(ENCODED, out)


def _digest(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Digests of each text's ids and decoded bytes from its runs, which stand in order; only one run is held at a time."""
    own, now, out = tokenizer(vocabulary), None, []
    for batch in batches:
        for row, i, _, ids in zip(*batch.columns, strict=True):
            row = row.as_py()
            if now is None or now[0] != row:
                if now:
                    out.append((now[1], now[2], now[3].hexdigest(), now[4].hexdigest()))
                now = [row, i.as_py(), 0, sha256(), sha256()]
            ids = ids.as_py()
            now[2] += len(ids) // 4
            now[3].update(ids)
            now[4].update(own.decode(ids))
        yield _batch(RESULT, out)
        out = []
    if now:
        yield _batch(RESULT, [(now[1], now[2], now[3].hexdigest(), now[4].hexdigest())])


# --- operator -----------------------------------------------------------------------------------------------


def _runs(cuts: DataFrame) -> DataFrame:
    """(row, k, head, chunks, sync, until): the run of chunks that each chunk belongs to.

    A chunk's sync is the first place where its boundaries and those of the chunk before agree: from there on both cut alike, as a match depends on
    nothing before it. Chunks without one belong to the run of the chunk before. Only places are read here, no texts.
    """
    after = cuts.select("row", (F.col("k") + 1).alias("k"), "tail")
    met = cuts.select("row", "k", "head").join(after, ["row", "k"], "left")
    found = met.select("row", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("own"))
    in_order = Window.partitionBy("row").orderBy("k")  # a text has at most some ten thousand chunks
    begun = found.withColumn("head", F.max(F.when(F.col("own").isNotNull(), F.col("k"))).over(in_order))
    nxt = begun.withColumn("next", F.lead("own").over(in_order))
    run = Window.partitionBy("row", "head")
    return nxt.select("row", "k", "head", F.count(F.lit(1)).over(run).cast("int").alias("chunks"), F.max("own").over(run).alias("sync"), F.max(F.struct("k", "next")).over(run)["next"].alias("until"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: (id, n_tokens, ids_sha256, decoded_sha256), by the ranks of a vocabulary file.

    Digests (lowercase hex) are of the ids as little-endian 32-bit numbers and of the bytes that they decode to. Texts longer than `chunk` code points
    are cut into chunks which overlap and are spread over all tasks: each is pre-tokenised from its own start, neighbours are stitched where their
    boundaries meet, and the pre-tokens between are encoded. Where an overlap holds no common boundary (a run of letters longer than it), the chunks
    are put together and cut as one text, so results do not depend on chunk or overlap. Digests of a long text are folded run by run.

    Null texts count as empty: no tokens. Special tokens' strings are ordinary text. Repeated rows and ids and null ids are returned each. Other columns
    are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    size = {"vocabulary": vocabulary, "chunk": chunk, "overlap": overlap}
    first = scratch.save(rows.mapInArrow(partial(_chunks, **size), CHUNKS), batch=BATCH)
    columns = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    pieces = first.where("k is not null").select("row", "id", "k", "ends", "text").repartition("row", "k")
    cuts = scratch.save(pieces.mapInArrow(partial(_cuts, **size), CUT), batch=BATCH)
    runs = scratch.save(_runs(cuts))
    joined = cuts.drop("head").join(runs.hint("merge"), ["row", "k"]).select("row", "id", "k", "head", "chunks", "sync", (F.col("until") + chunk).cast("int").alias("until"), "text", "starts")
    ordered = joined.repartition("row", "head").sortWithinPartitions("row", "head", "k")
    encoded = scratch.save(ordered.mapInArrow(partial(_encode, vocabulary=vocabulary, chunk=chunk), ENCODED), batch=BATCH)
    folded = encoded.repartition("row").sortWithinPartitions("row", "k").mapInArrow(partial(_digest, vocabulary=vocabulary), RESULT)
    long_ones = scratch.save(folded, batch=BATCH)
    scratch.drop(cuts, runs, encoded)
    return first.where("k is null").select(*columns).unionByName(long_ones).withColumnRenamed("id", id_col)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
