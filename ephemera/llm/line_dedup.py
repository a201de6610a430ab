"""Operator 7, line dedup: fuzzy lines by MinHash of character shingles, exact Jaccard verification and distributed union-find.

Everything runs in DataFrame operations; a line's shingles are hashed and reduced to minima in generated code, as rows of STEP shingles each.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, table, text_of
from .components import connected_components
from .near_dedup import open_groups, with_parts

#: Characters of a shingle; lines are linked at this Jaccard similarity, in tenths, of their shingle sets.
WIDTH, TENTHS = 12, 8
#: A signature has FAMILIES * MASKS minima over all overlapping shingles: a family orders them by their 64-bit hashes, rotated by TURN bits a
#: family; a mask turns the order around, and the masks of a family differ in their highest bits. Two lines agree in a minimum with the
#: probability of their similarity, however few or many shingles they have.
FAMILIES, MASKS, TURN = 6, 4, 10
#: Rows are made of STEP shingles each, so that a line is looked up once for STEP of them; short lines repeat fewer with a small STEP.
STEP = 2
#: 16 bands of three minima of three families, each minimum in two bands and no two bands with a common pair. In simulations pairs at a
#: similarity of 0.8 share no band with probability 3e-4 or less, at 0.85 with 5e-5, with 5 to 350 shingles in their unions.
BANDS = [tuple((3 * s + r) * MASKS + (p ^ turn) for r, turn in enumerate(turns)) for s in (0, 1) for turns in ((0, 0, 0), (0, 1, 2)) for p in range(MASKS)]
#: A sketch holds eight bits of each minimum, in words of eight. Pairs that agree in fewer than ALIKE of them are not compared; at a similarity of
#: 0.8 that loses 5e-5 of pairs.
WORDS, ALIKE = FAMILIES * MASKS // 8, 11
SKETCH = [f"s{w}" for w in range(WORDS)]
#: Members of a block when the rest of a band's or hub's rays is compared, on either side.
BLOCK_ROWS = 256
#: Before rays are compared with one another, they are compared with so many centres of their group, so many times over.
CENTRES, ROUNDS = 8, 1
#: Words of the map of a line's hashes that bounds what two lines have in common.
MAP_WORDS = 48


def _mask(family: int, k: int) -> int:
    """A mask as a signed 64-bit number; its highest bits are those of k."""
    low = int.from_bytes(blake2b(bytes((family, k)), digest_size=8).digest(), "little")
    value = (low >> (MASKS - 1).bit_length()) | k << (64 - (MASKS - 1).bit_length())
    return value - (1 << 64) if value >> 63 else value


def _last(codes: Column) -> Column:
    """The number of the last shingle of a line given as UTF-32."""
    return F.greatest(F.lit(0), (F.length(codes) / 4).cast("int") - WIDTH)


def _shingle(codes: Column, at: Column) -> Column:
    """The hash of shingle `at`, counted from 0; a line shorter than a shingle is its only one."""
    return F.xxhash64(F.substring(codes, at * 4 + 1, F.lit(4 * WIDTH)))


def _signatures(lines: DataFrame) -> DataFrame:
    """(k1, k2, v0, v1, ...): the minima of every line of lines(k1, k2, line), which needs no shuffle where lines are dealt out by k1 and k2."""
    codes = lines.select("k1", "k2", F.encode("line", "UTF-32").alias("codes")).withColumn("last", _last(F.col("codes")))
    rows = codes.select("k1", "k2", "codes", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("at"))
    # Beyond the end the last shingle stands again, which changes no minimum.
    hashed = rows.select("k1", "k2", *(_shingle(F.col("codes"), F.least("last", F.col("at") + j)).alias(f"h{j}") for j in range(STEP)))

    def turned(h: str, bits: int) -> Column:
        return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else F.col(h)

    families = hashed.select("k1", "k2", *(turned(f"h{j}", TURN * f).alias(f"h{j}_{f}") for f in range(FAMILIES) for j in range(STEP)))
    least = lambda f, k: F.min(F.least(*(F.col(f"h{j}_{f}").bitwiseXOR(F.lit(_mask(f, k))) for j in range(STEP))))
    return families.groupBy("k1", "k2").agg(*(least(f, k).alias(f"v{f * MASKS + k}") for f in range(FAMILIES) for k in range(MASKS)))


def _sketch() -> list[Column]:
    part = lambda w, b: F.shiftleft(F.col(f"v{8 * w + b}").bitwiseAND(F.lit(255)), 8 * b)
    return [reduce(Column.bitwiseOR, (part(w, b) for b in range(8))).alias(name) for w, name in enumerate(SKETCH)]


def _alike(a: list[Column], b: list[Column]) -> Column:
    """Whether two sketches agree in ALIKE minima or more."""
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        bits = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # a byte that is not 0 gets its lowest bit set; bits of higher bytes that come in from above are cut off
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(_low_bits(8 - shift))))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(_low_bits(1))))
    return differ <= 8 * WORDS - ALIKE


def _low_bits(n: int) -> int:
    """A word whose bytes have their lowest n bits set."""
    return int.from_bytes(bytes([(1 << n) - 1] * 8), "little")


def _hashes(line: str) -> Column:
    """The hashes of all shingles of a line, repeated ones too; a line shorter than a shingle is its only one."""
    at = lambda codes: F.sequence(F.lit(1), 4 * _last(codes) + 1, F.lit(4))
    return let(F.encode(line, "UTF-32"), lambda codes: F.transform(at(codes), lambda i: F.xxhash64(F.substring(codes, i, F.lit(4 * WIDTH)))))


def _similar(x: str, y: str, n: Column | None = None) -> Column:
    """Whether two lines' hashes are similar enough as sets: both >= similarity * (x + y - both); n: the sum of both sets' sizes, where known."""
    both = F.size(F.array_intersect(x, y))
    return 10 * both >= TENTHS * F.size(F.array_union(x, y)) if n is None else (10 + TENTHS) * both >= TENTHS * n


def _told(x: str) -> list[Column]:
    """The sketch of a line, under names that end in x."""
    return [F.col(c).alias(f"{c}_{x}") for c in SKETCH]


def _possible() -> Column:
    """Whether the sketches of lines a and b leave room for a link."""
    return _alike([F.col(f"{c}_a") for c in SKETCH], [F.col(f"{c}_b") for c in SKETCH])


def _stars(edges: DataFrame, met: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (a, b) that are links, between lines of met(id, line, *SKETCH). Only for those that sketches leave are lines compared."""
    side = lambda x: met.select(F.col("id").alias(x), *_told(x))
    possible = scratch.save(edges.join(side("a"), "a").join(side("b"), "b").where(_possible()).select("a", "b"))
    text = lambda x: met.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"))
    both = F.struct(_hashes("line_a").alias("x"), _hashes("line_b").alias("y"))
    # Made by explode(), the sets are stored before they are compared; a filter would make them anew wherever it names them.
    pairs = possible.join(text("a"), "a").join(text("b"), "b").select("a", "b", F.explode(F.array(both)).alias("sets"))
    links = scratch.save(pairs.where(_similar("sets.x", "sets.y")).select("a", "b"))
    scratch.drop(possible)
    return links


def _dealt(groups: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups(by, id, out, ...) as blocks (by, i, j): those that are out, and all, of at most about BLOCK_ROWS rows each, so that no task
    holds a whole group; each row that is out meets each row of its group in one block."""
    sizes = groups.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("all"), F.ceil(F.sum(F.col("out").cast("int")) / BLOCK_ROWS).alias("outs"))
    rows = groups.join(sizes, by)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    span = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = rows.where("out").withColumns({"i": place("outs"), "j": F.explode(span("all"))})
    right = rows.withColumns({"i": F.explode(span("outs")), "j": place("all")})
    return left.drop("all", "outs"), right.drop("all", "outs")


def _shared(known: DataFrame) -> DataFrame:
    """(band, hub, id): each line of known(id, keys) with the first line of a band that it shares; band is null where the two are all of it, since
    two rays can meet only in bands of three and more."""
    # Lines are dealt by band once, for the hubs and for their rays: the conditions that either side needs stand before, so that both read one shuffle.
    members = known.select(F.explode("keys").alias("band"), "id").where("band is not null and id is not null").repartition("band")
    hubs = members.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    rays = members.join(hubs.hint("shuffle_hash"), "band").where("id <> hub")
    return rays.select(F.when(F.col("size") > 2, F.col("band")).alias("band"), "hub", "id")


def _open_bands(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, hub, id, own, out): the rays of bands with rays in other components (out) than the hub's, where two rays may be linked."""
    at = with_parts(with_parts(shared.where("band is not null"), parts).withColumnRenamed("component", "own"), parts, "hub")
    told = at.select("band", "hub", "id", "own", (F.col("own") != F.col("component")).alias("out"))
    mixed = told.groupBy("band").agg(F.max("out").alias("some"), (F.min("own") != F.max("own")).alias("several")).where("some and several")
    return told.join(mixed.select("band"), "band", "left_semi")


def _with_partners(opened: DataFrame, known: DataFrame) -> DataFrame:
    """(hub, id) of the rays to which sketches leave a partner in their band. At most the rays leave the join, never their pairs."""
    left, right = _dealt(opened.join(known.select("id", *SKETCH), "id"), "band")
    one = left.select("band", "i", "j", "hub", F.col("id").alias("id_a"), F.col("own").alias("own_a"), *_told("a"))
    other = right.select("band", "i", "j", "hub", F.col("id").alias("id_b"), F.col("own").alias("own_b"), "out", *_told("b"))
    meets = lambda x, y: [x[c] == y[c] for c in ("band", "i", "j")] + [F.col("own_a") != F.col("own_b"), _possible()]
    outs = one.join(other, meets(one, other), "left_semi").select("hub", F.col("id_a").alias("id"))
    ins = other.where("not out").join(one, meets(other, one), "left_semi").select("hub", F.col("id_b").alias("id"))
    return outs.unionByName(ins).distinct()


def _maps(ids: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, lost, m0, m1, ...): of each line the number of its hashes, a map of 64 * MAP_WORDS bits that has a bit for each, and how many of
    them share a bit with another. Two lines have at most the bits that both maps have, and the lesser lost, in common."""
    lines = known.select("id", "line").join(ids.distinct(), "id", "left_semi").repartition("id")
    bit = lines.select("id", F.explode(F.array_distinct(_hashes("line"))).alias("h")).select("id", F.pmod("h", F.lit(64 * MAP_WORDS)).cast("int").alias("bit"))
    bit = bit.select("id", F.shiftrightunsigned("bit", 6).alias("word"), F.expr("shiftleft(1L, bit & 63)").alias("one"))
    # Bits are put together by word first, so that only words, not hashes, are asked for their place among MAP_WORDS.
    bits = bit.groupBy("id", "word").agg(F.bit_or("one").alias("bits"), F.count(F.lit(1)).alias("n"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")).alias(f"m{w}") for w in range(MAP_WORDS)]
    maps = bits.groupBy("id").agg(F.sum("n").cast("int").alias("n"), *words)
    set_ = reduce(Column.__add__, (F.bit_count(f"m{w}") for w in range(MAP_WORDS)))
    return scratch.save(maps.withColumn("lost", F.col("n") - set_))


def _compared(left: DataFrame, right: DataFrame, by: tuple[str, ...], told: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components, of rows (*by, id, own, out) that meet in a block, in different components. told: lines with their sketches and maps,
    (id, line, *SKETCH, n, lost, m0, m1, ...). Two rows that are out meet twice, and are compared once. Only links leave the join, and of a task at
    most one for two components.

    Sketches rule pairs out first, then what their maps can have in common at most, and the sets themselves decide.
    """
    numbers = [c for c in told.columns if c not in ("id", "line")]

    def side(df: DataFrame, x: str) -> DataFrame:
        # Lines are hashed where their blocks are, since texts are shuffled at a fraction of what their hashes would be.
        placed = df.select(*by, "id", "own", "out").join(told, "id").select(*by, "id", "own", "out", "line", *numbers).repartition(*by)
        return placed.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "own", "out", *numbers)), F.explode(F.array(_hashes("line"))).alias(f"hashes_{x}"))

    one, other = side(left, "a"), side(right, "b")
    once = ~(F.col("out_a") & F.col("out_b")) | (F.col("id_a") < F.col("id_b"))
    most = reduce(Column.__add__, (F.bit_count(F.col(f"m{w}_a").bitwiseAND(F.col(f"m{w}_b"))) for w in range(MAP_WORDS))) + F.least("lost_a", "lost_b")
    enough = (10 + TENTHS) * most >= TENTHS * (F.col("n_a") + F.col("n_b"))
    meets = [one[c] == other[c] for c in by] + [F.col("own_a") != F.col("own_b"), once, _possible(), enough, _similar("hashes_a", "hashes_b", F.col("n_a") + F.col("n_b"))]
    return scratch.save(one.join(other, meets).select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b")).distinct())


def _centred(groups: DataFrame, told: DataFrame, salt: int, scratch: Scratch) -> DataFrame:
    """Links of each hub's group(hub, id, own, out) to CENTRES of its members, in blocks of its members with all centres."""
    pick = lambda c: F.min(F.struct(F.xxhash64(F.lit(salt * CENTRES + c), "id"), "id"))["id"]
    sizes = groups.groupBy("hub").agg(F.array_distinct(F.array(*(pick(c) for c in range(CENTRES)))).alias("centres"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("n"))
    sizes = scratch.save(sizes)
    rows = groups.join(sizes.select("hub", "n"), "hub").withColumns({"i": F.pmod(F.xxhash64("id"), "n"), "out": F.lit(True)})
    centres = groups.join(sizes.select("hub", "n", F.explode("centres").alias("id")), ["hub", "id"])
    centres = centres.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)), "out": F.lit(False)})
    links = _compared(rows, centres, ("hub", "i"), told, scratch)
    scratch.drop(sizes)
    return links


def _rest(groups: DataFrame, told: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between members of one hub's group(hub, id, own, out) in different components, of which one at least is out, in blocks of members."""
    left, right = _dealt(groups, "hub")
    return _compared(left, right, ("hub", "i", "j"), told, scratch)


def line_components(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, at, component) for every line that is not blank: a saved table. Lines of one component are equal or linked by a chain of similar lines."""
    lines = _lines(docs, id_col, text_col)
    distinct = lines.groupBy("k1", "k2").agg(F.any_value("line").alias("line"))
    # Both sides are the same rows, so the lines are shuffled once; of a partition's signatures a hash table is made.
    signed = distinct.join(_signatures(distinct).hint("shuffle_hash"), ["k1", "k2"])
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"v{v}" for v in values)) for b, values in enumerate(BANDS)))
    known = scratch.save(signed.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "line", *_sketch(), keys.alias("keys")))

    shared = scratch.save(_shared(known))
    # Only these lines are read again, once for all. Merged at every size: they grow with the documents, so a broadcast would not hold.
    ends = shared.select("id").union(shared.select("hub")).distinct()
    met = scratch.save(known.select("id", "line", *SKETCH).join(ends.hint("merge"), "id", "left_semi"))
    stars = _stars(shared.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), met, scratch)
    parts = connected_components(stars, scratch)

    def joined(links: DataFrame) -> DataFrame:
        """The components with further links between them, of which few are left: only those components are put together, not all lines again."""
        tops = connected_components(links, scratch)
        up = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = parts.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        out = scratch.save(moved.unionByName(tops.join(parts.select("node"), "node", "left_anti")))  # with lines that had no link before
        scratch.drop(links, parts, tops)
        return out

    # Two rays of a star may be similar though the hub is like neither: where a band's rays are still in several components, they are compared.
    opened = scratch.save(_open_bands(shared, parts))
    rays = scratch.save(_with_partners(opened, met))
    scratch.drop(shared, opened)
    groups = scratch.save(open_groups(rays, parts))
    # Components only grow, so later groups have no other lines than these, and their maps are made once.
    maps = _maps(groups.select("id"), met, scratch)
    told = scratch.save(met.join(maps, "id"))
    scratch.drop(met, maps)
    for k in range(ROUNDS):  # joins most of what is apart
        if groups.isEmpty():
            break
        parts = joined(_centred(groups, told, k, scratch))
        scratch.drop(groups)
        groups = scratch.save(open_groups(rays, parts))
    if not groups.isEmpty():
        parts = joined(_rest(groups, told, scratch))
    scratch.drop(rays, groups, told, stars)
    # Distinct lines get their components before lines of documents meet them, so that only the former are shuffled by id.
    told = with_parts(known.select("k1", "k2", "id"), parts).select("k1", "k2", "component")
    placed = scratch.save(lines.select("doc", "at", "k1", "k2").join(told, ["k1", "k2"]).select("doc", "at", "component"))
    scratch.drop(known, parts)
    return placed


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, line, k1, k2) of the lines that are not blank; line is trimmed of spaces, tabs and carriage returns, k1 and k2 are 128 bits of
    its hash."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_of(text_col), "\n")).alias("at", "raw"))
    lines = rows.select("doc", "at", F.btrim("raw", F.lit(" \t\r")).alias("line")).where("line <> ''")
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the lines removed from its texts that are copies or near-copies of a line that stays, and with
    n_lines and n_dropped (long), which replace columns of these names.

    Lines end at a line feed. Lines whose trimmed texts are equal, or linked by a chain of pairs with a Jaccard similarity of 0.8 or more
    over character shingles, form a class; the line with the smallest (id, line number) stays. Blank lines are never copies.
    Null texts count as empty, and rows stay even when no line does. Repeated rows with one id are one document: their lines stand at the
    same places, so all of them keep a line that stays. Null ids are one document, the first. Texts and lines of any length are read whole. Other
    columns may have any names and keep their values; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    placed = line_components(docs, id_col, text_col, scratch)
    firsts = scratch.save(placed.groupBy("component").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("at") == F.col("first.at"))
    gone = placed.join(firsts, "component").where(~same).groupBy("doc").agg(F.collect_set("at").alias("ats"))
    doc, ats = fresh(docs, "doc", "ats")
    drops = scratch.save(gone.select(F.col("doc").alias(doc), F.col("ats").alias(ats)))
    scratch.drop(placed, firsts)
    # Merged at every size: what is dropped grows with the documents, so a broadcast on small tables would not hold on large ones.
    rows = docs.join(drops.hint("merge"), docs[id_col].eqNullSafe(drops[doc]), "left")
    lines = F.split(text_of(text_col), "\n")
    left = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(ats))  # noqa: E731  by a hash set, in order
    kept = let(lines, lambda all_: F.array_join(F.transform(left(all_), lambda i: F.get(all_, i)), "\n"))
    counts = {
        "n_lines": F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r")) != "")).cast("long"),
        "n_dropped": F.coalesce(F.size(ats), F.lit(0)).cast("long"),
    }
    text = F.when(F.col(ats).isNull(), text_of(text_col)).otherwise(kept).alias(text_col)
    return rows.select(*(text if c == text_col else docs[c] for c in docs.columns if c not in counts), *(v.alias(c) for c, v in counts.items()))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of lines and of dropped ones, and the length and SHA-256 of the text that is left."""
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("left_sha256"))
