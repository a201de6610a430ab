"""Operator 4, document fingerprints: threshold-scaled sketches of word shingles, mergeable, for likeness and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, fresh, table, text_of

WIDTH = 5
#: Every shingle hash below this share of the 64-bit range is retained.
FRACTION = 1 / 8
THRESHOLD = -(1 << 63) + int((1 << 64) * FRACTION)
#: A sketch with fewer hashes below the threshold also holds the next larger ones up to this number, so that short documents are
#: not empty. `bound` tells up to where a sketch is complete.
LEAST = 64
HIGHEST = (1 << 63) - 1
SKETCH = "struct<hashes:array<bigint>,bound:bigint>"


def _words(text: Column) -> Column:
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), " "), "")


def with_sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the sketch of a text: struct<hashes, bound>, hashes ascending.

    Shingles are WIDTH lower-cased words in a row, or all words if there are fewer; null and empty texts have none. The hashes at or
    below bound are all those that the text has there; for a text with LEAST shingles or fewer bound is the highest number. Texts of any length
    are read whole. Every row gets its sketch, repeated rows the same; a column called like `out` is replaced, others keep their values.
    """
    w, h, low, every = fresh(df.select("*", F.lit(0).alias(out)), "w", "h", "low", "every")
    words = df.withColumn(w, F.transform(_words(text_of(text_col)), lambda word: F.xxhash64(word)))
    n = F.size(w)
    short = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    all_ = F.when(n < WIDTH, short).otherwise(F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH)))))
    hashed = words.withColumn(h, all_).withColumn(low, F.array_sort(F.array_distinct(F.filter(h, lambda x: x < THRESHOLD))))
    few = F.size(low) < LEAST
    padded = hashed.withColumn(every, F.when(few, F.array_sort(F.array_distinct(h))))
    kept = F.when(few, F.slice(every, 1, LEAST)).otherwise(F.col(low))
    bound = F.when(~few, F.lit(THRESHOLD - 1)).when(F.size(every) <= LEAST, F.lit(HIGHEST)).otherwise(F.greatest(F.lit(THRESHOLD - 1), F.element_at(every, LEAST)))
    return padded.withColumn(out, F.struct(kept.alias("hashes"), bound.alias("bound"))).drop(w, h, low, every)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sizes of both sketches and of their intersection, up to where both are complete."""
    bound = F.least(a["bound"], b["bound"])
    left, right = (F.filter(x["hashes"], lambda h: h <= bound) for x in (a, b))
    return F.size(left), F.size(right), F.size(F.array_intersect(left, right))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents, 0 to 1; 1 for two documents without shingles."""
    na, nb, both = _common(a, b)
    return F.when(na + nb == 0, F.lit(1.0)).otherwise(both / (na + nb - both)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 where a has none. It holds for very unequal documents too."""
    na, _, both = _common(a, b)
    return F.when(na == 0, F.lit(1.0)).otherwise(both / na).cast("double")


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    bound = F.least(a["bound"], b["bound"])
    hashes = F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda h: h <= bound)
    return F.struct(hashes.alias("hashes"), bound.alias("bound"))


def sketch_text(sketch: Column) -> Column:
    """A sketch as text: bound and hashes, 16 hexadecimal digits each."""
    return F.concat(F.lpad(F.hex(sketch["bound"]), 16, "0"), F.lit(":"), F.array_join(F.transform(sketch["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))


# --- each document beside its successor ---------------------------------------------------------------------

#: Rows of a bucket of neighbouring ids, and the most buckets; beyond that, buckets grow.
BUCKET_ROWS, BUCKETS = 1000, 20_000


def _bucket(firsts: list[int], value: Column) -> Column:
    """The index of the last of the ascending numbers that is not above value, by binary search in a constant array; 0 below the first."""
    known = F.array(*map(F.lit, firsts))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(firsts).bit_length())))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        fits = F.get(known, mid) <= value
        return F.struct(F.when(fits, mid).otherwise(at["low"]).alias("low"), F.when(fits, at["high"]).otherwise(F.greatest(at["low"], mid - 1)).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(firsts) - 1).alias("high")), halve, lambda at: at["low"])


def with_next(docs: DataFrame, order_col: str, columns: list[str], tie_col: str) -> DataFrame:
    """Adds next_<column> of the following row by order_col (after the last: the first), ties by tie_col.

    Rows go to buckets of neighbouring numbers. The first row of a bucket is also sent to the bucket before, as a sentinel, so a window over each
    bucket finds every successor and one shuffle is all. Null numbers sort first. Rows with one number follow each other by tie_col, equal rows in any
    order; they share a bucket. Columns called next_<column> are replaced, others keep their values; an empty table gives an empty result.
    """
    following = {f"next_{c}": c for c in columns}
    docs = docs.drop(*following)
    at, own, to, bucket, sent = fresh(docs.select("*", *(F.lit(0).alias(c) for c in following)), "at", "own", "to", "bucket", "sent")
    place = F.coalesce(F.col(order_col), F.lit(-(1 << 63)))
    ids = docs.select(place.alias("at"))
    n = ids.count()
    if not n:
        return docs.select("*", *(F.col(c).alias(name) for name, c in following.items()))
    parts = min(BUCKETS, -(-n // BUCKET_ROWS))
    cuts = ids.agg(F.percentile_approx("at", [k / parts for k in range(parts)], 10 * parts + 1000)).first()[0]
    firsts = sorted(r["f"] for r in ids.groupBy(_bucket(sorted(set(cuts)), F.col("at")).alias("b")).agg(F.min("at").alias("f")).collect())
    rows = docs.withColumn(at, place).withColumn(own, _bucket(firsts, F.col(at)))
    first = F.get(F.array(*map(F.lit, firsts)), F.col(own)) == F.col(at)
    before = F.when(F.col(own) > 0, F.struct((F.col(own) - 1).alias("bucket"), F.lit(1).alias("sent"))).otherwise(F.struct(F.lit(len(firsts) - 1).alias("bucket"), F.lit(2).alias("sent")))
    here = F.struct(F.col(own).alias("bucket"), F.lit(0).alias("sent"))
    doubled = rows.withColumn(to, F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))))
    dealt = doubled.select(*docs.columns, at, F.col(to)["bucket"].alias(bucket), F.col(to)["sent"].alias(sent))
    # Within a bucket its own rows come first, then the sentinels of the next bucket, or after the last one those of the first.
    w = Window.partitionBy(bucket).orderBy(sent, at, tie_col)
    return dealt.select(*docs.columns, sent, *(F.lead(c).over(w).alias(name) for name, c in following.items())).where(F.col(sent) == 0).drop(sent)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    paired = with_next(with_sketch(docs, "text", "sketch"), "doc_id", ["text", "sketch"], "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    both = with_sketch(paired.withColumn("edited", edited), "edited", "edited_sketch")
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
