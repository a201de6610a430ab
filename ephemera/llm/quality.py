"""Operator 2, quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, text_of
from .shingles import word_hashes
from .toxicity import fit_logistic, held_out

#: The document classifier is fitted on at most so many labelled rows, those whose ids have the least hashes.
TRAIN_ROWS = 20_000
#: Documents whose combined probability of good quality is at least this are kept.
KEEP = 0.5
#: Buckets of hashed runs of three bytes, and the share of a class that every bucket has beforehand.
GRAMS, PRIOR = 1 << 12, 1e-5
#: A document's evidence: the mean log-odds of its byte runs, words that repeat the one before, distinct words for their number, and length.
FEATURES = ("grams", "echo", "variety", "length")
#: Bytes of a text that are hashed at a time, and rows that a Python worker is sent at a time.
BLOCK, BATCH = 1 << 22, 1000
LOGIT_BOUND = 12.0


def _profile(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among all runs of three bytes."""
    out = np.zeros(GRAMS)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        part = data[at : at + BLOCK + 2].astype(np.uint32)
        run = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        out += np.bincount((run * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=GRAMS)
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def features(text: str | None, weights: np.ndarray) -> tuple[float, float, float, float]:
    """The FEATURES of a whole text; null and empty texts have zeros, and variety 1."""
    data = _bytes(text)
    profile = _profile(data)
    total = profile.sum()
    words, _ = word_hashes(data, np.zeros(1, np.int64))
    n = len(words)
    if not n:
        return (float(profile @ weights / total) if total else 0.0), 0.0, 1.0, 0.0
    echo = float(np.count_nonzero(words[1:] == words[:-1])) / n
    return (float(profile @ weights / total) if total else 0.0), echo, len(np.unique(words)) / n**0.75, float(np.log1p(n))


@dataclass
class DocumentModel:
    """Log-odds of the buckets of byte runs, and a logistic regression on standardised FEATURES. By default everything is good."""

    bias: float = 6.0
    grams: np.ndarray = field(default_factory=lambda: np.zeros(GRAMS))
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    mean: tuple[float, ...] = (0.0,) * len(FEATURES)
    scale: tuple[float, ...] = (1.0,) * len(FEATURES)

    def logit(self, text: str | None) -> float:
        x = (np.array(features(text, self.grams)) - self.mean) / self.scale
        return float(np.clip(self.bias + x @ self.weights, -LOGIT_BOUND, LOGIT_BOUND))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the profiles of good and bad texts, each text with weight one, of one batch after another."""
    for batch in batches:
        sums = np.zeros((2, GRAMS))
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            profile = _profile(_bytes(text))
            sums[int(good)] += profile / max(profile.sum(), 1.0)
        some = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[1, some]), pa.array(sums[0, some])], ["bucket", "good", "bad"])


def _featured(batches: Iterator[pa.RecordBatch], grams: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([features(t, grams) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), batch.column(1)], [*FEATURES, "good"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DocumentModel:
    """The document classifier, fitted on at most `rows` labelled rows that are not held out (label 1 is good).

    Rows whose crc32(id) mod 5 is 0 are held out, for measuring. Byte runs are counted in Spark, and GRAMS sums and the features of at
    most `rows` rows reach the driver. A label that stands twice, or for two documents, counts twice; null ids and labels count nothing. Without labels of both kinds
    everything is good. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(rows)
    known = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # At most `rows` ids and labels are broadcast.
    train = scratch.save(known.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id", "text").limit(rows).select("text", "good").repartition(12))
    size = {r["good"]: r["count"] for r in train.groupBy("good").count().collect()}
    if len(size) < 2:
        return DocumentModel()
    sums = np.zeros((2, GRAMS))
    counted = scratch.save(train.mapInArrow(_profiles, "bucket int, good double, bad double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), batch=BATCH)
    for r in counted.collect():
        sums[:, r["bucket"]] = r["good"] / size[True], r["bad"] / size[False]
    grams = np.log((sums[0] + PRIOR) / (sums[1] + PRIOR))
    found = scratch.save(train.mapInArrow(partial(_featured, grams=grams), ", ".join(f"{f} double" for f in FEATURES) + ", good boolean"), batch=BATCH).toPandas()
    scratch.drop(train)
    x = found[list(FEATURES)].to_numpy(float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    beta = fit_logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), found["good"].to_numpy(float), ridge=0.1)
    return DocumentModel(float(beta[0]), grams, tuple(map(float, beta[1:])), tuple(map(float, mean)), tuple(map(float, scale)))


def document_logit(text: Column, model: DocumentModel) -> Column:
    """The document classifier's log-odds of good quality, from the whole text."""

    @F.pandas_udf("double")
    def logits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.logit(t) for t in batch], dtype=float)

    return logits(text)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: groups whose means differ little are shrunk much. groups: n, s (sum of evidence) and s2 (of squares); mean: their prior mean."""
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))
    sums = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.pow("n", 2)).alias("n2"), between.alias("between"), F.sum(F.col("s2") - F.pow("s", 2) / F.col("n")).alias("inside"), F.sum("s").alias("s")).first()
    if not sums["n"] or sums["k"] < 2:
        return 10.0
    mu = min(max(sums["s"] / sums["n"], 1e-4), 1 - 1e-4)
    spread = max(sums["inside"], 1e-9) / max(sums["n"] - sums["k"], 1)
    effective = (sums["n"] - sums["n2"] / sums["n"]) / (sums["k"] - 1)
    variance = max((sums["between"] / (sums["k"] - 1) - spread) / max(effective, 1.0), 1e-6)
    return min(max(mu * (1 - mu) / variance - 1, 1.0), 1e4)


def combine(docs: DataFrame, logit_col: str, host: Column, path: Column) -> DataFrame:
    """All columns of docs, a saved table, with doc_score, host_posterior, path_posterior and score, given each row's log-odds; see score()."""
    scratch = Scratch(docs.sparkSession)
    h, w, logit, p, pn, ps, hn, hs = fresh(docs, "h", "w", "logit", "p", "pn", "ps", "hn", "hs")
    told = docs.withColumns({h: F.coalesce(host.cast("string"), F.lit("")), w: F.coalesce(path.cast("string"), F.lit("")), logit: F.col(logit_col), p: _sigmoid(F.col(logit_col))})
    paths = scratch.save(told.groupBy(F.col(h).alias("h"), F.col(w).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("s2")))
    hosts = scratch.save(paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = (total["s"] / total["n"]) if total["n"] else 0.5
    of_host = _strength(hosts, F.lit(mu))
    inside = paths.join(hosts.select("h", (F.col("s") / F.col("n")).alias("host_mean")), "h")
    of_path = _strength(inside, F.col("host_mean"))
    site = hosts.select("h", F.col("n").alias(hn), F.col("s").alias(hs))
    stats = scratch.save(paths.select("h", "w", F.col("n").alias(pn), F.col("s").alias(ps)).join(site, "h").select(F.col("h").alias(h), F.col("w").alias(w), pn, ps, hn, hs))
    scratch.drop(paths, hosts)
    # A few numbers a path: Spark broadcasts them where their size on disk is below its threshold, and shuffles otherwise.
    joined = told.join(stats, [h, w])
    host_post = (F.col(hs) - F.col(p) + of_host * mu) / (F.col(hn) - 1 + of_host)
    path_post = (F.col(ps) - F.col(p) + of_path * host_post) / (F.col(pn) - 1 + of_path)
    added = {"doc_score": F.col(p), "host_posterior": host_post, "path_posterior": path_post, "score": _sigmoid(F.col(logit) + _logit(path_post) - _logit(F.lit(mu)))}
    return joined.select(*(c for c in docs.columns if c not in added), *(v.alias(c) for c, v in added.items()))


def score(docs: DataFrame, model: DocumentModel, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """All columns of docs with doc_score, host_posterior, path_posterior and score (double, 0 to 1: good quality), which replace columns of these names.

    The document classifier's probabilities are summed by host and by path within host. A host's posterior shrinks its mean towards the global
    one, a path's posterior its mean towards its host's, each with a strength estimated from how much the groups differ; a document's own share is left
    out of both. The score adds the path's log-odds over the global ones to the document's. Hosts and paths that are null are a group of
    their own, with those that are empty. Null texts count as empty, texts of any length are read whole. Every row is scored, repeated rows too, and
    equal rows equally. Other columns may have any names and keep their values; an empty table gives an empty result.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    (logit,) = fresh(docs, "doc_logit")
    told = Scratch(docs.sparkSession).save(docs.withColumn(logit, document_logit(text_of(text_col), model)), batch=BATCH)
    return combine(told, logit, host, path).drop(logit)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents name no web address: their source stands for the host and their lang for the path below it."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "lang", "source"), model).select("doc_id", "source", "lang", "doc_score", "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP).alias("kept"))
