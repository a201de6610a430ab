"""Operator 6, toxicity: a weighted lexicon with exception phrases, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_of

#: The lexicon is learned from at most so many labelled rows, those whose ids have the least hashes.
TRAIN_ROWS = 6000
#: Terms are word beginnings of SHORTEST to LONGEST letters and whole words, seen in at least LEAST_DOCS toxic training rows, where at
#: least PRECISE of all training rows with the term are toxic and the log-likelihood gain over the base rate is at least GAIN, so
#: that among the very many beginnings hardly one passes by chance. Exception phrases stand in LEAST_DOCS clean training rows, and at least PRECISE of
#: all training rows with the phrase are clean.
SHORTEST, LONGEST, LEAST_DOCS, PRECISE, GAIN = 4, 12, 4, 0.7, 12.0
#: Rows that a Python worker is sent at a time.
BATCH = 1000

#: Characters of other scripts that look like Latin letters, and digits and signs used in their place.
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһкмтвнгαεικνορτυχ", "aceopxyijsdhkmtbhraeiknoptux", strict=True))
SUBSTITUTES = dict(zip("013457@$", "oieastas", strict=True))
_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
_FOLD |= {ord(c): " " for c in "\t\n\x0b\x0c\r.,;:!?()[]{}<>\"'`*_-/\\|=+~%&#^«»„“”‚‘’…–—"}
#: Zero-width characters that are put inside words to hide them.
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, punctuation as spaces, one space around every word."""
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def terms_of(folded: str) -> set[str]:
    """A text's words (" word ") and word beginnings (" beg")."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


@dataclass
class Lexicon:
    """weights of terms; exceptions, phrases of one to three words that hold a term but are harmless; and the score's logistic coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    slope: tuple[float, float] = (1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        spares = set(self.exceptions)
        for term in {*self.weights, *spares}:
            found.add_word(term, (len(term), self.weights.get(term, 0.0), term in spares))
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the terms that count: of those that begin at one place the longest, and none inside an exception phrase."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for last, (n, weight, spares) in automaton.iter(folded):
            at = last - n + 1
            if spares:
                spared.append((at, at + n))
            elif n > best.get(at, (0, 0.0))[0]:
                best[at] = (n, weight)
    # A match is spared if, of the phrases that begin at it or before, the one that reaches furthest ends at it or behind.
    spared.sort()
    begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))

    def kept(at: int, end: int) -> bool:
        k = bisect_right(begins, at)
        return not k or reach[k - 1] < end

    return [(at, at + n, w) for at, (n, w) in best.items() if kept(at, at + n)]


def features(folded: str, automaton) -> tuple[float, float]:
    """log(1 + weight of all matches), and the same per 100 words."""
    total = sum(w for _, _, w in matches(folded, automaton))
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def phrases_of(folded: str, automaton) -> set[str]:
    """The phrases of one to three words around each match: its words, with the word before, the word after, and both."""
    out = set()
    for at, end, _ in matches(folded, automaton):
        stop = folded.index(" ", end - 1) + 1  # a term begins with a space, and may end within a word
        before = folded.rfind(" ", 0, at) if at else -1
        after = folded.find(" ", stop) + 1
        for a in {at, before} - {-1}:
            for b in {stop, after} - {0}:
                out.add(folded[a:b])
    return out


def _counted(batches: Iterator[pa.RecordBatch], lexicon: Lexicon | None = None) -> Iterator[pa.RecordBatch]:
    """Documents with each term, toxic and not, summed within a batch before anything is shuffled. With a lexicon, with each phrase around its terms."""
    automaton = lexicon.automaton() if lexicon else None
    for batch in batches:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(phrases_of(fold(text), automaton) if lexicon else terms_of(fold(text)))
        terms = list({*toxic, *clean})
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Learns terms, weights, exception phrases and the score's coefficients from labelled rows that are not held out.

    Terms, and the phrases around them, are counted in Spark; only those frequent enough, and the features of at most `rows` rows, reach the driver.
    A label that stands twice, or for two documents, counts twice; null ids and labels count nothing, other columns are ignored. Without toxic rows the lexicon is empty.
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, F.col(label_col).alias("label"))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    # At most `rows` ids and labels are broadcast.
    train = scratch.save(docs.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(sample), id_col).orderBy(F.xxhash64(id_col), id_col, "text").limit(rows).select("text", (F.col("label") == 1).alias("label")).repartition(12))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        return Lexicon()

    def count(lexicon: Lexicon | None = None) -> DataFrame:
        summed = train.mapInArrow(partial(_counted, lexicon=lexicon), "term string, toxic long, clean long").groupBy("term")
        return summed.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    told = scratch.save(count().where((F.col("toxic") >= LEAST_DOCS) & (rate >= PRECISE)), batch=BATCH)
    # Every toxic row lends its terms at most once each, so these are few: at most the terms shared by LEAST_DOCS of at most `rows` rows.
    seen = {r["term"]: (r["toxic"], r["clean"]) for r in told.collect()}
    base = n_toxic / (n_toxic + n_clean)

    def gain(toxic: int, clean: int) -> float:
        p = toxic / (toxic + clean)
        return toxic * math.log(p / base) + (clean * math.log((1 - p) / (1 - base)) if clean else 0.0)

    weights: dict[str, float] = {}
    chosen: set[str] = set()  # and all their beginnings
    for term in sorted((t for t in seen if gain(*seen[t]) >= GAIN), key=lambda t: (-gain(*seen[t]), len(t), t)):
        # Of nested beginnings the most telling one stands for all.
        if term not in chosen and not any(term[:k] in weights for k in range(SHORTEST + 1, len(term))):
            a, b = seen[term]
            weights[term] = math.log(((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1)))
            chosen |= {term[:k] for k in range(SHORTEST + 1, len(term) + 1)}
    weights = {t: w for t, w in weights.items() if w > 0}
    lexicon = Lexicon(weights)
    if weights:
        harmless = count(lexicon).where((F.col("clean") >= LEAST_DOCS) & (rate <= 1 - PRECISE))
        lexicon.exceptions = sorted(r["term"] for r in scratch.save(harmless, batch=BATCH).collect())
    found = train.mapInArrow(partial(_features, lexicon=lexicon), "x1 double, x2 double, label boolean").toPandas()
    x = np.column_stack([np.ones(len(found)), found["x1"], found["x2"]])
    beta = fit_logistic(x, found["label"].to_numpy(float))
    lexicon.bias, lexicon.slope = float(beta[0]), (float(beta[1]), float(beta[2]))
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        told = [features(fold(t), automaton) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in told], pa.float64()), pa.array([b for _, b in told], pa.float64()), batch.column(1)], ["x1", "x2", "label"])


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        scores = []
        for text in batch.column(1):
            a, b = features(fold(text.as_py()), automaton)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.bias + lexicon.slope[0] * a + lexicon.slope[1] * b)))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: 0 to 1, from the whole text alone.

    Null texts count as empty, which have the score of a text without any term; texts of any length are read whole. Repeated rows are scored each, equal
    texts equally. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_scored, lexicon=lexicon), "id long, score double").withColumnRenamed("id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
