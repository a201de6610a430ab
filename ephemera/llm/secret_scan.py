"""Operator 5, secret scans: an incremental ledger of content-addressed blobs and the rule versions they were scanned with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, sums_before, table, text_of

#: Marks put around matches while a text is scanned. Where a text holds them itself, SUB stands for them meanwhile; no rule matches any of these.
BEGIN, GROUP, END, SUB = "\u0001", "\u0002", "\u0003", "\u001a"
SPANS = "array<struct<start:int,end:int>>"
SCANS = f"array<struct<version:string,spans:{SPANS}>>"
LEDGER, HISTORY = f"blob string, scans {SCANS}", "path string, blob string"
#: At most so many digests of blobs that are due (some megabytes) are broadcast, so that the texts of other blobs are not shuffled.
BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """One kind of secret. head and tail: a match is head followed by tail (Java regex, without capturing groups);
    a match whose tail is shorter than least code points is dropped, after matching. guard: a cheaper regex that every kept match
    contains. Groups repeat a bounded number of times, as the engine recurses for each; only single characters repeat without bound. Changing anything needs a new revision, so that blobs are scanned again."""

    kind: str
    head: str
    tail: str
    least: int
    guard: str
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}@{self.revision}"


#: The first three are the base rules (fixed values).
RULES = (
    Rule("assign", r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)", r"[A-Za-z0-9+/_.=-]+", 6, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN ", r"(?:[A-Z]+ ){0,4}PRIVATE KEY-----", 16, r"PRIVATE KEY-----", 2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,}\.", r"[A-Za-z0-9_-]+", 16, r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ", 2),
    Rule("forge", r"gh[opsu]_", r"[A-Za-z0-9]+", 36, r"gh[opsu]_[A-Za-z0-9]{36}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule as code-point spans, end exclusive.

    Every match gets marks around it in one pass of the regex engine; spans follow from the lengths of the pieces between marks.
    """
    plain = F.translate(text, BEGIN + GROUP + END, SUB * 3)
    pattern = f"({rule.head})({rule.tail})" if rule.head else f"()({rule.tail})"
    if not rule.head:  # short runs are dropped anyway, and a run is always matched whole
        pattern = f"()({rule.tail[:-1]}{{{rule.least},}})"

    def found(pieces: Column) -> Column:
        """Of the first piece, before any match, and the others, each a match with its marks and what follows."""
        size = lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(2)  # noqa: E731  without marks
        span = lambda p, at: F.struct(at.cast("int").alias("start"), (at + F.instr(p, END) - 2).cast("int").alias("end"))
        spans = F.zip_with(pieces, sums_before(F.transform(pieces, size)), lambda p, at: F.when(F.instr(p, END) - F.instr(p, GROUP) - 1 >= rule.least, span(p, at)))
        return F.filter(spans, lambda x: x.isNotNull())

    found = let(F.split(F.regexp_replace(plain, pattern, f"{BEGIN}$1{GROUP}$2{END}"), BEGIN), found)
    return F.when(text.rlike(rule.guard), found).otherwise(F.array().cast(SPANS))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that docs add to the ledger: (blob, scans array<struct<version, spans>>), for pairs of blob and rule version that it lacks.

    A blob is a text, addressed by its SHA-256; null counts as empty. Digests are held against the ledger first; only texts with a version due are
    scanned, each once however many rows have it. Rows of a ledger are never rewritten: a blob has a row for every time that it was scanned.
    Other columns are ignored; an empty table adds nothing.
    """
    scratch, none = Scratch(docs.sparkSession), F.array().cast(SCANS)
    versions = F.array(*(F.lit(r.version) for r in rules))
    rows = docs.select(text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    if ledger is None:
        due = rows.dropDuplicates(["blob"]).withColumn("due", versions)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("scans", lambda s: s["version"])))).alias("seen"))
        told = rows.select("blob").distinct().join(seen, "blob", "left")
        missing = scratch.save(told.select("blob", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")).where("size(due) > 0"))
        if missing.count() <= BROADCAST_BLOBS:
            rows = rows.join(F.broadcast(missing.select("blob")), "blob", "left_semi")
        due = rows.dropDuplicates(["blob"]).join(missing, "blob")
    scans = (F.when(F.array_contains("due", r.version), F.array(F.struct(F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))).otherwise(none) for r in rules)
    return due.select("blob", F.concat(*scans).alias("scans"))


class Ledger:
    """A stored ledger below a folder that all executors share: rows of scans and the history of paths, both only ever added to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._scans, self._history = spark, f"{root}/scans", f"{root}/history"
        for path, schema in ((self._scans, LEDGER), (self._history, HISTORY)):  # a folder can be read once it holds a file
            self._append(spark.createDataFrame([], schema), path)

    def _append(self, rows: DataFrame, path: str) -> None:
        Scratch(self.spark).write(rows, path, "append")

    def scans(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self._scans)

    def history(self) -> DataFrame:
        """(path, blob): every version that any path ever had."""
        return self.spark.read.schema(HISTORY).parquet(self._history)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what is new in docs, whose ids are the paths. A write that was cut short may be repeated: only what lacks is added."""
        self._append(scan_new(docs, self.scans(), text_col, rules), self._scans)
        here = docs.select(F.col(id_col).cast("string").alias("path"), F.sha2(text_of(text_col), 256).alias("blob")).distinct()
        known = self.history()
        same = here["path"].eqNullSafe(known["path"]) & (here["blob"] == known["blob"])
        self._append(here.join(known, same, "left_anti"), self._history)


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, found array<struct<start, rank, end, kind>>) for every row of docs, from the ledger, sorted by start and then the rules' order.

    Repeated rows each get their findings; blobs without a scan of a rule's version have none of it. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("blob"))
    return _found(rows, ledger, rules).select(F.col("id").alias(id_col), "found")


def history_findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) for every version that a path ever had: a secret stays known when a later version drops it."""
    return _found(history, ledger, rules).select("path", "blob", "found")


def _found(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    def of_rule(rank: int, rule: Rule) -> Column:
        # Scans of one blob and version agree, should a repeated write have left two.
        scans = F.slice(F.filter("scans", lambda s: s["version"] == rule.version), 1, 1)
        told = lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(rule.kind).alias("kind"))
        return F.flatten(F.transform(scans, lambda s: F.transform(s["spans"], told)))

    # Few blobs hold a secret; only their findings are joined, and grouped first, so that rows of a frequent blob can be split while they are joined.
    hits = ledger.where(F.exists("scans", lambda s: F.size(s["spans"]) > 0))
    blobs = Scratch(ledger.sparkSession).save(hits.groupBy("blob").agg(F.flatten(F.collect_list("scans")).alias("scans")))
    by_rule = F.flatten(F.array(*(of_rule(i, r) for i, r in enumerate(rules))))
    return rows.join(blobs, "blob", "left").withColumn("found", F.array_sort(F.coalesce(by_rule, F.array())))


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is made in two increments: the base rules first, then all, which scans blobs with the added rules only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, Scratch(spark).root)
    ledger.add(docs, rules=RULES[:3])
    ledger.add(docs)
    told = findings(docs, ledger.scans())
    count = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < 3)
    return told.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def _spans_sql(rank: int, rule: Rule) -> str:
    """One rule's spans by the same marks, for another engine."""
    pattern = f"({rule.head})({rule.tail})" if rule.head else f"()({rule.tail[:-1]}{{{rule.least},}})"
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, ahead AS start, ahead + instr(piece, chr(3)) - 2 AS stop FROM (
  SELECT *, coalesce(sum(length(piece) - CASE WHEN i = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(plain, '{quoted}', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS pieces FROM d)))
WHERE i > 1 AND instr(piece, chr(3)) - instr(piece, chr(2)) - 1 >= {rule.least}"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), repeat(chr(26), 3)) AS plain FROM documents),
found AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))})
SELECT d.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN found ON found.doc_id = d.doc_id GROUP BY d.doc_id
"""
