"""Principal moon phases: a daily scan for crossings, refined by bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, lunar
from ..functions.steps import chain, nested
from ..sources import dimensions, spines
from ..sources.spines import DAY_MS, Window

HALVINGS = 30


def with_phase(df: DataFrame, ms: str, out: str = "phase") -> DataFrame:
    """Adds the moon's phase at the instants in column ms. Stateless, so it serves streams as well."""
    return chain(df, lunar.STEPS, {"ms": F.col(ms)}, {"phase": out}, prefix=f"_{out}_")


def daily_phases(spark: SparkSession, window: Window, overlap: bool = True) -> DataFrame:
    """(chunk, ms, phase) of the daily samples, the window's end included. overlap: inner samples at a chunk's edge stand in both of its chunks."""
    rows = spines.samples(spark, window)
    if not overlap:
        rows = rows.where((F.col("chunk") == 0) | (F.col("ms") > window.start_ms + F.col("chunk") * spines.CHUNK * DAY_MS))
    return with_phase(rows, "ms")


def crossings(daily: DataFrame) -> DataFrame:
    """(idx, name, low_ms, high_ms): one row for each phase crossed between a sample and the one a day before; a day may give several."""
    before = F.lag("phase").over(W.partitionBy("chunk").orderBy("ms"))
    rows = daily.withColumn("before", before).where("before is not null")
    now, was = F.col("phase"), F.col("before")

    def crossed(idx: int, name: str, at: float) -> Column:
        hit = (was > 0.875) & (now < 0.125) if at == 0 else (was < at) & (now >= at)  # new moon: from nearly 1 to nearly 0
        return F.when(hit, F.struct(F.lit(idx).alias("idx"), F.lit(name).alias("name")))

    found = F.filter(F.array(*(crossed(*p) for p in dimensions.PHASES)), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("x"), "ms").select("x.idx", "x.name", (F.col("ms") - DAY_MS).alias("low_ms"), F.col("ms").alias("high_ms"))


def refine(brackets: DataFrame) -> DataFrame:
    """Adds event_ms: HALVINGS halvings of [low_ms, high_ms], truncated to milliseconds.

    The midpoint is truncated before the phase is taken, the ends are not. A row's work is one higher-order aggregate, so a table of brackets of any
    length is refined in parallel.
    """

    def halve(ends: Column, _: Column) -> Column:
        mid = (ends["low"] + ends["high"]) / 2

        def move(phase: Column) -> Column:
            early = F.when(F.col("idx") == 3, phase > 0.5)
            for idx, _, at in dimensions.PHASES[:3]:
                early = early.when(F.col("idx") == idx, phase < at)
            return F.when(early, F.struct(mid.alias("low"), ends["high"].alias("high"))).otherwise(F.struct(ends["low"].alias("low"), mid.alias("high")))

        return nested(lunar.STEPS, {"ms": mid.cast("bigint")}, "phase", move)

    ends = F.struct(F.col("low_ms").cast("double").alias("low"), F.col("high_ms").cast("double").alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve, lambda e: ((e["low"] + e["high"]) / 2).cast("bigint"))
    return brackets.withColumn("event_ms", found)


def moon_events(spark: SparkSession, window: Window, domain: str = labels.DOMAIN) -> DataFrame:
    """(event_ms, name, uid) of all phases in the window."""
    rows = refine(crossings(daily_phases(spark, window)))
    return rows.select("event_ms", "name", labels.moon_uid(F.col("name"), F.col("event_ms"), domain).alias("uid"))
