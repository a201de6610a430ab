"""Equinoxes, solstices and the cross-quarter days half way between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, seasonal
from ..sources import dimensions, spines
from ..sources.spines import Window


def _jde(spark: SparkSession, first: int, last: int) -> DataFrame:
    grid = spines.years(spark, first, last).crossJoin(F.broadcast(dimensions.seasons(spark)))  # four rows
    return grid.withColumn("jde", seasonal.season_jde(F.col("year"), *(F.col(c) for c in "abcde"))).select("year", "idx", "name", "jde")


def season_events(spark: SparkSession, first: int, last: int, domain: str = labels.DOMAIN) -> DataFrame:
    """(year, idx, jde, event_ms, name, uid) of the years first..last."""
    rows = _jde(spark, first, last)
    return rows.select("year", "idx", "jde", seasonal.jde_ms(F.col("jde")).alias("event_ms"), "name", labels.indexed_uid("season", F.col("idx"), F.col("year"), domain).alias("uid"))


def cross_quarter_days(spark: SparkSession, window: Window, domain: str = labels.DOMAIN) -> DataFrame:
    """(year, idx, jde, event_ms, name, uid) of the midpoints of adjacent seasons that fall in the window.

    A season meets the one before it by equality of their numbers 4 * year + idx, so the first one of a year meets the previous December.
    """
    first, last = window.start.year, window.end.year
    numbered = _jde(spark, first - 1, last).withColumn("n", 4 * F.col("year") + F.col("idx"))
    before = numbered.select((F.col("n") + 1).alias("n"), F.col("jde").alias("jde_before"))
    rows = numbered.drop("name").join(before, "n").join(F.broadcast(dimensions.cross_quarters(spark)), "idx")
    middle = rows.withColumn("jde", (F.col("jde_before") + F.col("jde")) / 2).withColumn("event_ms", seasonal.jde_ms(F.col("jde")))
    inside = middle.where((F.col("event_ms") >= window.start_ms) & (F.col("event_ms") < window.end_ms))
    return inside.select("year", "idx", "jde", "event_ms", "name", labels.indexed_uid("crossquarter", F.col("idx"), F.col("year"), domain).alias("uid"))
