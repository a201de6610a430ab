"""All global events of a window in feed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..sources.spines import Window
from .moon import moon_events
from .seasons import cross_quarter_days, season_events

#: Feed order: by year the seasons and then the cross-quarter days, and after all of them the moon phases by time.
ORDER = ("block", "year", "sub", "idx", "event_ms")


def celestial_events(spark: SparkSession, window: Window, domain: str = labels.DOMAIN) -> DataFrame:
    """(block, year, sub, idx, event_ms, name, uid). block 0: seasonal (sub 0 seasons, 1 cross-quarter days), 1: moon, whose year, sub and idx are 0.

    Seasons are those of the window's years. Where the window is not whole years, those outside it are left out too.
    """
    seasons = season_events(spark, window.start.year, window.end.year).where((F.col("event_ms") >= window.start_ms) & (F.col("event_ms") < window.end_ms))
    crosses, moons = cross_quarter_days(spark, window, domain), moon_events(spark, window, domain)
    seasons = seasons.withColumn("uid", labels.indexed_uid("season", F.col("idx"), F.col("year"), domain))
    put = lambda df, block, sub: df.select(F.lit(block).alias("block"), "year", F.lit(sub).alias("sub"), "idx", "event_ms", "name", "uid")
    moons = moons.withColumns({"year": F.lit(0), "idx": F.lit(0)})
    return put(seasons, 0, 0).unionByName(put(crosses, 0, 1)).unionByName(put(moons, 1, 0))
