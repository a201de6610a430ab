"""Refreshing stored events without duplicates: identifiers are stable between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import number_text


def one_per_uid(labelled: DataFrame, domain: str = labels.DOMAIN) -> DataFrame:
    """(uid, location_id, lat, lon, day, kind, event_ms): the first event of each identifier by day, instant and place.

    Near the polar circle two events can share an identifier, and so do places with equal coordinates (sources.locations.shared_coordinates()
    reports those). Events are grouped by what an identifier is made of, and the text is made for one of each group.
    """
    first = labelled.groupBy("lat", "lon", "kind", "local_date").agg(F.min(F.struct("day", "event_ms", "location_id")).alias("e"))
    uid = labels.sun_uid(F.col("kind"), F.col("local_date"), number_text(F.col("lat")), number_text(F.col("lon")), domain)
    return first.select(uid.alias("uid"), "e.location_id", "lat", "lon", "e.day", "kind", "e.event_ms")


def refresh_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uid, action, old_ms, new_ms): insert, update or delete for every identifier whose event differs. Both sides: unique uid, event_ms."""
    a, b = old.select("uid", F.col("event_ms").alias("old_ms")), new.select("uid", F.col("event_ms").alias("new_ms"))
    return differing(a.join(b, "uid", "full_outer")).select("uid", "action", "old_ms", "new_ms")


def events_diff(old: DataFrame, new: DataFrame, domain: str = labels.DOMAIN) -> DataFrame:
    """refresh_diff() of one_per_uid() of two tables of labelled events.

    Both sides are grouped as one table by what an identifier is made of, so they meet without a join, in one exchange, and only what differs gets its text.
    """
    told = ("lat", "lon", "kind", "local_date", "day", "event_ms", "location_id")
    both = old.select(*told, F.lit(True).alias("old")).unionByName(new.select(*told, F.lit(False).alias("old")))
    first = lambda side: F.min(F.when(side, F.struct("day", "event_ms", "location_id")))["event_ms"]
    met = both.groupBy("lat", "lon", "kind", "local_date").agg(first(F.col("old")).alias("old_ms"), first(~F.col("old")).alias("new_ms"))
    return differing(met).select(labels.sun_uid(F.col("kind"), F.col("local_date"), number_text(F.col("lat")), number_text(F.col("lon")), domain).alias("uid"), "action", "old_ms", "new_ms")


def differing(met: DataFrame) -> DataFrame:
    action = F.when(F.col("old_ms").isNull(), "insert").when(F.col("new_ms").isNull(), "delete").otherwise("update")
    return met.where(~F.col("old_ms").eqNullSafe(F.col("new_ms"))).withColumn("action", action)


def write_events(events: DataFrame, path: str) -> None:
    """Writes events by year of their day; only the years that events has are replaced."""
    rows = events.withColumn("year", F.year("day"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
