"""The event tables applied to fact tables with instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import solar
from ..functions.labels import date_of
from ..functions.steps import chain
from .moon import with_phase
from .seasons import season_events


def event_moon_phase(events: DataFrame, ms: str = "ms") -> DataFrame:
    """Adds moon_phase, rounded to six digits, which are the reliable ones."""
    return with_phase(events, ms, "moon_phase").withColumn("moon_phase", F.round("moon_phase", 6))


def with_daylight(events: DataFrame, ms: str = "ms", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds daylight: whether the instant lies between sunrise and sunset of its own or a neighbouring UTC day at its place.

    Sun times are computed on the rows themselves, so nothing is joined. Null where there is no sunrise on the instant's day.
    """
    rows = events
    day = F.floor(F.col(ms) / solar.DAY_MS) * solar.DAY_MS
    for k in (-1, 0, 1):
        inputs = {"lat": F.col(lat), "lon": F.col(lon), "day_ms": day + k * solar.DAY_MS}
        rows = chain(rows, solar.STEPS, inputs, {"rise_ms": f"_rise{k + 1}", "set_ms": f"_set{k + 1}"}, prefix=f"_s{k + 1}_")
    lit = [(F.col(ms) >= F.col(f"_rise{k}")) & (F.col(ms) < F.col(f"_set{k}")) for k in range(3)]
    up = F.coalesce(lit[0], F.lit(False)) | F.coalesce(lit[1], F.lit(False)) | F.coalesce(lit[2], F.lit(False))
    return rows.withColumn("daylight", F.when(F.col("_rise1").isNotNull(), up)).select(*events.columns, "daylight")


def with_season(spark: SparkSession, facts: DataFrame, ms: str, first: int, last: int) -> DataFrame:
    """Adds season and season_year: the latest season instant at or before each instant; years first..last are those of the instants.

    Intervals between seasons are keyed by calendar day, so this is an equi-join on the day that the seasons' few thousand days a decade serve, and
    a comparison on the days of an instant itself; there is no range join. Facts with a null instant, or one outside these years, keep their rows, with a
    null season. Columns of facts may have any names; season and season_year replace theirs.
    """
    seasons = season_events(spark, first - 1, last).select("year", "name", "event_ms")
    nxt = F.lead("event_ms").over(W.orderBy("event_ms"))  # four rows a year
    spans = seasons.withColumn("until", F.coalesce(nxt, F.col("event_ms") + 366 * solar.DAY_MS))
    days = F.explode(F.sequence(date_of(F.col("event_ms")), date_of(F.col("until"))))
    keyed = spans.select(days.alias("day"), F.struct(F.col("name").alias("season"), F.col("year").alias("season_year"), F.col("event_ms").alias("since"), "until").alias("span"))
    fact, at = facts.select(F.struct("*").alias("fact")), F.col("fact")[ms]
    met = fact.join(keyed, (date_of(at) == F.col("day")) & (at >= F.col("span.since")) & (at < F.col("span.until")), "left")
    kept = (F.col("fact")[c].alias(c) for c in facts.columns if c not in ("season", "season_year"))
    return met.select(*kept, "span.season", "span.season_year")
