"""Structured Streaming over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import epoch_ms
from ..operators.enrich import event_moon_phase

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def with_phase(events: DataFrame) -> DataFrame:
    """The moon's phase at each event; stateless, so any output mode and any lateness will do."""
    return event_moon_phase(events.withColumn("ms", epoch_ms(F.col("ts"))))


def phase_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(day window, quarter of the cycle, events): with a watermark, so that state is dropped once days are complete."""
    rows = with_phase(events).withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    quarter = F.floor(F.col("moon_phase") * 4).cast("int")
    return rows.groupBy(F.window("at", width), quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("events"))
