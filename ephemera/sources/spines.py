"""Spines: windows, days, years and daily samples."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
EPOCH = dt.date(1970, 1, 1)
#: Daily samples that share a window partition.
CHUNK = 366


@dataclass(frozen=True)
class Window:
    """[start, end) in days."""

    start: dt.date
    end: dt.date

    @classmethod
    def around(cls, as_of: dt.date | None = None) -> Window:
        """From January 1 of the year before as_of to January 1 two years after its year; as_of: today in UTC if not given."""
        year = (as_of or dt.datetime.now(dt.timezone.utc).date()).year
        return cls(dt.date(year - 1, 1, 1), dt.date(year + 2, 1, 1))

    @classmethod
    def years(cls, first: int, last: int) -> Window:
        return cls(dt.date(first, 1, 1), dt.date(last + 1, 1, 1))

    @property
    def start_ms(self) -> int:
        return (self.start - EPOCH).days * DAY_MS

    @property
    def end_ms(self) -> int:
        return (self.end - EPOCH).days * DAY_MS

    @property
    def days(self) -> int:
        return (self.end - self.start).days


def day_array(window: Window) -> Column:
    """The window's days, end excluded, as one constant array."""
    if window.days <= 0:
        return F.array().cast("array<date>")
    return F.sequence(F.lit(window.start), F.date_sub(F.lit(window.end), 1), F.expr("interval 1 day"))


def day_ms(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH)).cast("bigint") * DAY_MS


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(year), both ends included."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def samples(spark: SparkSession, window: Window) -> DataFrame:
    """(chunk, ms): daily samples, both ends included. Chunks overlap by one sample, so each holds the predecessor of all its own."""
    n = window.days
    chunks = spark.range(0, max(0, -(-n // CHUNK))).select(F.col("id").alias("chunk"))
    index = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.lit(n)))
    return chunks.select("chunk", F.explode(index).alias("i")).select("chunk", (F.col("i") * DAY_MS + window.start_ms).alias("ms"))
