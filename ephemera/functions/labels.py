"""Approximate local time, calendar text and identifiers. All from integers, so no session setting matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_half_up

HOUR_MS, MINUTE_MS, DAY_MS = 3_600_000, 60_000, 86_400_000
#: Part of every identifier after the @; identifiers stay the same between runs for one domain.
DOMAIN = "ephemera"


def offset_hours(lon: Column) -> Column:
    """Solar-longitude hours from UTC; civil zones and summer time may differ by an hour or more."""
    return round_half_up(lon / 15.0).cast("int")


def _sign(offset: Column) -> Column:
    return F.when(offset >= 0, "+").otherwise("-")


def zone_label(offset: Column) -> Column:
    return F.concat(F.lit("UTC"), _sign(offset), F.lpad(F.abs(offset).cast("string"), 2, "0"))


def zone_offset(offset: Column) -> Column:
    return F.concat(_sign(offset), F.lpad(F.abs(offset).cast("string"), 2, "0"), F.lit("00"))


def date_of(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))


def date_digits(day: Column) -> Column:
    """yyyyMMdd. Years of four digits are told by arithmetic, which takes a fraction of a date's own text."""
    number = F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)
    return F.when(number.between(10_000_000, 99_999_999), number.cast("string")).otherwise(F.replace(day.cast("string"), F.lit("-"), F.lit("")))


def stamp(ms: Column) -> Column:
    """yyyyMMddTHHmmss; milliseconds are dropped."""
    s = F.pmod(F.floor(ms / 1000), F.lit(86400)).cast("int")
    minutes = F.floor(s / 60).cast("int")
    clock = F.floor(s / 3600).cast("int") * 10_000 + minutes % 60 * 100 + s % 60
    return F.concat(date_digits(date_of(ms)), F.lit("T"), F.substring((clock + 1_000_000).cast("string"), 2, 6))


def local_stamp(ms: Column, offset: Column) -> Column:
    return stamp(ms + offset.cast("bigint") * HOUR_MS)


def utc_stamp(ms: Column) -> Column:
    return F.concat(stamp(ms), F.lit("Z"))


def local_date(ms: Column, offset: Column) -> Column:
    return date_of(ms + offset.cast("bigint") * HOUR_MS)


def sun_uid(kind: Column, day: Column, lat_text: Column, lon_text: Column, domain: str = DOMAIN) -> Column:
    return F.concat(F.concat_ws("-", kind, date_digits(day), lat_text, lon_text), F.lit(f"@{domain}"))


def indexed_uid(kind: str, idx: Column, year: Column, domain: str = DOMAIN) -> Column:
    return F.concat_ws("-", F.lit(kind), idx.cast("string"), F.concat(year.cast("string"), F.lit(f"@{domain}")))


def moon_uid(name: Column, ms: Column, domain: str = DOMAIN) -> Column:
    return F.concat(F.lit("moon-"), F.regexp_replace(F.lower(name), r"\s+", ""), F.lit("-"), date_digits(date_of(ms)), F.lit(f"@{domain}"))


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone, read as UTC."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    return day + F.hour(ts) * HOUR_MS + F.minute(ts) * MINUTE_MS + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
