"""iCalendar feeds: one text line block per event, assembled per feed or streamed to files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from .celestial import ORDER
from .files import CRLF, PACKED, FeedFiles
from .sun import with_place

#: Octets of a strict feed's line, without its line break. A continuation begins with a space, which counts.
OCTETS = 75


def _block(*lines: Column | str) -> Column:
    return F.concat_ws(CRLF, *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name), value)


def escaped(text: Column) -> Column:
    """Text with the calendar format's escapes: backslash, semicolon, comma and line breaks."""
    for plain, code in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), (CRLF, "\\n"), ("\n", "\\n"), ("\r", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def folded(line: Column) -> Column:
    """The line cut into lines of at most OCTETS octets of UTF-8, none of them within a character; continuations begin with a space."""

    def put(at: Column, c: Column) -> Column:
        n = F.octet_length(c)
        full = at["used"] + n > OCTETS
        done = F.when(full, F.concat(at["done"], at["line"], F.lit(CRLF + " "))).otherwise(at["done"])
        return F.struct(done.alias("done"), F.when(full, c).otherwise(F.concat(at["line"], c)).alias("line"), F.when(full, n + 1).otherwise(at["used"] + n).alias("used"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"), F.lit(0).alias("used"))
    any_text = F.aggregate(F.split(line, ""), start, put, lambda at: F.concat(at["done"], at["line"]))
    # Characters of one octet each are cut by their number.
    plain = F.concat(F.substring(line, 1, OCTETS), F.regexp_replace(F.substring(line, OCTETS + 1, 1 << 30), f"(?s)(.{{1,{OCTETS - 1}}})", CRLF + " $1"))
    octets = F.octet_length(line)
    return F.when(octets <= OCTETS, line).when(octets == F.length(line), plain).otherwise(any_text)


@dataclass(frozen=True)
class Style:
    """How feeds are written. Plain ones have no DTSTAMP, escapes, folding or last line break; strict ones have them all.

    stamp_ms: makes feeds strict; the instant of DTSTAMP, one for all events, so that feeds made again from the same events are equal.
    """

    product: str
    stamp_ms: int | None = None

    @property
    def strict(self) -> bool:
        return self.stamp_ms is not None

    @property
    def tail(self) -> str:
        return f"END:VCALENDAR{CRLF if self.strict else ''}"

    def line(self, name: str, value: Column) -> Column:
        return folded(_line(name, value)) if self.strict else _line(name, value)

    def text(self, name: str, value: Column) -> Column:
        """A line whose value is free text."""
        return self.line(name, escaped(value) if self.strict else value)

    def begin(self) -> list[Column | str]:
        return ["BEGIN:VEVENT", *([_line("DTSTAMP:", labels.utc_stamp(F.lit(self.stamp_ms).cast("long")))] if self.strict else [])]

    def head(self, title: Column) -> list[Column | str]:
        return ["BEGIN:VCALENDAR", "VERSION:2.0", self.line("PRODID:", F.lit(self.product)), "CALSCALE:GREGORIAN", "METHOD:PUBLISH", self.text("X-WR-CALNAME:", title)]


SUN, SKY = Style("-//Ephemera//Sunrise Calendar//EN"), Style("-//Ephemera//Celestial Calendar//EN")


def event_text(summary: Column, ms: Column, uid: Column, style: Style = SKY) -> Column:
    """An event in UTC, one minute long."""
    end = ms + labels.MINUTE_MS
    return _block(*style.begin(), _line("DTSTART:", labels.utc_stamp(ms)), _line("DTEND:", labels.utc_stamp(end)), style.text("SUMMARY:", summary), style.text("UID:", uid), "END:VEVENT")


def zoned_event_text(summary: Column, tz: Column, start: Column, end: Column, uid: Column, style: Style = SUN) -> Column:
    """An event in a named zone; null where start is."""
    at = lambda name, value: style.line(f"{name};TZID=", F.concat(tz, F.lit(":"), value))
    return F.when(start.isNotNull(), _block(*style.begin(), at("DTSTART", start), at("DTEND", end), style.text("SUMMARY:", summary), style.text("UID:", uid), "END:VEVENT"))


def zone_text(tz: Column, offset: Column) -> Column:
    """A zone of one fixed offset."""
    shift = labels.zone_offset(offset)
    return _block("BEGIN:VTIMEZONE", _line("TZID:", tz), "BEGIN:STANDARD", "DTSTART:16010101T000000", _line("TZOFFSETFROM:", shift), _line("TZOFFSETTO:", shift), _line("TZNAME:", tz), "END:STANDARD", "END:VTIMEZONE")


def _sun_head(style: Style) -> Column:
    lat, lon = F.col("lat_text"), F.col("lon_text")
    title = F.concat(F.lit("Sunrise & Sunset ("), lat, F.lit(", "), lon, F.lit(")"))
    return _block(*style.head(title), zone_text(F.col("tz_id"), F.col("offset_hours")))


def _sun_file() -> Column:
    return F.concat(F.lit("sunrise-"), F.col("lat_text"), F.lit("-"), F.col("lon_text"), F.lit(".ics"))


def sun_feed_lines(labelled: DataFrame, style: Style = SUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(location_id, *keep, filename, head, day, kind_rank, body, tail): every event's text, with its feed's head and tail, the same in all its rows."""
    summary = F.when(F.col("kind") == "sunrise", "Sunrise").otherwise("Sunset")
    body = zoned_event_text(summary, F.col("tz_id"), F.col("local_start"), F.col("local_end"), F.col("uid"), style)
    return labelled.select("location_id", *keep, _sun_file().alias("filename"), _sun_head(style).alias("head"), "day", "kind_rank", body.alias("body"), F.lit(style.tail).alias("tail"))


def _put_together(events: DataFrame, style: Style, domain: str, *by: str) -> DataFrame:
    """(location_id, lat, lon, *by, filename, head, fixed, events): sun events (location_id, lat, lon, day, kind_rank, event_ms, *by) by place and by.

    events are their stamps, in order; fixed is the text around them, the same for all events of a place, for _bodies(). Lines of stamps are never
    long enough to be folded, and a date has eight digits that come before the first fold.
    """
    ms, offset = F.col("event_ms"), labels.offset_hours(F.col("lon"))
    # Stamps are columns before they are collected, since a collection evaluates its own expressions without generated code.
    stamps = {"start": labels.local_stamp(ms, offset), "end": labels.local_stamp(ms + labels.MINUTE_MS, offset)}
    told = events.select("location_id", "lat", "lon", *by, F.struct("day", "kind_rank", *(v.alias(c) for c, v in stamps.items())).alias("event"))
    places = with_place(told.groupBy("location_id", "lat", "lon", *by).agg(F.array_sort(F.collect_list("event")).alias("events")))
    at = lambda name: F.concat(F.lit(f"{name};TZID="), F.col("tz_id"), F.lit(":"))

    def named(kind: str, summary: str) -> list[Column]:
        """The text between an event's end and its date, and that after the date."""
        uid = F.concat(F.concat_ws("-", F.lit(kind), F.lit("0" * 8), "lat_text", "lon_text"), F.lit(f"@{domain}"))
        line, date = style.text("UID:", uid), len(f"UID:{kind}-")
        before = _block("", style.text("SUMMARY:", F.lit(summary)), f"UID:{kind}-")
        return [before.alias(f"{kind}_before"), _block(F.substring(line, date + 9, 1 << 30), "END:VEVENT").alias(f"{kind}_after")]

    fixed = F.struct(_block(*style.begin(), at("DTSTART")).alias("start"), _block("", at("DTEND")).alias("end"), *named("sunrise", "Sunrise"), *named("sunset", "Sunset"))
    return places.select("location_id", "lat", "lon", *by, _sun_file().alias("filename"), _sun_head(style).alias("head"), fixed.alias("fixed"), "events")


def _bodies() -> Column:
    """The texts of a place's events, one after the other."""
    fixed = F.col("fixed")

    def text(e: Column) -> Column:
        of = lambda part: F.when(e["kind_rank"] == 0, fixed[f"sunrise_{part}"]).otherwise(fixed[f"sunset_{part}"])
        return F.concat(fixed["start"], e["start"], fixed["end"], e["end"], of("before"), F.substring_index(e["start"], "T", 1), of("after"))

    return F.array_join(F.transform("events", text), CRLF)


def sun_feed_years(events: DataFrame, place: str, style: Style = SUN, domain: str = labels.DOMAIN) -> DataFrame:
    """(location_id, filename, head, year, body, tail) of sun events without labels: a row is a year of a feed, and its body all the year's events.

    place: a column by which events lie (dealt by it before days multiplied, or a store's buckets), the same for places that share a file. A file's rows
    then stand together and in order, as write_feed_files() takes them for `ordered`, and there is no exchange; text is neither dealt nor sorted.
    """
    years = _put_together(events.withColumn("year", F.year("day")), style, domain, "year", place)
    ordered = years.sortWithinPartitions("filename", "location_id", "year")
    return ordered.select("location_id", "filename", "head", "year", _bodies().alias("body"), F.lit(style.tail).alias("tail"))


def whole_sun_feeds(events: DataFrame, style: Style = SUN, domain: str = labels.DOMAIN, place: str | None = None) -> DataFrame:
    """sun_feeds() of sun events without labels. A feed's events meet as stamps, less than its text, and text is made once.

    No exchange where events lie by location_id, or by `place`, another column.
    """
    told = _put_together(events, style, domain, *([place] if place else []))
    return told.select(F.col("location_id").cast("string").alias("feed_id"), "filename", F.concat_ws(CRLF, "head", _bodies(), F.lit(style.tail)).alias("ics"))


def _in_order(*order: str) -> Column:
    """The last column's values in the order of all."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]])


def sun_feeds(lines: DataFrame, place: str | None = None) -> DataFrame:
    """(feed_id, filename, ics), one row per location, events by day, sunrise first.

    Events are put together by year, and years by feed, so a list holds a year's events or a feed's years at most. Both happen where a feed's rows lie:
    they are dealt by location once; with `place`, a column by which they lie already (the buckets of a store), not at all.
    """
    by = [place, "location_id"] if place else ["location_id"]
    rows = (lines if place else lines.repartition("location_id")).withColumn("year", F.year("day"))
    same = [F.any_value(c).alias(c) for c in ("filename", "head", "tail")]
    years = rows.groupBy(*by, "year").agg(*same, F.array_join(_in_order("day", "kind_rank", "body"), CRLF).alias("text"))
    feeds = years.groupBy(*by).agg(*same, _in_order("year", "text").alias("texts"))
    return feeds.select(F.col("location_id").cast("string").alias("feed_id"), "filename", F.concat_ws(CRLF, "head", F.array_join("texts", CRLF), "tail").alias("ics"))


def celestial_feed(events: DataFrame, style: Style = SKY) -> DataFrame:
    """(feed_id, filename, ics), one row, put together by year and then whole as in sun_feeds()."""
    year = F.when(F.col("block") == 1, F.year(labels.date_of(F.col("event_ms")))).otherwise(F.col("year"))
    rows = events.select(*ORDER, year.alias("part"), event_text(F.col("name"), F.col("event_ms"), F.col("uid"), style).alias("body"))
    parts = rows.groupBy("block", "part").agg(F.array_join(_in_order(*ORDER, "body"), CRLF).alias("text"))
    whole = parts.agg(_in_order("block", "part", "text").alias("texts"))
    head = _block(*style.head(F.lit("Celestial Events")))
    return whole.select(F.lit("celestial").alias("feed_id"), F.lit("celestial.ics").alias("filename"), F.concat_ws(CRLF, head, F.when(F.size("texts") > 0, F.array_join("texts", CRLF)), F.lit(style.tail)).alias("ics"))


# --- sinks --------------------------------------------------------------------------------------------------


def write_feed_table(feeds: DataFrame, path: str) -> None:
    feeds.write.mode("overwrite").parquet(path)


def write_feed_files(lines: DataFrame, directory: str, tasks: int | None = None, gone: DataFrame | None = None, ordered: bool = False, packed: bool = False) -> None:
    """One file per feed from sun_feed_lines() or sun_feed_years(), written by the tasks as rows stream by: no feed is ever held whole.

    directory: any address that pyarrow's file systems open. A feed's file is the old one or the new one, whole: see FeedFiles. Places with equal
    coordinates have one feed and one file, so a file's rows are all in one task and those of its first place are written. gone: a table of (filename)
    of further feeds, whose files are deleted. ordered: lines are sun_feed_years(), whose rows are written as they lie. packed: files are in gzip, a ninth
    as large, with names that end in .gz besides; packed_feeds() reads them. A folder's files must be all packed or all plain, as one form does not
    replace the other.
    """
    rows = lines if ordered else lines.repartition(*([tasks] if tasks else []), "filename").sortWithinPartitions("filename", "location_id", "day", "kind_rank")
    rows = rows.select("filename", "location_id", "head", "body", "tail")
    if gone is not None:
        rows = rows.unionByName(gone.select("filename"), allowMissingColumns=True)
    _save(rows, directory, packed)


def write_whole_feeds(feeds: DataFrame, directory: str, packed: bool = False) -> None:
    """One file per row of feeds(filename, ics), such as celestial_feed() or sun_feeds() make, with its text byte for byte. packed: as in write_feed_files()."""
    nothing = F.lit(None).cast("string")
    _save(feeds.select("filename", F.lit(0).cast("long").alias("location_id"), F.col("ics").alias("head"), nothing.alias("body"), nothing.alias("tail")), directory, packed)


def packed_feeds(spark: SparkSession, directory: str) -> DataFrame:
    """(filename, ics) of a folder of packed files: their texts, under the names of plain files."""
    found = spark.read.option("pathGlobFilter", f"*.ics{PACKED}").text(directory, wholetext=True)
    return found.select(F.regexp_replace("_metadata.file_name", f"\\{PACKED}$", "").alias("filename"), F.col("value").alias("ics"))


def _save(rows: DataFrame, directory: str, packed: bool = False) -> None:
    rows.sparkSession.dataSource.register(FeedFiles)
    rows.write.format(FeedFiles.name()).mode("append").option("packed", packed).save(directory)
