"""Queries over the test tables. The tables have no coordinates, so locations are derived from keys by integer arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import celestial, enrich, feeds, moon, refresh, seasons, sun
from ..operators.store import Store
from ..sources import locations as places
from ..sources.folders import shared_folder
from ..sources.spines import Window

AS_OF = dt.date(2026, 6, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(key.alias("location_id"), ((key * 7919) % 12001 / 100.0 - 60.0).alias("lat"), ((key * 104729) % 35999 / 100.0 - 180.0).alias("lon"))


def supplier_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(key.alias("location_id"), (55.0 + (key * 37) % 3501 / 100.0).alias("lat"), ((key * 104729) % 35999 / 100.0 - 180.0).alias("lon"))


def raw_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as coordinates in text, most of them out of range; every seventh longitude is no number and every eleventh is missing."""
    key, money = F.col("c_custkey"), F.col("c_acctbal")
    lon = F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.concat((money / 10).cast("decimal(12,3)").cast("string"), F.lit("d"))).otherwise((money / 10).cast("decimal(12,3)").cast("string"))
    return _table(spark, sf_dir, "customer").select(key.alias("location_id"), money.cast("decimal(12,2)").cast("string").alias("lat"), lon.alias("lon"))


def _years(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple[int, int]:
    """First and last year in a column of dates; the present year of AS_OF for an empty table."""
    found = _table(spark, sf_dir, name).agg(F.min(F.year(column)).alias("a"), F.max(F.year(column)).alias("b")).first()
    return (found["a"] or AS_OF.year, found["b"] or AS_OF.year)


def _span(spark: SparkSession, sf_dir: str, name: str, column: str) -> Window:
    """From the year before the first date in a column to the end of the year after the last."""
    first, last = _years(spark, sf_dir, name, column)
    return Window.years(first - 1, last + 1)


# --- events -------------------------------------------------------------------------------------------------


def season_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasons.season_events(spark, *_years(spark, sf_dir, "orders", "o_orderdate"))


def cross_quarter_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasons.cross_quarter_days(spark, _span(spark, sf_dir, "orders", "o_orderdate"))


def sun_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sun.clustered_sun_events(customer_locations(spark, sf_dir), Window.around(AS_OF)).select("location_id", "lat", "lon", "day", "kind", "event_ms")


def sun_events_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sun.clustered_sun_events(supplier_locations(spark, sf_dir), Window.around(AS_OF)).select("location_id", "lat", "lon", "day", "kind", "event_ms")


def sun_event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sun.labelled_events(supplier_locations(spark, sf_dir), Window.around(AS_OF))
    return found.select("location_id", "day", "kind", "end_ms", "offset_hours", "tz_id", "local_date", "local_start", "local_end", "uid")


def sun_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per location and year: days with and without sun, and the mean length of day in milliseconds (whole)."""
    days = sun.sun_times(supplier_locations(spark, sf_dir), Window.around(AS_OF))
    length = F.col("set_ms") - F.col("rise_ms")
    told = days.groupBy("location_id", F.year("day").alias("year")).agg(F.count("rise_ms").alias("days_with"), F.sum(F.col("rise_ms").isNull().cast("int")).alias("days_without"), F.sum(length).alias("total_ms"))
    return told.select("location_id", "year", "days_with", "days_without", F.floor(F.col("total_ms") / F.greatest("days_with", F.lit(1))).alias("mean_ms"))


def valid_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.valid_locations(raw_locations(spark, sf_dir))


def rejected_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.rejected_locations(raw_locations(spark, sf_dir))


def moon_phase_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moon.daily_phases(spark, _span(spark, sf_dir, "events", "ts"), overlap=False).select("ms", F.round("phase", 6).alias("phase"))


def moon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moon.moon_events(spark, _span(spark, sf_dir, "orders", "o_orderdate"))


def celestial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return celestial.celestial_events(spark, _span(spark, sf_dir, "events", "ts"))


# --- feeds and refresh --------------------------------------------------------------------------------------


def sun_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.whole_sun_feeds(sun.sun_events(supplier_locations(spark, sf_dir), Window.around(AS_OF), by=("location_id",)))
    return found.select("feed_id", "filename", F.length("ics").cast("long").alias("n_chars"), F.md5("ics").alias("ics_md5"))


def celestial_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.celestial_feed(celestial_events(spark, sf_dir))
    return found.select("feed_id", "filename", F.length("ics").cast("long").alias("n_chars"), F.md5("ics").alias("ics_md5"))


def refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what changes in the stored sun events when the calendar moves on by a year."""
    made = [sun.labelled_events(supplier_locations(spark, sf_dir), Window.around(AS_OF.replace(year=AS_OF.year + k))) for k in (0, 1)]
    return refresh.events_diff(*made).groupBy("action").agg(F.count(F.lit(1)).alias("events"), F.min("uid").alias("first_uid"))


#: A folder of feeds that a strict calendar reader takes; the domain is long enough for identifiers to be folded.
STRICT = feeds.Style("-//Ephemera//Sunrise Calendar//EN", 1_767_225_600_000)
LONG_DOMAIN = "sunrise-and-sunset-calendars.of-all-places.ephemera"


def strict_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.whole_sun_feeds(sun.sun_events(supplier_locations(spark, sf_dir), Window.around(AS_OF), by=("location_id",)), STRICT, LONG_DOMAIN)
    return found.select("feed_id", "filename", F.length("ics").cast("long").alias("n_chars"), F.md5("ics").alias("ics_md5"))


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all feeds, the suppliers' and the celestial one, written and read again."""
    directory = shared_folder(spark, "feeds")
    located = supplier_locations(spark, sf_dir).withColumn("place", sun.place_text())
    events = sun.sun_events(located, Window.around(AS_OF), keep=("place",), by=("place",))
    feeds.write_feed_files(feeds.sun_feed_years(events, "place"), directory, ordered=True)
    feeds.write_whole_feeds(feeds.celestial_feed(celestial_events(spark, sf_dir)), directory)
    return _files(spark, directory)


def _files(spark: SparkSession, directory: str) -> DataFrame:
    """Every feed file of a folder, which is listed as one; a pattern in the address would list each file by itself."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ics").load(directory)
    return found.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("n_bytes"), F.md5("content").alias("file_md5"))


def refreshed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' feed files after places moved, left and came: those of places that stayed are the first version's.

    Files are packed, since all their texts would be 200 kilobytes a place beside the store; bytes and digest are of the texts.
    """
    store, directory = Store(spark, shared_folder(spark, "sun-store"), buckets=16), shared_folder(spark, "feeds")
    for old, places_ in enumerate((supplier_locations(spark, sf_dir), moved_locations(spark, sf_dir))):
        store.write_changed_feeds(old, store.refresh(places_, Window.around(AS_OF)), directory, packed=True)
    return feeds.packed_feeds(spark, directory).select("filename", F.octet_length("ics").cast("long").alias("n_bytes"), F.md5("ics").alias("file_md5"))


def moved_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' places later: every tenth moved to the other hemisphere, every tenth is gone, and there are as many new ones."""
    key = F.col("location_id")
    old = supplier_locations(spark, sf_dir).where(key % 10 != 1)
    moved = old.withColumn("lat", F.when(key % 10 == 0, -F.col("lat")).otherwise(F.col("lat")))
    return moved.unionByName(old.where(key % 10 == 2).select((key + 1_000_000).alias("location_id"), (-F.col("lat")).alias("lat"), "lon"))


def _refreshed(spark: SparkSession, sf_dir: str) -> Store:
    """A store that was made for one year and refreshed for the next, when places had moved; its versions are 1 and 2."""
    store = Store(spark, shared_folder(spark, "sun-store"), buckets=16)
    store.refresh(supplier_locations(spark, sf_dir), Window.around(AS_OF))
    store.refresh(moved_locations(spark, sf_dir), Window.around(AS_OF.replace(year=AS_OF.year + 1)))
    return store


def refresh_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refreshed store holds: the events of the new places and the new window, and no others."""
    return _refreshed(spark, sf_dir).read().select("location_id", "lat", "lon", "day", "kind", "event_ms")


def refresh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places' years the refreshed store took over from its first version, and how many it computed."""
    return _refreshed(spark, sf_dir).cells().groupBy("made", "year").agg(F.count(F.lit(1)).alias("cells"))


def refresh_store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier whose event differs between the two versions; 0 stands for no event."""
    found = _refreshed(spark, sf_dir).diff(1, 2)
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("old_ms", "new_ms")})


def changed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder of feed files must bring up to date between the two versions: all places that stayed, as the window moved, and those that came or went."""
    return _refreshed(spark, sf_dir).changed(1, 2)


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds from a refreshed store, put together within its buckets."""
    return feeds.whole_sun_feeds(_refreshed(spark, sf_dir).read(), place="place").select("feed_id", "filename", F.length("ics").cast("long").alias("n_chars"), F.md5("ics").alias("ics_md5"))


def sun_events_own_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun events where every place has a window of its own: weeks for most, two centuries for every 500th."""
    key, start = F.col("location_id"), F.lit("1900-01-01").cast("date")
    long = key % 500 == 0
    first = F.date_add(start, F.when(long, 0).otherwise((key * 37) % 40_000).cast("int"))
    places_ = customer_locations(spark, sf_dir).withColumn("first", first)
    last = F.date_add("first", F.when(long, 73_000).otherwise((key * 7) % 60).cast("int"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    return sun.own_sun_events(places_.withColumn("last", last), tasks=tasks).select("location_id", "day", "kind", "event_ms")


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that several places have, where customers' places go by their nation's number, and the coordinates that would be kept."""
    key = F.col("c_custkey")
    told = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("location_id"), ((key * 7919) % 12001 / 100.0 - 60.0).alias("lat"), ((key * 104729) % 35999 / 100.0 - 180.0).alias("lon"))
    return places.repeated_ids(told)


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written as CSV and JSON, some of whose lines cannot be read, and what becomes of each line."""
    key = F.col("location_id")
    raw = raw_locations(spark, sf_dir)
    fields = F.concat_ws(",", F.when(key % 19 == 0, "").when(key % 23 == 0, "no number").otherwise(key.cast("string")), F.coalesce("lat", F.lit("")), F.coalesce("lon", F.lit("")))
    csv = F.concat(fields, F.when(key % 13 == 0, ",surplus").otherwise(""))
    whole = F.to_json(F.struct(F.when(key % 19 != 0, key).alias("location_id"), "lat", "lon"))
    json = F.when(key % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(key % 29 == 0, F.concat(F.lit("{"), whole)).otherwise(whole)
    out = None
    for kind, line, options in (("csv", csv, {"header": "false"}), ("json", json, {})):
        path = shared_folder(spark, kind)
        raw.select(line.alias("value")).write.text(path)
        rows = places.read_records(spark, path, kind, **options).select(F.lit(kind).alias("kind"), "*").withColumn("location_id", F.col("location_id").cast("string"))
        out = rows if out is None else out.unionByName(rows)
    return out


def uid_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sun.uid_collisions(sun.labelled_events(supplier_locations(spark, sf_dir), Window.around(AS_OF), by=("location_id",)))


# --- applied to fact tables ---------------------------------------------------------------------------------


def event_moon_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", labels.epoch_ms(F.col("ts")).alias("ms"))
    return enrich.event_moon_phase(rows)


def event_daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sun was up at each event, at a place derived from its user."""
    user = F.col("user_id")
    rows = _table(spark, sf_dir, "events").select("event_id", labels.epoch_ms(F.col("ts")).alias("ms"), ((user * 7919) % 12001 / 100.0 - 60.0).alias("lat"), ((user * 104729) % 35999 / 100.0 - 180.0).alias("lon"))
    return enrich.with_daylight(rows).select("event_id", "ms", "daylight")


def orders_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_totalprice", labels.epoch_ms(F.col("o_orderdate")).alias("ms"))
    found = enrich.with_season(spark, rows, "ms", *_years(spark, sf_dir, "orders", "o_orderdate"))
    return found.groupBy("season", "season_year").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (season_events, cross_quarter_days, sun_events, sun_events_polar, sun_event_labels, sun_daily_totals, valid_locations, rejected_locations, moon_phase_daily, moon_events, celestial_events, sun_feed, celestial_feed, strict_feed, feed_files, refreshed_files, refresh_diff, refresh_apply, refresh_cells, refresh_store_diff, changed_places, stored_feed, sun_events_own_windows, file_records, repeated_ids, uid_collisions, event_moon_phase, event_daylight, orders_by_season)
}
