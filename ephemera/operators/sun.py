"""Sunrise and sunset for every location and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, solar
from ..functions.numeric import number_text
from ..functions.steps import chain
from ..sources.spines import Window, day_array, day_ms

#: Order of the two kinds within a day.
KINDS = ((0, "sunrise", "rise_ms"), (1, "sunset", "set_ms"))


#: Rows of a task at most where places multiply by days: of one that passes them on, and of one that groups their events.
PASSED, GROUPED = 1 << 21, 1 << 19


def _tasks(df: DataFrame, rows: int, most: int) -> int:
    """Four a core, and as many more as keep each within `most` of the rows."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // most))


def spread(df: DataFrame, tasks: int | None = None, days: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Deals a small table out before its rows multiply by `days`; a file of a few hundred kilobytes would be one task.

    tasks: if not given four a core, and as many more as keep each of them within PASSED rows, GROUPED with `by`; for that the rows are counted. A table
    that already comes in more partitions is left alone, so large inputs are not shuffled. by: deals by these columns in any case, so that what is
    grouped by them later needs no exchange.
    """
    wanted = tasks or _tasks(df, df.count() * days, GROUPED if by else PASSED)
    if by:
        return df.repartition(wanted, *by)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def sun_times(locations: DataFrame, window: Window, tasks: int | None = None, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(location_id, lat, lon, *keep, day, rise_ms, set_ms): one row per location and UTC day; null instants where the sun neither rises nor sets.

    keep: further columns of locations. by: columns to deal them by, as in spread().
    """
    rows = spread(locations.select("location_id", "lat", "lon", *keep), tasks, window.days, by)
    return _times(rows.withColumn("day", F.explode(day_array(window))))


def _times(daily: DataFrame) -> DataFrame:
    """Adds rise_ms and set_ms to rows (lat, lon, day, ...)."""
    inputs = {"lat": F.col("lat"), "lon": F.col("lon"), "day_ms": day_ms(F.col("day"))}
    return chain(daily, solar.STEPS, inputs, {"rise_ms": "rise_ms", "set_ms": "set_ms"})


def sun_events(locations: DataFrame, window: Window, tasks: int | None = None, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(location_id, lat, lon, *keep, day, kind_rank, kind, event_ms): the events that exist, two a day at most.

    day is the UTC day that was sampled; an event's local date may be the day before or after. One narrow stage: no exchange follows the
    spreading of the locations.
    """
    return _events(sun_times(locations, window, tasks, keep, by), keep)


#: Places at most that take turns, day by day, in clustered_sun_events().
NEAR = 256
#: Squares of a side of the map that cells tell apart, as a power of two.
CELL_BITS = 16


def _cell() -> Column:
    """A place's number on a curve through squares of squares (Z-order), whose neighbours are mostly near each other; null without finite coordinates."""

    def apart(x: Column) -> Column:  # the 16 bits with a zero before each
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    side = 1 << CELL_BITS
    x, y = (((F.col(c) + 180) * (side / 360)).try_cast("bigint").bitwiseAND(F.lit(side - 1).cast("bigint")) for c in ("lon", "lat"))
    return apart(x) + 2 * apart(y)


def clustered_sun_events(locations: DataFrame, window: Window, tasks: int | None = None, keep: tuple[str, ...] = (), near: int = NEAR) -> DataFrame:
    """The rows of sun_events(), in an order that makes files of them small: up to `near` places that lie near each other take turns, day by day.

    Neighbouring rows then have nearly the same instant, and what tells places apart repeats from day to day; a place's own days have neither. Only
    places are shuffled, twice: along the curve, and by their number on it, so that no run is longer than `near` however dense places lie. All columns
    of locations must be orderable.
    """
    rows = locations.select("lon", "lat", "location_id", *keep)
    n = rows.count()
    tasks = tasks or _tasks(rows, n * window.days, PASSED)
    order = ["_cell", *rows.columns]  # whole, so that a task that runs again numbers alike
    along = rows.withColumn("_cell", _cell()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # An id has a row's number in its partition in its lower 33 bits, and the partition's above.
    numbered = along.withColumn("_id", F.monotonically_increasing_id())
    number = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    runs = numbered.withColumn("_run", F.col("_id") - number % max(1, min(near, -(-n // tasks)))).repartitionByRange(tasks, "_run")
    # Dealt by run, runs are grouped where they are.
    places = runs.groupBy("_run").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("_places"))
    daily = places.withColumn("day", F.explode(day_array(window))).withColumn("_place", F.explode("_places")).select("_place.*", "day")
    return _events(_times(daily), keep)


#: Days of one row at most where places have windows of their own.
SPAN = 366


def stretches(locations: DataFrame, first: str = "first", last: str = "last", span: int = SPAN) -> DataFrame:
    """The rows with their windows [first, last] (dates, both included) cut to at most `span` days each, so that a place with a long window is many rows.

    Rows without a day (an end before the start, or a null) go.
    """
    days = F.datediff(last, first)
    part = lambda k: F.struct(F.date_add(first, k * span).alias("a"), F.least(F.col(last), F.date_add(first, (k + 1) * span - 1)).alias("b"))
    cut = "_stretch"
    while cut in locations.columns:
        cut += "_"
    rows = locations.where(days >= 0).withColumn(cut, F.explode(F.transform(F.sequence(F.lit(0), F.floor(days / span).cast("int")), part)))
    return rows.withColumns({first: F.col(cut)["a"], last: F.col(cut)["b"]}).drop(cut)


def own_sun_events(locations: DataFrame, first: str = "first", last: str = "last", keep: tuple[str, ...] = (), tasks: int | None = None, span: int = SPAN) -> DataFrame:
    """sun_events() where each place has a window of its own: columns first and last, dates, both included.

    Long windows become several rows before days multiply. tasks: deals those rows out evenly over so many tasks, so that one place with a window of
    millennia among many short ones is not one task's work; without it they stay where they are.
    """
    rows = stretches(locations.select("location_id", "lat", "lon", *keep, first, last), first, last, span)
    if tasks:
        rows = rows.repartition(tasks)
    daily = rows.withColumn("day", F.explode(F.sequence(F.col(first), F.col(last)))).drop(first, last)
    return _events(_times(daily), keep)


def _events(times: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    both = F.array(*(F.struct(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), F.col(ms).alias("event_ms")) for rank, kind, ms in KINDS))
    return times.withColumn("e", F.explode(both)).select("location_id", "lat", "lon", *keep, "day", "e.*").where("event_ms is not null")


#: What is the same for all events of a place: the offset from UTC, its zone, and the coordinates as text.
PLACE = ("offset_hours", "tz_id", "lat_text", "lon_text")


def with_place(df: DataFrame) -> DataFrame:
    """Adds PLACE. Before the days multiply it costs a place what it would cost every event after."""
    rows = df.withColumns({"offset_hours": labels.offset_hours(F.col("lon")), "lat_text": number_text(F.col("lat")), "lon_text": number_text(F.col("lon"))})
    return rows.withColumn("tz_id", labels.zone_label(F.col("offset_hours")))


def labelled_events(locations: DataFrame, window: Window, domain: str = labels.DOMAIN, tasks: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The sun events with their labels: with_labels(sun_events(...)), with what belongs to a place told once for the place."""
    return with_labels(sun_events(with_place(locations), window, tasks, PLACE, by), domain)


def place_text() -> Column:
    """The coordinates as text, the same for places that share a feed's file."""
    return F.concat_ws(",", number_text(F.col("lat")), number_text(F.col("lon")))


def with_labels(events: DataFrame, domain: str = labels.DOMAIN) -> DataFrame:
    """Adds end_ms, local_date, local_start, local_end and uid, and PLACE where events lack it."""
    rows = events if set(PLACE) <= set(events.columns) else with_place(events)
    offset = F.col("offset_hours")
    dated = rows.withColumns({"end_ms": F.col("event_ms") + labels.MINUTE_MS, "local_date": labels.local_date(F.col("event_ms"), offset)})
    return dated.select(
        *dated.columns,
        labels.local_stamp(F.col("event_ms"), offset).alias("local_start"),
        labels.local_stamp(F.col("end_ms"), offset).alias("local_end"),
        labels.sun_uid(F.col("kind"), F.col("local_date"), F.col("lat_text"), F.col("lon_text"), domain).alias("uid"),
    )


def uid_collisions(labelled: DataFrame, domain: str = labels.DOMAIN) -> DataFrame:
    """(location_id, uid, events): identifiers of several events, which occur where two events of a kind fall on one local date.

    Events are grouped by what an identifier is made of, and only those of several events get their text.
    """
    met = labelled.groupBy("location_id", "lat", "lon", "kind", "local_date").agg(F.count(F.lit(1)).alias("events")).where("events > 1")
    uid = labels.sun_uid(F.col("kind"), F.col("local_date"), number_text(F.col("lat")), number_text(F.col("lon")), domain)
    return met.select("location_id", uid.alias("uid"), "events")
