"""The versioned store: what a refresh computes, what readers see, and what is left after failures."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ephemera.operators import feeds, refresh, store, sun
from ephemera.sources import locations as places
from ephemera.sources.spines import Window

PLACES = [(1, -41.27, 173.28), (2, 78.22, 15.65), (3, 90.0, 0.0), (6, 66.0, -20.0), (7, 65.9, 25.0), (8, 69.65, 18.96), (9, -0.0, 10.0), (10, 0.0, 10.0)]
W26, W27 = (Window.around(dt.date(y, 6, 1)) for y in (2026, 2027))
EVENT = ["location_id", "lat", "lon", "day", "kind_rank", "kind", "event_ms"]


def table(spark, rows):
    return spark.createDataFrame(rows, places.LOCATIONS)


def same(got, want):
    got, want = got.select(EVENT), want.select(EVENT)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def cells(made):
    return {(r["location_id"], r["year"], r["made"]) for r in made.cells().collect()}


@pytest.fixture
def made(spark, tmp_path):
    return store.Store(spark, tmp_path.as_uri(), buckets=4)


def test_a_refresh_equals_a_fresh_build(spark, made):
    first = table(spark, PLACES)
    assert made.version() == 0 and made.read().isEmpty()
    assert made.refresh(first, W26) == 1
    assert same(made.read(), sun.sun_events(first, W26))
    moved = table(spark, [(1, -41.27, 173.5), *PLACES[2:], (11, 10.0, 20.0)])
    assert made.refresh(moved, W27) == 2
    assert same(made.read(), sun.sun_events(moved, W27)) and same(made.read(1), sun.sun_events(first, W26))
    # Only the year that came, the place that moved and the new one were computed.
    kept = {i for i, *_ in PLACES[2:]}
    assert cells(made) == {(i, y, 1 if i in kept and y < 2028 else 2) for i in kept | {1, 11} for y in (2026, 2027, 2028)}
    assert spark.table(made.events).where("made = 2").select("location_id", "year").distinct().where("year < 2028 and location_id not in (1, 11)").isEmpty()


def test_a_second_run_adds_nothing(spark, made):
    made.refresh(table(spark, PLACES), W26)
    before = spark.table(made.events).count()
    assert made.refresh(table(spark, PLACES[::-1] + PLACES[:2] + [(None, 1.0, 1.0), (12, None, 1.0)]), W26) == 1
    assert made.version() == 1 and spark.table(made.events).count() == before
    assert made.refresh(table(spark, PLACES), W26, formula=store.FORMULA + 1) == 3
    assert {m for _, _, m in cells(made)} == {3} and same(made.read(), sun.sun_events(table(spark, PLACES), W26))
    assert made.refresh(table(spark, PLACES), W26, formula=store.FORMULA + 1, rebuild=True) == 4


def test_windows_that_are_not_whole_years(spark, made):
    short, longer = Window(dt.date(2026, 3, 1), dt.date(2027, 2, 1)), Window(dt.date(2026, 3, 1), dt.date(2027, 3, 1))
    for window in (short, longer, Window(dt.date(2026, 1, 1), dt.date(2027, 1, 1))):
        made.refresh(table(spark, PLACES), window)
        assert same(made.read(), sun.sun_events(table(spark, PLACES), window))
    made.refresh(table(spark, PLACES), Window(dt.date(2026, 1, 1), dt.date(2026, 1, 1)))
    assert made.version() == 4 and made.read().isEmpty()


def test_a_reader_sees_one_version(spark, made, monkeypatch):
    made.refresh(table(spark, PLACES), W26)
    reading = made.read()
    live = made.folder.create

    def look(name):
        if name.startswith("live/"):  # all is written, and nothing of it is seen
            assert made.version() == 1 and same(made.read(), sun.sun_events(table(spark, PLACES), W26))
        return live(name)

    monkeypatch.setattr(made.folder, "create", look)
    assert made.refresh(table(spark, PLACES[1:]), W27) == 2
    assert same(reading, sun.sun_events(table(spark, PLACES), W26))


def test_a_refresh_that_dies_leaves_nothing_to_be_read(spark, made, monkeypatch):
    made.refresh(table(spark, PLACES), W26)
    live = made.folder.create

    def die(name):
        if name.startswith("live/"):
            raise RuntimeError("died")
        return live(name)

    with monkeypatch.context() as m:
        m.setattr(made.folder, "create", die)
        with pytest.raises(RuntimeError, match="died"):
            made.refresh(table(spark, PLACES), W27)
    assert made.version() == 1
    assert made.refresh(table(spark, PLACES), W27) == 3  # the dead attempt's number is not used again
    assert same(made.read(), sun.sun_events(table(spark, PLACES), W27))
    assert made.vacuum() == 3  # the year that left, the dead attempt's year and its cells
    assert same(made.read(), sun.sun_events(table(spark, PLACES), W27))
    assert made.folder.names("live") == ["3"]


def test_vacuum_keeps_what_is_read(spark, made):
    made.refresh(table(spark, PLACES), W26)
    made.refresh(table(spark, PLACES[1:]), W27)
    assert made.vacuum(keep=2) == 0
    assert made.vacuum() == 1 and same(made.read(), sun.sun_events(table(spark, PLACES[1:]), W27))
    assert not Path(made.folder.path.removeprefix("file:"), "events/made=1/year=2025").exists()


def test_a_store_is_opened_again(spark, made):
    made.refresh(table(spark, PLACES), W26)
    for t in (made.events, made.cell_table):
        spark.sql(f"DROP TABLE {t}")  # as in another session; the files stay
    again = store.Store(spark, made.folder.path, buckets=9)
    assert again.buckets == 4 and same(again.read(), sun.sun_events(table(spark, PLACES), W26))
    assert again.refresh(table(spark, PLACES), W27) == 2 and same(made.read(), sun.sun_events(table(spark, PLACES), W27))


def test_two_writers_never_share_a_number(made):
    assert [made._claim(), made._claim()] == [1, 2]
    assert not made.folder.create("claims/2")


def test_differences(spark, made):
    moved = table(spark, [(1, -41.27, 173.5), *PLACES[2:], (11, 10.0, 20.0)])
    made.refresh(table(spark, PLACES), W26)
    made.refresh(moved, W27)
    old, new = (refresh.one_per_uid(sun.labelled_events(p, w)) for p, w in ((table(spark, PLACES), W26), (moved, W27)))
    want = refresh.refresh_diff(old, new)
    got = made.diff(1, 2)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert {r["action"] for r in got.select("action").distinct().collect()} == {"insert", "delete"}
    assert made.diff(2, 2).isEmpty()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_nothing_is_shuffled_that_lies_by_place(spark, made):
    one = table(spark, PLACES)
    made.refresh(one, W26)
    made.refresh(one, W27)
    assert exchanges(made.diff(1, 2)) == 0
    labelled = sun.with_labels(made.read())
    feed = feeds.sun_feeds(feeds.sun_feed_lines(labelled, keep=("place",)), "place")
    assert exchanges(feed) == 0
    assert exchanges(labelled.groupBy("place", "location_id", "kind", "local_date").count()) == 0
    want = feeds.sun_feeds(feeds.sun_feed_lines(sun.labelled_events(one, W27)))
    assert feed.exceptAll(want).isEmpty() and feed.count() == want.count()
    # Events of a refresh are not shuffled either: cells lie by place before their days multiply.
    plan = sun.own_sun_events(made.cells().repartition(4, "place"), "first", "last", ("place", "year"))
    assert exchanges(plan) == 0


def test_own_windows(spark):
    first, long = dt.date(2025, 3, 1), dt.date(1000, 1, 1)
    rows = [(k, 10.0 + k, 20.0, first, first + dt.timedelta(k % 40)) for k in range(30)]
    rows += [(100, 50.0, 5.0, long, dt.date(2999, 12, 31)), (101, 1.0, 1.0, first, first - dt.timedelta(1)), (102, 1.0, 1.0, None, first)]
    df = spark.createDataFrame(rows, "location_id long, lat double, lon double, first date, last date")
    cut = sun.stretches(df).collect()
    assert max((r["last"] - r["first"]).days for r in cut) == sun.SPAN - 1 and sum((r["last"] - r["first"]).days + 1 for r in cut if r["location_id"] == 100) == 730_485
    got = sun.own_sun_events(df, tasks=8)
    assert got.where("location_id > 100").isEmpty()
    for k in (0, 1, 39 % 30):
        want = sun.sun_events(table(spark, [(k, 10.0 + k, 20.0)]), Window(first, first + dt.timedelta(k % 40 + 1)))
        assert same(got.where(F.col("location_id") == k), want)
    # No task has more than its share of the long window.
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) < 1.1 * sum(shares) / 8
    assert same(got.where("location_id = 100 and year(day) = 2026"), sun.sun_events(table(spark, [(100, 50.0, 5.0)]), Window.years(2026, 2026)))


def test_only_files_of_changed_places_are_written(spark, made, tmp_path):
    folder = tmp_path / "feeds"
    twins = [*PLACES, (20, 65.9, 25.0)]
    made.write_changed_feeds(0, made.refresh(table(spark, twins), W26), folder.as_uri())
    written = lambda: {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.iterdir() if p.suffix == ".ics"}
    feed = lambda rows, window: {r["filename"]: r["ics"].encode() for r in feeds.sun_feeds(feeds.sun_feed_lines(sun.labelled_events(table(spark, rows), window))).orderBy(F.desc(F.col("feed_id").cast("long"))).collect()}
    first = written()
    assert {k: v for k, (_, v) in first.items()} == feed(twins, W26) and "sunrise-0-10.ics" in first
    # One place moved, one left, one of two that share a file left, one came.
    rows = [(1, -41.27, 173.5), *[p for p in PLACES if p[0] not in (1, 2)], (11, 10.0, 20.0)]
    made.write_changed_feeds(1, made.refresh(table(spark, rows), W26), folder.as_uri())
    second = written()
    assert {k: v for k, (_, v) in second.items()} == feed(rows, W26)
    same = {k for k in first.keys() & second.keys() if first[k] == second[k]}
    assert same == {k for k in second if k not in ("sunrise--41.27-173.5.ics", "sunrise-10-20.ics", "sunrise-65.9-25.ics")} and len(first.keys() - second.keys()) == 2
    assert {tuple(r) for r in made.changed(1, 2).collect()} == {("-41.27,173.28", "delete"), ("78.22,15.65", "delete"), ("-41.27,173.5", "insert"), ("10,20", "insert"), ("65.9,25", "update")}
    assert made.changed(2, 2).isEmpty() and exchanges(made.changed(1, 2)) == 0
    made.write_changed_feeds(2, 2, folder.as_uri())
    assert written() == second
