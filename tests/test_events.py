"""Golden instants, properties and traps of the event tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ephemera.operators import celestial, enrich, feeds, moon, refresh, seasons, sun
from ephemera.sources import locations as places
from ephemera.sources.spines import Window

UTC = dt.timezone.utc
W2026 = Window.around(dt.date(2026, 7, 1))
PLACES = [(1, -41.27, 173.28), (2, 78.22, 15.65), (3, 90.0, 0.0), (4, -90.0, 0.0), (5, 0.0, 0.0), (6, 66.0, -20.0), (7, 65.9, 25.0), (8, 69.65, 18.96), (9, 10.0, 180.0), (10, 10.0, -180.0)]


def ms(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1000 + 0.5)


@pytest.fixture(scope="module")
def locations(spark):
    return spark.createDataFrame(PLACES, places.LOCATIONS)


@pytest.fixture(scope="module")
def labelled(locations):
    return sun.with_labels(sun.sun_events(locations, W2026)).cache()


def test_window_is_three_calendar_years():
    assert (W2026.start, W2026.end, W2026.days) == (dt.date(2025, 1, 1), dt.date(2028, 1, 1), 1095)


SEASONS = {
    ("March Equinox", 2024): "2024-03-20 03:02:39.552",
    ("June Solstice", 2025): "2025-06-21 02:35:59.100",
    ("September Equinox", 2026): "2026-09-23 00:13:43.498",
    ("December Solstice", 2024): "2024-12-21 09:14:46.101",
    ("December Solstice", 2026): "2026-12-21 20:53:51.117",
}
CROSSES = {
    ("Imbolc", 2024): "2024-02-04 15:13:56.564",
    ("Beltane", 2025): "2025-05-05 17:43:49.994",
    ("Lughnasadh", 2026): "2026-08-07 04:18:49.551",
    ("Samhain", 2024): "2024-11-06 10:55:44.972",
}


def test_season_instants(spark):
    rows = {(r["name"], r["year"]): r for r in seasons.season_events(spark, 2024, 2026).collect()}
    assert len(rows) == 12
    assert {k: rows[k]["event_ms"] for k in SEASONS} == {k: ms(v) for k, v in SEASONS.items()}
    assert rows["June Solstice", 2025]["uid"] == "season-1-2025@ephemera"


def test_cross_quarters_lie_between_their_seasons(spark):
    window = Window.years(2024, 2026)
    rows = {(r["name"], r["year"]): r for r in seasons.cross_quarter_days(spark, window).collect()}
    assert {k: rows[k]["event_ms"] for k in CROSSES} == {k: ms(v) for k, v in CROSSES.items()}
    instants = sorted(r["event_ms"] for r in [*seasons.season_events(spark, 2023, 2026).collect(), *rows.values()])
    kinds = {r["event_ms"]: "cross" for r in rows.values()}
    between = [kinds.get(x, "season") for x in instants][3:]
    assert between == ["season", "cross"] * 12 + ["season"]


def test_cross_quarters_keep_to_a_window_of_days(spark):
    rows = seasons.cross_quarter_days(spark, Window(dt.date(2025, 2, 3), dt.date(2025, 5, 5))).collect()
    assert [r["name"] for r in rows] == ["Imbolc"]


def test_moon_events(spark):
    rows = moon.moon_events(spark, W2026).orderBy("event_ms").collect()
    assert [(r["name"], r["event_ms"]) for r in rows[:6]] == [
        ("First Quarter", ms("2025-01-06 22:28:16.382")),
        ("Full Moon", ms("2025-01-13 17:24:33.552")),
        ("Last Quarter", ms("2025-01-21 19:32:10.605")),
        ("New Moon", ms("2025-01-29 12:21:52.996")),
        ("First Quarter", ms("2025-02-05 07:55:03.801")),
        ("Full Moon", ms("2025-02-12 07:55:50.841")),
    ]
    cycle = ["First Quarter", "Full Moon", "Last Quarter", "New Moon"]
    assert [r["name"] for r in rows] == cycle * 37
    assert rows[0]["uid"] == "moon-firstquarter-20250106@ephemera"


def test_moon_events_do_not_depend_on_the_window(spark):
    wide = {r["event_ms"] for r in moon.moon_events(spark, W2026).collect()}
    narrow = Window(dt.date(2025, 3, 1), dt.date(2027, 6, 10))
    assert {r["event_ms"] for r in moon.moon_events(spark, narrow).collect()} == {x for x in wide if narrow.start_ms < x <= narrow.end_ms}


def test_phase_stays_in_its_range(spark):
    got = moon.daily_phases(spark, Window.years(1900, 2100)).agg(F.min("phase"), F.max("phase"), F.countDistinct("ms")).first()
    assert 0 <= got[0] and got[1] <= 1 and got[2] == Window.years(1900, 2100).days + 1


def test_sun_events_of_a_place(labelled):
    rows = labelled.where("location_id = 1").orderBy("day", "kind_rank").collect()
    assert len(rows) == 2190
    first = rows[0]
    assert first["event_ms"] + 12 * 3_600_000 == ms("2025-01-01 04:58:32.577")
    assert rows[1]["event_ms"] + 12 * 3_600_000 == ms("2025-01-01 20:04:13.346")
    assert (first["tz_id"], first["local_start"], first["local_end"]) == ("UTC+12", "20250101T045832", "20250101T045932")
    assert first["uid"] == "sunrise-20250101--41.27-173.28@ephemera"


def test_polar_places_have_gaps_and_both_events_are_absent_together(labelled, locations):
    counts = {(r["location_id"], r["kind"]): r["count"] for r in labelled.groupBy("location_id", "kind").count().collect()}
    assert counts[2, "sunrise"] == counts[2, "sunset"] == 375
    assert not any(k[0] in (3, 4) for k in counts)
    times = sun.sun_times(locations, W2026)
    assert times.where("(rise_ms is null) <> (set_ms is null) or rise_ms >= set_ms").count() == 0
    assert times.count() == 10 * 1095


def test_local_dates_do_not_align_with_the_window(labelled):
    rows = labelled.where("location_id = 5 and kind = 'sunrise'").orderBy("event_ms").collect()
    assert rows[0]["local_date"] == dt.date(2024, 12, 31) and rows[0]["local_start"] == "20241231T060038"
    assert rows[-1]["local_date"] == dt.date(2027, 12, 30)


def test_identifiers_collide_near_the_polar_circle_only(labelled):
    found = {r["location_id"]: r["n"] for r in sun.uid_collisions(labelled).groupBy("location_id").agg(F.count("*").alias("n")).collect()}
    assert found == {6: 3, 7: 3, 8: 1}


def test_feeds_have_the_expected_bytes(spark, labelled):
    feed = feeds.sun_feeds(feeds.sun_feed_lines(labelled.where("location_id = 1"))).first()
    assert feed["filename"] == "sunrise--41.27-173.28.ics"
    assert len(feed["ics"].encode()) == 348_532
    lines = feed["ics"].split("\r\n")
    assert lines[5] == "X-WR-CALNAME:Sunrise & Sunset (-41.27, 173.28)"
    assert lines[6:15] == ["BEGIN:VTIMEZONE", "TZID:UTC+12", "BEGIN:STANDARD", "DTSTART:16010101T000000", "TZOFFSETFROM:+1200", "TZOFFSETTO:+1200", "TZNAME:UTC+12", "END:STANDARD", "END:VTIMEZONE"]
    assert lines[15:21] == ["BEGIN:VEVENT", "DTSTART;TZID=UTC+12:20250101T045832", "DTEND;TZID=UTC+12:20250101T045932", "SUMMARY:Sunrise", "UID:sunrise-20250101--41.27-173.28@ephemera", "END:VEVENT"]
    assert lines[-1] == "END:VCALENDAR"
    sky = feeds.celestial_feed(celestial.celestial_events(spark, W2026)).first()
    assert len(sky["ics"].encode()) == 23_212 and sky["ics"].count("BEGIN:VEVENT") == 172
    names = [x[8:] for x in sky["ics"].split("\r\n") if x.startswith("SUMMARY:")]
    assert names[:9] == ["March Equinox", "June Solstice", "September Equinox", "December Solstice", "Imbolc", "Beltane", "Lughnasadh", "Samhain", "March Equinox"]
    assert names[24:26] == ["First Quarter", "Full Moon"]


def test_feed_files_equal_the_assembled_feeds(spark, labelled, tmp_path):
    lines = feeds.sun_feed_lines(labelled.where("location_id in (1, 2)"))
    feeds.write_feed_files(lines, tmp_path.as_uri(), tasks=3)
    want = {r["filename"]: r["ics"].encode() for r in feeds.sun_feeds(lines).collect()}
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.suffix == ".ics"} == want


def test_places_with_equal_coordinates_share_one_file(spark, tmp_path):
    twins = spark.createDataFrame([(3, 10.0, 20.0), (2, 10.0, 20.0), (4, 11.0, -20.0)], places.LOCATIONS)
    lines = feeds.sun_feed_lines(sun.labelled_events(twins, W2026))
    feeds.write_feed_files(lines, tmp_path.as_uri(), tasks=4)
    want = {r["filename"]: r["ics"].encode() for r in feeds.sun_feeds(lines).collect()}
    assert len(want) == 2
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.suffix == ".ics"} == want
    assert [tuple(r) for r in places.shared_coordinates(twins).collect()] == [(10.0, 20.0, 2, 2, 3)]
    first = refresh.one_per_uid(sun.labelled_events(twins, W2026)).where("lat = 10").select("location_id").distinct().collect()
    assert [r[0] for r in first] == [2]


def test_the_celestial_feed_is_a_file_and_a_table(spark, tmp_path):
    sky = feeds.celestial_feed(celestial.celestial_events(spark, W2026))
    feeds.write_whole_feeds(sky, (tmp_path / "files").as_uri())
    written = (tmp_path / "files" / "celestial.ics").read_bytes()
    assert len(written) == 23_212 and written == sky.first()["ics"].encode()
    feeds.write_feed_table(sky, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).first()["ics"].encode() == written


def test_labels_of_a_place_equal_those_of_its_events(locations):
    one, other = sun.labelled_events(locations, W2026), sun.with_labels(sun.sun_events(locations, W2026))
    assert one.select(sorted(one.columns)).exceptAll(other.select(sorted(one.columns))).count() == 0


def test_samples_stand_once_without_overlap(spark):
    window = Window(dt.date(2024, 1, 1), dt.date(2027, 3, 1))
    rows = moon.daily_phases(spark, window, overlap=False).select("ms").collect()
    assert sorted(r["ms"] for r in rows) == [window.start_ms + k * 86_400_000 for k in range(window.days + 1)]


def test_empty_feed(spark):
    empty = celestial.celestial_events(spark, Window(dt.date(2025, 1, 1), dt.date(2025, 1, 1)))
    assert feeds.celestial_feed(empty).first()["ics"].endswith("X-WR-CALNAME:Celestial Events\r\nEND:VCALENDAR")


def test_refresh(spark, labelled, locations, tmp_path):
    later = sun.with_labels(sun.sun_events(locations, Window.around(dt.date(2027, 1, 1))))
    old, new = (refresh.one_per_uid(x.where("location_id = 1")) for x in (labelled, later))
    got = {r["action"]: r["count"] for r in refresh.refresh_diff(old, new).groupBy("action").count().collect()}
    assert got == {"insert": 2 * 366, "delete": 2 * 365}
    assert refresh.refresh_diff(old, old).count() == 0
    whole = refresh.refresh_diff(refresh.one_per_uid(labelled), refresh.one_per_uid(later))
    met = refresh.events_diff(labelled, later)
    assert met.exceptAll(whole).isEmpty() and whole.exceptAll(met).isEmpty() and refresh.events_diff(labelled, labelled).isEmpty()
    moved = old.withColumn("event_ms", F.col("event_ms") + F.when(F.col("kind") == "sunset", 1).otherwise(0))
    assert {r["action"] for r in refresh.refresh_diff(old, moved).collect()} == {"update"}
    path = str(tmp_path / "events")
    refresh.write_events(labelled.where("location_id = 1"), path)
    refresh.write_events(labelled.where("location_id = 1 and year(day) = 2026"), path)
    assert spark.read.parquet(path).count() == 2190


def test_small_tables_are_spread_and_large_ones_left_alone(spark, locations):
    plan = sun.sun_events(locations, W2026)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    many = locations.repartition(64)
    assert sun.spread(many, 16) is many


def test_daylight_and_seasons_of_instants(spark):
    rows = spark.createDataFrame([(1, ms("2025-06-21 12:00:00"), 50.0, 0.0), (2, ms("2025-06-21 23:59:00"), 50.0, 0.0), (3, ms("2025-01-01 00:30:00"), -41.27, 173.28), (4, ms("2025-12-21 12:00:00"), 89.0, 0.0)], "id int, ms bigint, lat double, lon double")
    assert [r["daylight"] for r in enrich.with_daylight(rows).orderBy("id").collect()] == [True, False, True, None]
    found = enrich.with_season(spark, rows, "ms", 2025, 2025).orderBy("id").collect()
    assert [(r["season"], r["season_year"]) for r in found] == [("June Solstice", 2025), ("June Solstice", 2025), ("December Solstice", 2024), ("September Equinox", 2025)]


def test_facts_without_a_season_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, ms("1990-01-01 00:00:00"), "y"), (3, ms("2025-07-01 00:00:00"), "z")], "day int, until bigint, season string").withColumn("span", F.lit(7))
    found = {r["day"]: (r["season"], r["season_year"], r["span"]) for r in enrich.with_season(spark, rows, "until", 2025, 2025).collect()}
    assert found == {1: (None, None, 7), 2: (None, None, 7), 3: ("June Solstice", 2025, 7)}
