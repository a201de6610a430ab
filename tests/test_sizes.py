"""Work that grows with its input: tasks and buckets by rows, no exchange of events or text, and feeds put together from parts."""

import datetime as dt
import gzip
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ephemera.functions import labels
from ephemera.operators import feeds, files, store, sun
from ephemera.plans import queries
from ephemera.sources import locations as places
from ephemera.sources.spines import Window

PLACES = [(1, -41.27, 173.28), (2, 78.22, 15.65), (3, 90.0, 0.0), (6, 66.0, -20.0), (7, 65.9, 25.0), (8, 69.65, 18.96), (9, -0.0, 10.0), (10, 0.0, 10.0)]
W26, W27 = (Window.around(dt.date(y, 6, 1)) for y in (2026, 2027))


def table(spark, rows):
    return spark.createDataFrame(rows, places.LOCATIONS)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_buckets_grow_with_the_first_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CELLS_A_BUCKET", 5)
    made = store.Store(spark, tmp_path.as_uri(), buckets=2)
    other = store.Store(spark, tmp_path.as_uri(), buckets=3)  # opened before the store is made
    made.refresh(table(spark, PLACES), W26)
    assert made.buckets == 5 and other.read().count() == made.read().count() and other.buckets == 5
    tasks = {int(p.name.split("-")[1]) for p in tmp_path.glob("events/made=1/year=2026/*.parquet")}
    halves = spark.table(made.events).where("year = 2026").select(F.expr("pmod(hash(place), 10)")).distinct().collect()
    assert tasks == {r[0] for r in halves}  # a task has half a bucket; before: tasks were as many as the cores
    moved = table(spark, [(1, -41.27, 173.5), *PLACES[2:], (11, 10.0, 20.0)])
    made.refresh(moved, W27)
    cut = ["location_id", "lat", "lon", "day", "kind_rank", "kind", "event_ms"]
    assert same(made.read().select(cut), sun.sun_events(moved, W27).select(cut))
    assert exchanges(made.read()) == 0 and exchanges(made.diff(1, 2)) == 0  # places moved and left


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(sun, "GROUPED", 400)
    monkeypatch.setattr(sun, "PASSED", 300)
    one = table(spark, PLACES)
    assert sun.sun_events(one, W26).rdd.getNumPartitions() == -(-8 * 1095 // 300)
    events = sun.labelled_events(one, W26, by=("location_id",))
    assert events.rdd.getNumPartitions() == -(-8 * 1095 // 400)
    met = sun.uid_collisions(events)
    assert exchanges(met) == 1 and same(met, sun.uid_collisions(sun.labelled_events(one, W26)))  # narrow places are dealt, no events


@pytest.mark.parametrize("style", [feeds.SUN, feeds.Style("-//" + "日本, é; " * 12 + "//EN", 1_767_225_600_000)])
@pytest.mark.parametrize("domain", ["d", "d" * 60, "é" * 50])
def test_feeds_from_parts(spark, tmp_path, style, domain):
    one, window = table(spark, [*PLACES[1:6], (20, 65.9, 25.0)]).withColumn("place", sun.place_text()), Window(dt.date(1599, 12, 1), dt.date(1600, 2, 1))
    window = window if style is feeds.SUN else Window(dt.date(2026, 11, 1), dt.date(2027, 4, 1))
    want = feeds.sun_feeds(feeds.sun_feed_lines(sun.labelled_events(one, window, domain), style))
    events = sun.sun_events(one, window, keep=("place",), by=("place",))
    assert same(feeds.whole_sun_feeds(events, style, domain, "place"), want)
    years = feeds.sun_feed_years(events, "place", style, domain)
    assert exchanges(years) == 1
    feeds.write_feed_files(years, tmp_path.as_uri(), ordered=True)
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {r["filename"]: r["ics"].encode() for r in want.where("feed_id <> '20'").collect()}


def test_no_event_is_dealt_for_a_query_of_feeds(spark, sf_dir):
    for name in ("sun_feed", "strict_feed", "uid_collisions"):
        assert exchanges(queries.QUERIES[name](spark, sf_dir)) == 1, name  # before: events or their text were another


def test_digits_of_dates(spark):
    days = spark.sql("select explode(array(date'0001-02-03', date'0999-12-31', date'1000-01-01', date'2026-06-01', date'9999-12-31', date'+10000-01-01', date'-0001-01-01', null)) as d")
    got = days.select(labels.date_digits(F.col("d")).alias("a"), F.replace(F.col("d").cast("string"), F.lit("-"), F.lit("")).alias("b"))
    assert got.where("not a <=> b").isEmpty()


def test_files_of_sun_events_are_small(spark, tmp_path):
    queries.QUERIES["sun_events"](spark, "/root/testdata/sf0.01").write.parquet(tmp_path.as_uri() + "/out")
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 6.9 * 3_285_000  # before: 8.3 bytes a row


def test_clustered_events_are_the_events(spark, monkeypatch):
    monkeypatch.setattr(sun, "PASSED", 300)
    odd = [(20, None, 3.0), (21, 4.0, None), (None, 5.0, 6.0), (22, float("nan"), 7.0), (23, 8.0, float("inf")), (24, -90.0, -180.0), (25, 90.0, 180.0), *PLACES[:2]]
    one = table(spark, PLACES + odd).withColumn("name", F.concat(F.lit("n"), "location_id"))
    for near in (1, 3, 256):
        got = sun.clustered_sun_events(one, W26, keep=("name",), near=near)
        assert same(got, sun.sun_events(one, W26, keep=("name",))), near
    assert exchanges(got) == 2  # of places
    assert sun.clustered_sun_events(one.limit(0), W26).count() == 0
    same_place = table(spark, [(k, 10.0, 20.0) for k in range(40)])
    runs = sun.clustered_sun_events(same_place, Window(dt.date(2026, 1, 1), dt.date(2026, 1, 3)), tasks=2, near=8)
    parts = runs.select(F.spark_partition_id().alias("p"), "location_id", "day").distinct().groupBy("p").agg(F.countDistinct("location_id").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 40 and len(parts) == 2  # places at one point are dealt too


def test_refreshed_files_take_a_fraction_of_their_text(spark, sf_dir):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("feeds-*"))
    texts = queries.refreshed_files(spark, sf_dir).agg(F.sum("n_bytes")).first()[0]
    (folder,) = set(root.glob("feeds-*")) - before
    assert sum(p.stat().st_size for p in folder.iterdir()) < texts / 8  # before: the whole of it


@pytest.mark.parametrize("style", [feeds.SUN, feeds.Style("-//" + "日本, é; " * 12 + "//EN", 1_767_225_600_000)])
def test_packed_feeds_hold_the_same_text(spark, tmp_path, style):
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    made = store.Store(spark, (tmp_path / "store").as_uri(), buckets=2)
    held = lambda: {p.name: gzip.decompress(p.read_bytes()) for p in packed.iterdir()}
    for old, rows in enumerate((PLACES, [(1, -41.27, 173.5), *PLACES[2:], (11, 10.0, 20.0), (12, 65.9, 25.0)])):  # one moved, one left, one came, one shares a file
        new = made.refresh(table(spark, rows), W26)
        for folder in (plain, packed):
            made.write_changed_feeds(old, new, folder.as_uri(), style, packed=folder is packed)
        texts = {p.name: p.read_bytes() for p in plain.iterdir()}
        assert held() == {f"{k}.gz": v for k, v in texts.items()} and "sunrise-65.9-25.ics" in texts and len(texts) == 6
        assert {r["filename"]: r["ics"].encode() for r in feeds.packed_feeds(spark, packed.as_uri()).collect()} == texts
    whole = spark.createDataFrame([("a.ics", "A\r\né\n\n")], "filename string, ics string")
    feeds.write_whole_feeds(whole, packed.as_uri(), packed=True)
    assert held()["a.ics.gz"] == "A\r\né\n\n".encode() and feeds.packed_feeds(spark, packed.as_uri()).where("filename = 'a.ics'").select("filename", "ics").collect() == whole.collect()


def test_attempts_write_equal_packed_bytes(tmp_path):
    rows = [Row(filename="a.ics", location_id=1, head="H", body=f"b{k}", tail="T") for k in range(3)]
    out = []
    for name in ("x", "y"):
        writer = files._FeedWriter((tmp_path / name).as_uri(), packed=True)
        writer.write(iter(rows))
        writer.commit([])
        out.append({p.name: p.read_bytes() for p in (tmp_path / name).iterdir()})
    data = out[0]["a.ics.gz"]
    assert out[0] == out[1] and gzip.decompress(data) == b"H\r\nb0\r\nb1\r\nb2\r\nT"
    assert data[3] == 0 and data[4:8] == b"\0" * 4  # no name, no time
