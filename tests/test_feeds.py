"""Strict feeds, feeds of long windows, and files that are whole whatever happens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ephemera.operators import celestial, feeds, files, sun
from ephemera.sources import locations as places
from ephemera.sources.spines import Window

W2026 = Window.around(dt.date(2026, 7, 1))
NAMES = ["", "x" * 74, "x" * 75, "x" * 76, "é" * 37 + "x", "x" + "é" * 40, "日本" * 60, "😀" * 80, "a😀é日" * 50, "x" * 74 + "😀" + "y" * 300, "a b " * 60, "\\;,", "tail\nline\r\nnext\r"]


def brute_fold(line):
    out, used = "", 0
    for c in line:
        n = len(c.encode())
        if used + n > 75:
            out, used = out + "\r\n ", 1
        out, used = out + c, used + n
    return out


def test_folding_and_escapes(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for r in rows.select("name", feeds.folded(F.col("name")).alias("folded"), feeds.escaped(F.col("name")).alias("escaped")).collect():
        plain = r["name"].replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\r\n", "\\n").replace("\n", "\\n").replace("\r", "\\n")
        assert r["escaped"] == plain and r["folded"] == brute_fold(r["name"])
        assert all(len(x.encode()) <= 75 for x in r["folded"].split("\r\n")) or "\n" in r["name"]
        assert r["folded"].replace("\r\n ", "") == r["name"] or "\n" in r["name"]


def test_strict_feeds(spark):
    product = "-//" + "日本, é; " * 12 + "//EN"
    strict = feeds.Style(product, 1_767_225_600_000)
    one = spark.createDataFrame([(1, -41.27, 173.28)], places.LOCATIONS)
    plain = feeds.sun_feeds(feeds.sun_feed_lines(sun.labelled_events(one, W2026, "d" * 60))).first()["ics"]
    text = feeds.sun_feeds(feeds.sun_feed_lines(sun.labelled_events(one, W2026, "d" * 60), strict)).first()["ics"]
    assert text.endswith("END:VCALENDAR\r\n") and max(len(x.encode()) for x in text.split("\r\n")) == 75
    lines = text.replace("\r\n ", "").split("\r\n")
    assert lines[2] == f"PRODID:{product}" and lines[5] == "X-WR-CALNAME:Sunrise & Sunset (-41.27\\, 173.28)"
    assert lines.count("DTSTAMP:20260101T000000Z") == lines.count("BEGIN:VEVENT") == 2190
    # Besides those lines it says what the plain feed says.
    assert [x for x in lines[6:-1] if not x.startswith("DTSTAMP")] == plain.split("\r\n")[6:]
    sky = feeds.celestial_feed(celestial.celestial_events(spark, W2026), feeds.Style("p", 0)).first()["ics"]
    assert sky.count("DTSTAMP:19700101T000000Z") == 172 and sky.endswith("END:VCALENDAR\r\n")


def test_long_windows_are_put_together_by_year(spark):
    window, one = Window.years(1900, 2020), spark.createDataFrame([(1, 50.0, 5.0), (2, 89.0, 5.0)], places.LOCATIONS)
    lines = feeds.sun_feed_lines(sun.labelled_events(one, window))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "kind_rank", "body"))), lambda x: x["body"]), "\r\n")
    want = {r["location_id"]: f"{r['head']}\r\n{r['bodies']}\r\nEND:VCALENDAR" for r in lines.groupBy("location_id").agg(F.first("head").alias("head"), whole.alias("bodies")).collect()}
    got = feeds.sun_feeds(lines)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {int(r["feed_id"]): r["ics"] for r in got.collect()} == want
    sky = celestial.celestial_events(spark, Window.years(1990, 2040))
    rows = sky.orderBy(*celestial.ORDER).select(feeds.event_text(F.col("name"), F.col("event_ms"), F.col("uid")).alias("body")).collect()
    assert "\r\n".join(r["body"] for r in rows) in feeds.celestial_feed(sky).first()["ics"]


def written(path):
    return {p.name: p.read_bytes() for p in path.iterdir() if p.suffix == ".ics"}


def test_a_task_that_dies_leaves_whole_feeds(spark, tmp_path):
    many = spark.createDataFrame([(k, 10.0 + k, 20.0) for k in range(6)], places.LOCATIONS)
    lines = feeds.sun_feed_lines(sun.labelled_events(many, W2026))
    feeds.write_feed_files(lines, tmp_path.as_uri(), tasks=2)
    old = written(tmp_path)
    changed = lines.withColumn("body", F.concat("body", F.lit("X")))
    bad = F.when((F.col("location_id") == 3) & (F.col("day") == dt.date(2026, 7, 1)), F.raise_error(F.lit("died"))).otherwise(F.col("body"))
    dealt = changed.repartition(2, "filename").sortWithinPartitions("filename", "location_id", "day", "kind_rank").withColumn("body", bad)
    with pytest.raises(Exception, match="died"):
        feeds._save(dealt.select("filename", "location_id", "head", "body", "tail"), tmp_path.as_uri())
    now = written(tmp_path)
    assert now.keys() == old.keys() and now["sunrise-13-20.ics"] == old["sunrise-13-20.ics"]
    assert all(text.endswith(b"END:VCALENDAR") and text.count(b"BEGIN:VEVENT") == text.count(b"END:VEVENT") == 2190 for text in now.values())
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".staged")] == []
    feeds.write_feed_files(changed, tmp_path.as_uri(), tasks=2)
    want = {r["filename"]: r["ics"].encode() for r in feeds.sun_feeds(changed).collect()}
    assert written(tmp_path) == want != old and sorted(p.name for p in tmp_path.iterdir()) == sorted(want)


def test_two_attempts_of_one_task(tmp_path):
    from pyspark.sql import Row

    rows = [Row(filename="a.ics", location_id=1, head="H", body=f"b{k}", tail="T") for k in range(3)]
    writer = files._FeedWriter(tmp_path.as_uri())
    slow = iter(rows)

    def interrupted():
        yield next(slow)
        writer.write(iter(rows))  # another attempt begins and ends meanwhile
        assert (tmp_path / "a.ics").read_bytes() == b"H\r\nb0\r\nb1\r\nb2\r\nT"
        yield from slow

    writer.write(interrupted())
    writer.commit([])
    assert written(tmp_path) == {"a.ics": b"H\r\nb0\r\nb1\r\nb2\r\nT"} and len(list(tmp_path.iterdir())) == 1


def test_no_feeds_at_all(spark, tmp_path):
    none = spark.createDataFrame([], places.LOCATIONS)
    feeds.write_feed_files(feeds.sun_feed_lines(sun.labelled_events(none, W2026)), (tmp_path / "none").as_uri(), tasks=2)
    assert not (tmp_path / "none").exists() or written(tmp_path / "none") == {}
