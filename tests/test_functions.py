"""Number rules, labels, validation and readers."""

import pytest
from pyspark.sql import functions as F

from ephemera.functions import labels
from ephemera.functions.numeric import number_text, parse_number, round_half_up
from ephemera.sources import locations as places


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("value", "text"), [(5.0, "5"), (-41.27, "-41.27"), (0.0005, "0.0005"), (1e-7, "1e-7"), (-0.0, "0"), (0.0, "0"), (173.28, "173.28"), (-180.0, "-180"), (1.5e-9, "1.5e-9"), (0.001, "0.001"), (0.00012345, "0.00012345"), (1e-6, "0.000001")])
def test_number_text(spark, value, text):
    assert one(spark, number_text(F.lit(value))) == [text]


def test_ties_go_up(spark):
    assert one(spark, *(round_half_up(F.lit(x)) for x in (-0.5, 0.5, 1.5, -1.5, -0.51))) == [0, 1, 2, -1, -1]


@pytest.mark.parametrize(("lon", "label", "shift"), [(-7.5, "UTC+00", "+0000"), (7.5, "UTC+01", "+0100"), (-157.4, "UTC-10", "-1000"), (180.0, "UTC+12", "+1200"), (-180.0, "UTC-12", "-1200")])
def test_zones(spark, lon, label, shift):
    offset = labels.offset_hours(F.lit(lon))
    assert one(spark, labels.zone_label(offset), labels.zone_offset(offset)) == [label, shift]


@pytest.mark.parametrize(("text", "value"), [("", None), (" 12 ", 12.0), ("12d", None), ("0x10", None), ("NaN", None), ("Infinity", None), ("abc", None), ("-1.5e1", -15.0), (".5", 0.5), ("5.", 5.0), ("+3", 3.0), (None, None)])
def test_parsing(spark, text, value):
    assert one(spark, parse_number(F.lit(text).cast("string"))) == [value]


def test_labels_do_not_depend_on_the_session_zone(spark):
    made = one(spark, labels.utc_stamp(F.lit(1735689599999)), labels.date_of(F.lit(-1)).cast("string"), labels.stamp(F.lit(-1)))
    assert made == ["20241231T235959Z", "1969-12-31", "19691231T235959"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, labels.utc_stamp(F.lit(1735689599999)), labels.date_of(F.lit(-1)).cast("string"), labels.stamp(F.lit(-1))) == made
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_validation(spark, tmp_path):
    rows = [(1, "90", "-180"), (2, "90.01", "0"), (3, None, "5"), (4, "12d", "181"), (5, "-90", " 180 ")]
    raw = spark.createDataFrame(rows, places.RAW)
    assert [tuple(r) for r in places.valid_locations(raw).orderBy("location_id").collect()] == [(1, 90.0, -180.0), (5, -90.0, 180.0)]
    reasons = {r["location_id"]: r["reason"] for r in places.rejected_locations(raw).collect()}
    assert reasons == {2: "lat out of range", 3: "lat missing", 4: "lat not a number; lon out of range"}
    raw.write.option("header", "true").csv(str(tmp_path / "csv"))
    raw.write.json(str(tmp_path / "json"))
    places.valid_locations(raw).write.parquet(str(tmp_path / "parquet"))
    for kind in ("csv", "json", "parquet"):
        assert places.read_locations(spark, str(tmp_path / kind), kind).count() == 2

    typed = spark.createDataFrame([(1, 95.0, 500.0), (2, float("nan"), 0.0), (3, 45.0, None), (4, 45.0, 9.0)], places.LOCATIONS)
    typed.write.parquet(str(tmp_path / "typed"))
    typed.write.orc(str(tmp_path / "orc"))
    for kind, name in (("parquet", "typed"), ("orc", "orc")):
        assert [tuple(r) for r in places.read_locations(spark, str(tmp_path / name), kind).collect()] == [(4, 45.0, 9.0)]
    reasons = {r["location_id"]: r["reason"] for r in places.rejected_locations(typed).collect()}
    assert reasons == {1: "lat out of range; lon out of range", 2: "lat not a number", 3: "lon missing"}


CSV = ["1,90,-180", "2,90.01,0", "3,,5", "4,12d,181", "5,1,2,surplus", "6,1", "x,1,2", ",3,4", '"7","8","9"', '7,"1,2",3']
JSON = ['{"location_id": 1, "lat": "10", "lon": 20}', '{"location_id": 2, "lat": "10"', "no json", '{"location_id": 3, "lat": null, "lon": "5"}', '{"lat": "1", "lon": "2"}', '{"location_id": "x", "lat": "1", "lon": "2"}', '{"location_id": 4, "lat": "1", "lon": "2", "more": [1]}']


def test_every_record_of_a_file_is_told(spark, tmp_path):
    from pyspark.sql import Observation

    (tmp_path / "a.csv").write_text("\n".join(["location_id,lat,lon", *CSV]))
    (tmp_path / "a.json").write_text("\n".join(JSON))
    want = {
        "csv": {"1": "", "2": "lat out of range", "3": "lat missing", "4": "lat not a number; lon out of range", "5,1,2,surplus": "record cannot be read", "6,1": "record cannot be read", "x,1,2": "record cannot be read", None: "location_id missing", "7": ""},
        "json": {"1": "", '{"location_id": 2, "lat": "10"': "record cannot be read", "no json": "record cannot be read", "3": "lat missing", None: "location_id missing", JSON[5]: "record cannot be read", "4": ""},
    }
    for kind, lines in (("csv", CSV), ("json", JSON)):
        seen = Observation(f"records-{kind}")
        records = places.read_records(spark, str(tmp_path / f"a.{kind}"), kind, seen)
        good, bad = places.split_records(records, str(tmp_path / f"split-{kind}"))
        assert good.count() + bad.count() == len(lines) == seen.get["rows"]
        assert (good.count(), bad.count()) == (seen.get["accepted"], seen.get["rejected"])
        told = {r["record"] or (None if r["location_id"] is None else str(r["location_id"])): r["reason"] for r in records.where("coalesce(lat_text, '') <> '1,2'").collect()}
        assert told == want[kind]
        assert sorted(map(tuple, good.collect())) == sorted(map(tuple, places.read_locations(spark, str(tmp_path / f"a.{kind}"), kind).collect()))
        assert all(r["record"] is None or (r["location_id"], r["lat_text"], r["lon_text"]) == (None,) * 3 for r in bad.collect())


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(1, 5.0, 6.0), (1, 5.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 0.0)], places.LOCATIONS)
    assert sorted(map(tuple, places.repeated_ids(rows).collect())) == [(1, 2, 5.0, 2.0), (2, 2, 1.0, 1.0)]
    assert sorted(map(tuple, places.one_per_id(rows).collect())) == [(1, 5.0, 2.0), (2, 1.0, 1.0), (3, 0.0, 0.0)]
