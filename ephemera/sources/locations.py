"""Location tables: readers, and validation of coordinates given as text or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.numeric import parse_number

LOCATIONS = "location_id bigint, lat double, lon double"
RAW = "location_id bigint, lat string, lon string"


#: Column of a text format's records that cannot be read.
CORRUPT = "_corrupt_record"


def read_locations(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """(location_id, lat, lon) from parquet, orc, csv or json, validated. Text formats are read with a fixed schema, never inferred.

    read_records() tells what was left out, and why.
    """
    return accepted(read_records(spark, path, kind, **options))


def read_records(spark: SparkSession, path: str, kind: str = "parquet", observation: Observation | None = None, **options: str) -> DataFrame:
    """(location_id, lat, lon, lat_text, lon_text, record, reason): every record of a file once; reason is empty for those that are accepted().

    record is the text of a record that cannot be read: malformed JSON, too many or too few CSV fields, an id that is no number. Null in all others and
    in other formats. observation: gets rows, accepted and rejected when an action has run over the records, without a pass of its own.
    """
    if kind in ("csv", "json"):
        reader = spark.read.schema(f"{RAW}, {CORRUPT} string").options(**({"header": "true"} | options if kind == "csv" else options))
        raw = getattr(reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT), kind)(path)
    else:
        raw = spark.read.options(**options).format(kind).load(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    missing = F.when(F.col("location_id").isNull(), "location_id missing")
    why = F.when(F.col("record").isNotNull(), "record cannot be read").otherwise(F.concat_ws("; ", missing, F.when(F.col("reason") != "", F.col("reason"))))
    told = _checked(raw, "lat", "lon", F.col(CORRUPT).alias("record")).withColumn("reason", why)
    read = lambda name: F.when(F.col("record").isNull(), F.col(name)).alias(name)  # noqa: E731  what a reader guesses of a bad record is not taken
    rows = told.select(*map(read, ("location_id", "lat", "lon", "lat_text", "lon_text")), "record", "reason")
    if observation is None:
        return rows
    count = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    return rows.observe(observation, F.count(F.lit(1)).alias("rows"), count(F.col("reason") == "", "accepted"), count(F.col("reason") != "", "rejected"))


def accepted(records: DataFrame) -> DataFrame:
    return records.where("reason = ''").select("location_id", "lat", "lon")


def rejected(records: DataFrame) -> DataFrame:
    return records.where("reason <> ''").select("location_id", "lat_text", "lon_text", "record", "reason")


def split_records(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of read_records(), read and written below path in one pass."""
    records.withColumn("status", F.when(F.col("reason") == "", "accepted").otherwise("rejected")).write.partitionBy("status").parquet(path)
    stored = records.sparkSession.read.schema(records.schema.add("status", "string")).parquet(path)
    of = lambda status: stored.where(F.col("status") == status).drop("status")
    return accepted(of("accepted")), rejected(of("rejected"))


def repeated_ids(locations: DataFrame) -> DataFrame:
    """(location_id, places, first_lat, first_lon) of ids that several rows have; one_per_id() keeps the coordinates told."""
    return _by_id(locations).where("places > 1").select("location_id", "places", F.col("at.lat").alias("first_lat"), F.col("at.lon").alias("first_lon"))


def one_per_id(locations: DataFrame) -> DataFrame:
    """(location_id, lat, lon), each id once: of several rows the one with the least latitude, then longitude."""
    return _by_id(locations).select("location_id", "at.lat", "at.lon")


def _by_id(locations: DataFrame) -> DataFrame:
    return locations.groupBy("location_id").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("lat", "lon")).alias("at"))


def _checked(raw: DataFrame, lat: str, lon: str, *keep: Column) -> DataFrame:
    def reason(text: str, value: Column, name: str, most: float) -> Column:
        return F.when(F.col(text).isNull(), f"{name} missing").when(value.isNull(), f"{name} not a number").when(~value.between(-most, most), f"{name} out of range")

    def number(name: str) -> Column:
        if isinstance(raw.schema[name].dataType, StringType):
            return parse_number(F.col(name))
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    told = raw.select("location_id", F.col(lat).cast("string").alias("lat_text"), F.col(lon).cast("string").alias("lon_text"), number(lat).alias("lat"), number(lon).alias("lon"), *keep)
    return told.withColumn("reason", F.concat_ws("; ", reason("lat_text", F.col("lat"), "lat", 90.0), reason("lon_text", F.col("lon"), "lon", 180.0)))


def valid_locations(raw: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(location_id, lat, lon) of the rows whose coordinates are numbers in range: latitude -90..90, longitude -180..180, ends included."""
    return _checked(raw, lat, lon).where("reason = ''").select("location_id", "lat", "lon")


def rejected_locations(raw: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(location_id, lat_text, lon_text, reason) of the other rows."""
    return _checked(raw, lat, lon).where("reason <> ''").select("location_id", "lat_text", "lon_text", "reason")


def shared_coordinates(locations: DataFrame) -> DataFrame:
    """(lat, lon, places, first_id, last_id) of coordinates that several places have: their events share identifiers and their feeds a file."""
    told = locations.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("places"), F.min("location_id").alias("first_id"), F.max("location_id").alias("last_id"))
    return told.where("places > 1")
