"""The stream gives what the batch gives."""

from pyspark.sql import functions as F

from ephemera.functions.labels import epoch_ms
from ephemera.operators.enrich import event_moon_phase
from ephemera.streaming import enrich


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_phase_of_a_stream_equals_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    run(enrich.with_phase(enrich.read_events(spark, str(tmp_path / "events"))), "phases", "append")
    want = event_moon_phase(events.withColumn("ms", epoch_ms(F.col("ts"))))
    assert spark.table("phases").select("event_id", "moon_phase").exceptAll(want.select("event_id", "moon_phase")).count() == 0
    assert spark.table("phases").count() == events.count()


def test_counts_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    run(enrich.phase_counts(enrich.read_events(spark, str(tmp_path / "events"))), "counts", "complete")
    assert spark.table("counts").agg(F.sum("events")).first()[0] == events.count()
