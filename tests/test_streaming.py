"""Streams over a folder of Parquet files, drained in one go."""

from lapidary.plans import cleaning
from lapidary.streaming import refine

SF = "/root/testdata/sf0.001"


def stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_match_a_batch(spark, tmp_path):
    got = drained(refine.windowed(stream(spark), "ts", "1 hour", "1 day", "event_type", "value"), "win", tmp_path, "complete")
    want = spark.read.parquet(f"{SF}/events.parquet")
    assert got.agg({"n": "sum"}).first()[0] == want.count()
    assert abs(got.agg({"total": "sum"}).first()[0] - want.agg({"value": "sum"}).first()[0]) < 1e-6


def test_dedup_and_rules(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = drained(refine.deduplicated(refine.validated(stream(spark)), ["event_id"], "ts", "10 days"), "dd", tmp_path)
    assert got.count() == events.select("event_id").distinct().count()


def test_batches_are_cleaned_and_rewritten(spark, tmp_path):
    q = refine.per_batch(stream(spark), lambda b: cleaning.clean(b.select("event_id", "event_type", "value"))[0], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{SF}/events.parquet").count()
