from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators.state import latest_per_key
from lodestone.streaming import folds

SF = "/root/testdata/sf0.001"


def staged(spark, tmp_path, n):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).select("event_id", "at", "user_id", "event_type", "value")
    events.repartition(n).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_counts_equal_the_batch(spark, tmp_path):
    events, stream = staged(spark, tmp_path, 3)
    how = ("at", ["event_type"], "1 hour", "400 days")
    got = run(folds.windowed_counts(stream, *how), "counts", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.windowed_counts(events, *how).collect()))


def test_append_log_gives_the_latest_per_key(spark, tmp_path):
    events, stream = staged(spark, tmp_path, 3)
    folds.append_log(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    kept = ["user_id", "event_id", "value"]
    got = latest_per_key(spark.read.parquet(str(tmp_path / "log")).select(*kept), ["user_id"], "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latest_per_key(events.select(*kept), ["user_id"], "event_id").collect()))


def test_ttl_map_ends_entries(spark, tmp_path):
    t = datetime(2024, 1, 1)
    batches = [[("a", 1, "x", t), ("b", 2, "y", t)], [("a", 3, "z", t + timedelta(seconds=50))], [("c", 4, "w", t + timedelta(seconds=300))], [("c", 3, "older", t + timedelta(seconds=301))], [("d", 5, "v", t + timedelta(seconds=302))]]
    schema = "k string, seq long, v string, at timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "all" / f"n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "all"))
    got = run(folds.ttl_map(stream, "k", "seq", "v", "at", 100, "0 seconds"), "ttl", "update")
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == {("a", 1, "x", True), ("b", 2, "y", True), ("a", 3, "z", True), ("c", 4, "w", True), ("d", 5, "v", True), ("a", 3, "z", False), ("b", 2, "y", False)}
    assert len(rows) == 7
