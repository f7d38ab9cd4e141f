import random

from pyspark.sql import functions as F

from rivaq.operators import admission
from rivaq.streaming import admission as streaming


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = sorted((r.randrange(0, 90000), i) for i in range(200))
    rows = [(s, i, r.choice("aab")) for s, i in rows]
    schema = "s long, i long, ip string"
    for n in range(4):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = spark.read.parquet(str(tmp_path / "in"))
    want = {(x.anahtar, x.sira, x.bas, x.sayi, x.asildi) for x in admission.anchored(calls, "ip", "ts", "i", limit=4).collect()}
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    got = {(x.anahtar, x.sira, x.bas, x.sayi, x.asildi) for x in run(streaming.anchored(stream, "ip", "ts", "i", limit=4), spark, "calls_stream")}
    assert got == want


def test_hourly_calls_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "/a"), (1, "2024-01-01 00:10:00", "/a"), (2, "2024-01-01 00:50:00", "/a"), (3, "2024-01-01 01:00:00", "/b"), (4, "2024-02-01 00:00:00", "/z")]
    spark.createDataFrame(rows, "req_id long, t string, path string").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("req_id long, t string, path string, ts timestamp").parquet(str(tmp_path / "in"))
    got = {(str(x.bas), x.path, x.n) for x in run(streaming.hourly_calls(stream, "ts", "path", "req_id"), spark, "hours", "complete")}
    assert ("2024-01-01 00:00:00", "/a", 2) in got and ("2024-01-01 01:00:00", "/b", 1) in got


def test_daily_stream_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = sorted((r.randrange(0, 3 * 86400), i) for i in range(200))
    rows = [(s, i, r.choice(["a", "a", "b", None])) for s, i in rows]
    for n in range(4):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], "s long, i long, c string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = spark.read.parquet(str(tmp_path / "in"))
    want = {(x.c or "anon", str(x.gun), x.i, x.sayi, x.kalan) for x in admission.daily_numbers(calls, "c", "ts", "i", limit=4).collect()}
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    got = {(x.anahtar, str(x.gun), x.sira, x.sayi, x.kalan) for x in run(streaming.daily_numbers(stream, "c", "ts", "i", limit=4), spark, "daily_stream")}
    assert got == want
