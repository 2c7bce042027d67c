from pyspark.sql import functions as F

from reelquarry.streaming import events as E


def test_batch_equals_stream(spark, tmp_path):
    src = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("kind"), F.timestamp_seconds(F.col("id") * 400).alias("ts"), F.col("id").cast("double").alias("value"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = E.buckets(stream).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {tuple(r) for r in E.buckets(src).collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM buckets").collect()} == want


def test_sessions_batch(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 600, 2.0), (1, 9000, 4.0)], "user_id long, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted((r.events, r.watched) for r in E.sessions(df).collect()) == [(1, 4.0), (2, 3.0)]
