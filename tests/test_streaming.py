from pyspark.sql import functions as F

from tidemark.streaming import recurrent


def rows(spark):
    data = [(f"s{i % 3}", i, i, None if i % 7 == 0 else float((i * 37) % 50)) for i in range(240)]
    return spark.createDataFrame(data, "series string, ts long, event_id long, x double")


def test_stream_equals_batch(spark, tmp_path):
    df = rows(spark)
    batch = sorted((r.event_id, r.level, r.gain) for r in recurrent.filtered(df).collect() if r.level is not None)
    for k in range(3):
        df.filter((F.col("ts") >= 80 * k) & (F.col("ts") < 80 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    q = recurrent.filtered_stream(stream).writeStream.format("memory").queryName("levels").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.event_id, r.level, r.gain) for r in spark.table("levels").collect() if r.level is not None)
    assert got == batch and len(got) > 150


def test_the_past_does_not_see_the_future(spark):
    df = rows(spark)
    changed = df.withColumn("x", F.when(F.col("ts") < 120, F.col("x")).otherwise(1e12))
    early = lambda d: sorted((r.event_id, r.level, r.gain) for r in recurrent.filtered(d).collect() if r.event_id < 120 and r.level is not None)
    assert early(df) == early(changed)
