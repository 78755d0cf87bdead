import random

from pyspark.sql import functions as F

from tidemark.streaming import ordered as O
from tidemark.streaming import recurrent


def history(n=400, seed=2):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 3)}", i * 7 + rng.randint(0, 3), i, None if rng.random() < 0.1 else float(rng.randint(0, 50)), rng.choice("xyz")) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, sec long, id long, x double, label string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("sec") + 10**9))


def plain(rows, fold, pick):
    out, state = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        state[r[0]], found = fold.step(state.get(r[0]), pick(r))
        if found is not None:
            out.append((r[0], *found))
    return sorted(out, key=str)


def test_level_out_of_order_equals_batch(spark):
    rows = history()
    df = frame(spark, rows)
    got = O.replayed(df, "k", "ts", "id", ["id", "x"], O.LevelFold(), batches=4, delay_seconds=900, jitter_seconds=800)
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows, O.LevelFold(), lambda r: (r[2], r[3])) and len(got) == len(rows)
    batch = recurrent.filtered(df.select(F.col("k").alias("series"), F.col("sec").alias("ts"), F.col("id").alias("event_id"), "x"))
    assert sorted((r.event_id, r.level, r.gain) for r in batch.collect() if r.level is not None) == sorted((r[1], r[3], r[4]) for r in got if r[3] is not None)


def test_asof_and_transitions(spark):
    rng = random.Random(5)
    rows = [(f"s{i % 3}", i * 5, i, float(i), "") for i in range(240)]
    facts = {i: (None, rng.randint(0, 9), rng.randint(0, 3), float(i)) if rng.random() < 0.7 else (i, None, None, None) for _, _, i, _, _ in rows}
    data = [(k, s, i, *facts[i]) for k, s, i, _, _ in rows]
    df = spark.createDataFrame(data, "k string, sec long, id long, decision long, session long, revision long, value double").withColumn("ts", F.timestamp_seconds(F.col("sec") + 10**9))
    got = O.replayed(df, "k", "ts", "id", ["decision", "session", "revision", "value"], O.AsofFold(), batches=3, delay_seconds=400, jitter_seconds=300)
    assert sorted(map(tuple, got.collect()), key=str) == plain(data, O.AsofFold(), lambda r: r[3:])
    rows = history(200, 7)
    got = O.replayed(frame(spark, rows), "k", "ts", "id", ["id", "label"], O.TransitionFold(), batches=3, delay_seconds=700, jitter_seconds=600)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, O.TransitionFold(), lambda r: (r[2], r[4]))


def test_late_rows_are_left_out_and_nothing_is_changed(spark, tmp_path):
    rows = history(120, 9)
    late = [("s1", 5, 900, 1e6, "x")]
    for part in [rows[:60], rows[60:], late, [(None, 10**7, 0, None, None)]]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with O.with_rocksdb(spark):
        stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = O.folded(stream, "k", "ts", "id", ["id", "x"], O.LevelFold(), "60 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").filter("k is not null").collect()
    assert sorted((r.k, r.event_id, r.before, r.level, r.gain) for r in got if r.level is not None) == sorted(r for r in plain(rows, O.LevelFold(), lambda r: (r[2], r[3])) if r[3] is not None)
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    # the caller's own state store is back
    assert spark.conf.get(O.PROVIDER, "") != O.ROCKSDB
    assert O.replayed(frame(spark, rows).limit(0), "k", "ts", "id", ["id", "x"], O.LevelFold()).collect() == []


def test_many_keys_share_few_states(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 39)}", i, i, None, rng.choice("xy")) for i in range(300)]
    for part in [rows[:150], rows[150:], [(None, 10**7, 0, None, None)]]:
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with O.with_rocksdb(spark):
        stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = O.folded(stream, "k", "ts", "id", ["id", "label"], O.TransitionFold(), "5 seconds", buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").filter("k is not null").select("k", "event_id", "from_label", "to_label", "run").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, O.TransitionFold(), lambda r: (r[2], r[4]))
    # a timer for each state that waits, not for each key
    assert 0 < max(s["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for s in p["stateOperators"]) <= 6
