"""Stateful jobs over several micro-batches, with rows that arrive late."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from sortlane.operators import sequence, store
from sortlane.streaming import event_time, jobs

T0 = pd.Timestamp("2026-01-01")


def batches(spark, tmp_path, schema, *parts):
    """A stream of one file a micro-batch, in this order."""
    folder = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame([(*r[:-1], (T0 + pd.Timedelta(seconds=r[-1])).to_pydatetime()) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(folder / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return stream


FAR = 10**9


def test_debounce_over_batches(spark, tmp_path):
    schema = "robot_id long, event_id long, outcome string, ts timestamp"
    hit = lambda i, t, o="hit", robot=1: (robot, i, o, t)
    parts = [hit(1, 0), hit(2, 10)], [hit(9, 5, "miss"), hit(3, 20)], [hit(4, 30, "skip"), hit(6, 50), hit(5, 40), hit(7, 60), hit(8, 7, "hit", 2)], [(None, None, None, FAR)]
    got = sorted((r.event_id, r.streak) for r in jobs.run(event_time.debounced(batches(spark, tmp_path, schema, *parts), late="30 seconds"), "append", jobs.ROCKS).collect())
    assert got == [(5, 3)]  # the miss at 5 s came after the hit at 10 s, but counts at its place


def test_state_of_silent_robots_goes(spark, tmp_path):
    schema = "robot_id long, event_id long, outcome string, ts timestamp"
    parts = [(1, 1, "hit", 0), (1, 2, "hit", 10), (2, 1, "hit", 0)], [(3, 1, "hit", 500)], [(1, 3, "hit", 400), (2, 2, "hit", 500), (1, 4, "hit", 700)], [(None, None, None, FAR)], [(None, None, None, 2 * FAR)]
    seen = []

    def keep(rows, batch):
        seen.extend(tuple(r) for r in rows.collect())

    folder = str(tmp_path / "c")
    stream = event_time.debounced(batches(spark, tmp_path, schema, *parts), n=2, late="150 seconds", forget_seconds=300)
    query = jobs.started(stream.writeStream.option("checkpointLocation", folder).foreachBatch(keep), spark, jobs.ROCKS)
    assert sorted(seen) == [(1, 2, 2), (1, 4, 2)]  # robot 1 begins anew after 390 s of silence
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 0


def test_cooldown_over_batches(spark, tmp_path):
    schema = "robot_id long, event_id long, ts timestamp"
    parts = [(1, 1, 100), (1, 2, 105)], [(1, 3, 90), (1, 4, 108)], [(1, 5, 125), (1, 6, 111), (2, 7, 103)], [(None, None, FAR)]
    rows = jobs.run(event_time.cooled_down(batches(spark, tmp_path, schema, *parts), 10, "30 seconds"), "append", jobs.ROCKS).collect()
    assert sorted((r.robot_id, (r.ts - T0).total_seconds()) for r in rows) == [(1, 90.0), (1, 105.0), (1, 125.0), (2, 103.0)]


def test_shuffled_streams_equal_their_batch_twins(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), T0.to_pydatetime() + datetime.timedelta(seconds=rng.randrange(100_000)), rng.choice(["hit", "hit", "hit", "skip", "miss"])) for i in range(1500)]
    frames = spark.createDataFrame(rows, "event_id long, robot_id long, ts timestamp, outcome string")
    replay = lambda df: jobs.replayed(df, batches=7, lateness=9000)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    got = jobs.run(event_time.debounced(replay(frames)), "append", jobs.ROCKS)
    assert key(got, "robot_id", "event_id", "streak") == key(sequence.debounced(frames, "robot_id", ["ts", "event_id"]), "robot_id", "event_id", "streak")
    got = jobs.run(event_time.cooled_down(replay(frames), 800), "append", jobs.ROCKS)
    assert key(got, "robot_id", "ts") == key(sequence.cooled_down(frames, "robot_id", 800), "robot_id", "ts")
    got = jobs.run(jobs.heartbeat_sessions(replay(frames.drop("outcome")), 300, "3 hours"), "append")
    assert key(got, "robot_id", "start_ts", "end_ts", "n") == key(sequence.sessions(frames, "robot_id", 300), "robot_id", "start_ts", "end_ts", "n")


def test_late_days_are_merged_into_their_sketches(spark):
    rows = [(i, T0.to_pydatetime() + datetime.timedelta(seconds=i * 13), float(i % 7) / 7, i % 50, f"p{i % 4000}", f"r{i % 9}") for i in range(20_000)]
    scans = spark.createDataFrame(rows, "scan_id long, ts timestamp, confidence double, processing_time_ms int, tracking_id string, rider_id string")
    got = {r.scan_date: r for r in jobs.daily(jobs.replayed(scans, batches=3, lateness=90_000, key="scan_id", end=False)).collect()}
    exact = {r.scan_date: r for r in store.daily_statistics(scans).collect()}
    assert got.keys() == exact.keys()
    for day, r in got.items():
        x = exact[day]
        assert (r.total_scans, r.avg_confidence, r.unique_riders) == (x.total_scans, x.avg_confidence, x.unique_riders)
        assert abs(r.unique_parcels - x.unique_parcels) <= 0.03 * x.unique_parcels


def test_cooldown_of_a_long_run(spark):
    rows = spark.range(30000).select(F.lit(1).alias("robot_id"), F.timestamp_seconds(F.col("id")).alias("ts")).unionByName(spark.createDataFrame([(2, None)], "robot_id int, ts timestamp"))
    got = sorted(int(r.ts.timestamp()) for r in sequence.cooled_down(rows, "robot_id", 9).collect())
    assert got == list(range(0, 30000, 10))
    assert sequence.cooled_down(rows.limit(0), "robot_id", 9).count() == 0
