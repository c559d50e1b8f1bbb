"""Operators over event order in blocks, against plain loops: one robot sends nearly everything."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sortlane.operators import sequence

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng, rows, now = random.Random(6), [], 0
    for i in range(4000):
        now += rng.choice([0, 1, 5, 40, 700, 9000])
        robot = 1 if rng.random() < 0.9 else rng.choice([2, 3, None])
        outcome = rng.choices(["hit", "skip", "miss", None], [12, 2, 1, 1])[0]
        rows.append((i, robot, START + datetime.timedelta(seconds=now) if rng.random() > 0.002 else None, outcome, rng.choice([None, None, "a", "b"]), rng.choice([None, None, None, 1.5, 2.5]), rng.random() < 0.002))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "event_id long, robot_id long, ts timestamp_ntz, outcome string, mode string, volt double, flag boolean").repartition(4).cache()


@pytest.fixture(params=[86_400, 3_000, 10], autouse=True)
def span(request, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK_SECONDS", request.param)


ORDER = ["ts", "event_id"]


def by_robot(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts is not None, r.ts or START, r.event_id)):
        out.setdefault(r.robot_id, []).append(r)
    return out


def test_debounce_and_failures(spark, log):
    want, failures = set(), set()
    for rows in by_robot(log).values():
        n = m = 0
        for r in rows:
            m = m + 1 if r.outcome == "hit" else 0
            if m == 6:
                failures.add(r.event_id)
            if r.outcome in (None, "skip"):
                continue
            n = n + 1 if r.outcome == "hit" else 0
            if n and n % 3 == 0:
                want.add((r.event_id, n))
    got = sequence.debounced(log, "robot_id", ORDER)
    assert {(r.event_id, r.streak) for r in got.collect()} == want and got.columns == [*log.columns, "streak"]
    assert {r.event_id for r in sequence.failure_runs(log, "robot_id", ORDER, F.col("outcome") == "hit", 5).collect()} == failures


def test_changes_and_carried_values(spark, log):
    moved, kept, flags = set(), set(), set()
    for rows in by_robot(log).values():
        before, mode, volt, flag = "first", None, None, None
        for r in rows:
            if r.outcome != before:
                moved.add((r.event_id, before))
            before, mode, volt = r.outcome, mode if r.mode is None else r.mode, volt if r.volt is None else r.volt
            flag = flag or r.flag
            kept.add((r.event_id, mode, volt))
            flags.add((r.event_id, flag))
    assert {(r.event_id, r.previous) for r in sequence.changes(log, "robot_id", ORDER, "outcome", "first").collect()} == moved
    assert {(r.event_id, r.mode, r.volt) for r in sequence.filled(log, "robot_id", ORDER, ["mode", "volt"]).collect()} == kept
    assert {(r.event_id, r.latched) for r in sequence.latched(log, "robot_id", ORDER, "flag").collect()} == flags
    assert {(r.event_id, r.mode) for r in sequence.carried(log, "robot_id", ORDER, "mode", "none").collect()} == {(e, m or "none") for e, m, _ in kept}


def test_places(spark, log):
    want = {(r.event_id, i + 1) for rows in by_robot(log).values() for i, r in enumerate(rows)}
    assert {(r.event_id, r.at) for r in sequence.places(log, "robot_id", ORDER, "at").collect()} == want
    numbers = log.withColumn("y", F.pmod("event_id", F.lit(37)))
    for size in (1, 10, None):
        got = {}
        for r in sequence.places(numbers, "robot_id", ["y", "event_id"], "at", size).collect():
            got.setdefault(r.robot_id, []).append((r["at"], r.y, r.event_id))
        assert all([x[0] for x in sorted(g)] == list(range(1, len(g) + 1)) and [x[1:] for x in sorted(g)] == sorted(x[1:] for x in g) for g in got.values())


def test_sessions(spark, log):
    want = []
    for robot, rows in by_robot(log.where("ts is not null")).items():
        open_ = []
        for r in rows:
            if not open_ or (r.ts - open_[-1]).total_seconds() > 700:
                if open_:
                    want.append((robot, open_[0], open_[-1], len(open_)))
                open_ = []
            open_.append(r.ts)
        want.append((robot, open_[0], open_[-1], len(open_)))
    assert sorted(map(tuple, sequence.sessions(log.where("ts is not null"), "robot_id", 700).collect()), key=str) == sorted(want, key=str)


def test_mode_as_of(spark, log):
    commands = log.where("outcome = 'hit'").select("event_id", "robot_id", "ts", F.coalesce("mode", F.lit("manual")).alias("source"))
    modes = log.where("outcome = 'miss'").select("event_id", "robot_id", "ts", F.lit("a").alias("mode"))
    want = set()
    for rows in by_robot(log).values():
        changes = [r for r in rows if r.outcome == "miss"]
        for r in rows:
            if r.outcome == "hit":
                known = [c for c in changes if c.ts is None or r.ts is not None and c.ts <= r.ts]
                mode = "a" if known else "manual"
                want.add((r.event_id, mode, (r.mode or "manual") == mode))
    assert {(r.event_id, r.mode, r.accepted) for r in sequence.mode_as_of(commands, modes, "robot_id").collect()} == want


def test_no_window_takes_a_whole_key(spark, log):
    """Windows by the key alone see one row a block: rows themselves are dealt by key and block."""
    plan = sequence.debounced(log, "robot_id", ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(robot_id" in plan and all("__block" in x for x in plan.splitlines() if "Exchange hashpartitioning(robot_id" in x and "event_id" in x)
