"""Rules over event order on streams whose rows come in any order within the watermark.

Keys are dealt into ``BUCKETS`` buckets by a hash, and a bucket is one key of the state, so that a call into Python
serves thousands of robots at once.  A bucket's rows wait in its state, a micro-batch as one Arrow block, until the watermark has passed
them; a timer of event time then hands them on in order, robot by robot.  What the rule needs to remember of a robot (the
length of a run, the last alarm) is a row of a second block.  After ``forget`` of event time without a row, a robot's
memory goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Groups of keys in the state.  A stream that goes on from a checkpoint must keep the number.
BUCKETS = 512


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_all().to_pandas(integer_object_nulls=True)


class InOrder(StatefulProcessor):
    """Subclasses set ``columns`` (after robot, time and id), ``memory`` and ``out``, and define ``walk``."""

    columns: tuple[str, ...] = ()
    memory: tuple[str, ...] = ("last",)
    out: dict[str, str] = {}

    def __init__(self, forget_seconds: float):
        self.forget = int(forget_seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.known = handle.getListState("waiting", "block binary"), handle.getValueState("known", "block binary")
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, at: int) -> None:
        """Have the one timer of this bucket fire at ``at``."""
        if self.alarm.exists():
            before = self.alarm.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            own = part.loc[part["some"], ["robot_id", "us", "event_id", *self.columns]]
            if len(own):
                self.waiting.appendValue((_packed(own),))
                low = _millis(int(own["us"].min()))
                first = low if first is None else min(first, low)
        if first is not None and (not self.alarm.exists() or self.alarm.get()[0] > first):
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        known = _unpacked(self.known.get()[0]) if self.known.exists() else pd.DataFrame({c: np.empty(0, "int64") for c in ("robot_id", *self.memory)})
        blocks = [_unpacked(b[0]) for b in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(blocks, ignore_index=True) if blocks else None
        passed = None if rows is None else rows["us"] <= now * 1000
        ready = None if rows is None else rows[passed].sort_values(["robot_id", "us", "event_id"], kind="stable", ignore_index=True)
        if ready is not None and len(ready):
            before = dict(zip(known["robot_id"].tolist(), zip(*(known[c].tolist() for c in self.memory), strict=True), strict=True))
            fired = self.walk(ready, before)
            known = pd.DataFrame([(k, *v) for k, v in before.items()], columns=["robot_id", *self.memory]).astype("int64")
        else:
            fired = []
        known = known[known["last"] + self.forget > now * 1000]  # nothing has come for long
        if len(known):
            self.known.update((_packed(known),))
        else:
            self.known.clear()
        rest = None if rows is None else rows[~passed]
        if rest is not None and len(rest):
            self.waiting.put([(_packed(rest),)])
            self._wake(max(_millis(int(rest["us"].min())), now + 1))
        else:
            self.waiting.clear()
            if len(known):
                self._wake(max(_millis(int(known["last"].max()) + self.forget), now + 1))
        if fired:
            yield pd.DataFrame(fired, columns=list(self.out)).astype(self.out)

    def walk(self, ready: pd.DataFrame, known: dict[int, tuple[int, ...]]) -> list[tuple]:
        """What fires among ``ready`` (in order, robot by robot); ``known`` is brought up to date."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _millis(us: int) -> int:
    """A time in microseconds as milliseconds, rounded up: the watermark is then never before it."""
    return -(-us // 1000)


class Debounce(InOrder):
    columns, memory = ("outcome",), ("streak", "last")
    out = {"robot_id": "int64", "event_id": "object", "streak": "int64"}

    def __init__(self, n: int, forget_seconds: float):
        super().__init__(forget_seconds)
        self.n = n

    def walk(self, ready, known):
        fired, robot, streak, last = [], None, 0, 0
        for r, us, event_id, outcome in zip(*(ready[c].tolist() for c in ("robot_id", "us", "event_id", "outcome")), strict=True):
            if r != robot:
                if robot is not None:
                    known[robot] = (streak, last)
                robot, (streak, last) = r, known.get(r, (0, us))
            if us - last > self.forget:
                streak = 0
            last = us
            if outcome == "hit":
                streak += 1
                if streak % self.n == 0:
                    fired.append((r, event_id, streak))
            elif outcome is not None and outcome != "skip":
                streak = 0
        known[robot] = (streak, last)
        return fired


class CoolDown(InOrder):
    """A pause of the gap's length ends what an alarm forbids, so it is forgotten then."""

    out = {"robot_id": "int64", "us": "int64"}

    def walk(self, ready, known):
        fired, robot, last = [], None, None
        for r, us in zip(ready["robot_id"].tolist(), ready["us"].tolist(), strict=True):
            if r != robot:
                robot, (last,) = r, known.get(r, (None,))
            if last is None or us - last > self.forget:
                last = us
                known[r] = (us,)
                fired.append((r, us))
        return fired


def _in_buckets(stream: DataFrame, late: str, *columns: str):
    """The rows that have a time, grouped by bucket, with the time in microseconds (``us``); ``some``: has it a robot?"""
    rows = stream.where("ts is not null").select("robot_id", "ts", "event_id", *columns).withWatermark("ts", late)
    some = F.col("robot_id").isNotNull()  # pandas would make floats of ids among nulls
    rows = rows.select("*", F.unix_micros("ts").alias("us"), some.alias("some"), F.pmod(F.xxhash64("robot_id"), F.lit(BUCKETS)).alias("bucket"))
    return rows.withColumn("robot_id", F.coalesce("robot_id", F.lit(0))).groupBy("bucket")


def debounced(stream: DataFrame, n: int = 3, late: str = "3 hours", forget_seconds: float = 90 * 86_400) -> DataFrame:
    """``robot_id, event_id, streak``: every ``n``-th hit of a run, as in the batch rule.  Rows without a time go.

    A run that pauses for more than ``forget_seconds`` begins anew; its state has gone by then.
    """
    return _in_buckets(stream, late, "outcome").transformWithStateInPandas(Debounce(n, forget_seconds), "robot_id long, event_id long, streak long", "append", "eventtime")


def cooled_down(stream: DataFrame, gap_seconds: float, late: str = "3 hours") -> DataFrame:
    """``robot_id, ts``: an alarm, then none until more than ``gap_seconds`` after it, as in the batch rule."""
    alarms = _in_buckets(stream, late).transformWithStateInPandas(CoolDown(gap_seconds), "robot_id long, us long", "append", "eventtime")
    return alarms.select("robot_id", F.timestamp_micros("us").alias("ts"))
