"""Operators over event order: latest state, runs, debouncing, cool-downs, sessions, as-of.

One robot may send a large part of all rows, so no window takes the whole of a key.  Rows are dealt
into blocks of a key and a span of its order (BLOCK_SECONDS of time, BLOCK_NUMBERS of a
number).  What a block leaves behind is summed up in one small row (the last value, the length of a run);
a prefix over these rows tells what holds before each block; and a row with that joins the block, which is
then worked through like a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALL = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)
#: The span of a block: a task holds what a key sends in it.
BLOCK_SECONDS, BLOCK_NUMBERS = 86_400, 100_000


def in_blocks(df: DataFrame, order: list[str], size: float | None = None) -> DataFrame:
    """``df`` with ``__block``, by the first column of ``order`` (in spans of ``size``, if given); rows without a value come before all others."""
    first = F.col(order[0])
    kind = df.schema[order[0]].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        number = F.floor(first.cast("timestamp").cast("double") / (size or BLOCK_SECONDS))
    else:
        number = F.floor(first / (size or BLOCK_NUMBERS))
    return df.withColumn("__block", F.coalesce(number.cast("long"), F.lit(-(1 << 62))))


def _along(key: str, *more: str) -> Window:
    """The small rows of a key, one a block, in the order of the blocks."""
    return Window.partitionBy(key, *more).orderBy("__block")


def _led(rows: DataFrame, leading: DataFrame) -> DataFrame:
    """``rows`` and, at the head of its block, each row of ``leading`` (``__kind`` 0)."""
    return rows.withColumn("__kind", F.lit(1)).unionByName(leading.withColumn("__kind", F.lit(0)), allowMissingColumns=True)


def _in_block(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key, "__block").orderBy("__kind", *order)


def _streaks(rows: DataFrame, key: str, order: list[str], hit: Column, name: str) -> DataFrame:
    """Rows where ``hit`` holds, with ``name``: the place in the run of such rows."""
    rows = in_blocks(rows.withColumn("__hit", F.coalesce(hit, F.lit(False))), order)
    inside = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(*_ALL)
    runs = rows.withColumn("__run", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(inside))
    last = runs.groupBy(key, "__block", "__run").agg(F.count_if("__hit").alias("n")).groupBy(key, "__block").agg(F.max("__run").alias("ended"), F.max_by("n", "__run").alias("n"))
    # a block without an end lengthens the run before it
    open_ = last.withColumn("g", F.sum(F.when(F.col("ended") > 0, 1).otherwise(0)).over(_along(key).rowsBetween(*_ALL)))
    after = open_.withColumn("after", F.sum("n").over(_along(key, "g").rowsBetween(*_ALL)))
    before = after.select(key, "__block", F.lag("after", 1, 0).over(_along(key)).alias("__before")).where("__before > 0")
    led = _led(runs, before)
    carried = F.coalesce(F.max("__before").over(Window.partitionBy(key, "__block")), F.lit(0))
    led = led.withColumn("__carried", F.when(F.col("__run") == 0, carried).otherwise(0)).where(F.col("__hit") & (F.col("__kind") == 1))
    nth = F.row_number().over(Window.partitionBy(key, "__block", "__run").orderBy(*order))
    return led.withColumn(name, (nth + F.col("__carried")).cast("long")).drop("__hit", "__block", "__run", "__kind", "__before", "__carried")


def debounced(frames: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """Frames that fire: every ``n``-th hit in a run.  A miss or blurry frame ends the
    run, a skipped frame (no picture, detector error) does not."""
    rows = frames.where(F.col("outcome") != "skip")
    return _streaks(rows, key, order, F.col("outcome") == "hit", "streak").where(F.col("streak") % n == 0)


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, longest: int) -> DataFrame:
    """The event at which a run of failures first exceeds ``longest``."""
    return _streaks(events, key, order, failed, "failures").where(F.col("failures") == longest + 1)


def changes(df: DataFrame, key: str, order: list[str], value: str, first: str | None = None) -> DataFrame:
    """Rows whose value differs from the one before (``first`` before the first row)."""
    rows = in_blocks(df, order)
    last = rows.groupBy(key, "__block").agg(F.max_by(value, F.struct(*order)).alias(value))
    before = last.select(key, "__block", F.lag(value).over(_along(key)).alias(value), F.lag(F.lit(1)).over(_along(key)).alias("some")).where("some = 1").drop("some")
    led = _led(rows, before).withColumn("previous", F.lag(value, 1, first).over(_in_block(key, order)))
    return led.where((F.col("__kind") == 1) & ~F.col("previous").eqNullSafe(F.col(value))).drop("__kind", "__block")


def filled(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Partial updates: each column keeps its last non-null value."""
    rows = in_blocks(df, order)
    last = rows.groupBy(key, "__block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))
    before = last.select(key, "__block", *(F.last(c, ignorenulls=True).over(_along(key).rowsBetween(*_BEFORE)).alias(c) for c in columns))
    inside = _in_block(key, order).rowsBetween(*_ALL)
    led = _led(rows, before.where(reduce(Column.__or__, (F.col(c).isNotNull() for c in columns))))
    return led.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).where("__kind = 1").drop("__kind", "__block")


def carried(df: DataFrame, key: str, order: list[str], value: str, first: str) -> DataFrame:
    """Null values replaced by the last known one."""
    return filled(df, key, order, [value]).withColumn(value, F.coalesce(value, F.lit(first)))


def latched(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """``latched``: has ``flag`` been true so far?"""
    rows = in_blocks(df, order).withColumn("latched", F.col(flag))
    last = rows.groupBy(key, "__block").agg(F.max(flag).alias("latched"))
    before = last.select(key, "__block", F.max("latched").over(_along(key).rowsBetween(*_BEFORE)).alias("latched")).where("latched is not null")
    led = _led(rows, before).withColumn("latched", F.max("latched").over(_in_block(key, order).rowsBetween(*_ALL)))
    return led.where("__kind = 1").drop("__kind", "__block")


def places(df: DataFrame, key: str, order: list[str], name: str, size: float | None = None) -> DataFrame:
    """``df`` with ``name``: the place (from 1) among the rows of its key, in ``order``."""
    rows = in_blocks(df, order, size)
    counts = rows.groupBy(key, "__block").agg(F.count("*").alias("n"))
    before = counts.select(key, "__block", F.sum("n").over(_along(key).rowsBetween(*_BEFORE)).alias("__before")).where("__before > 0")
    earlier = F.coalesce(F.max("__before").over(Window.partitionBy(key, "__block")), F.lit(0))
    led = _led(rows, before).withColumn("__before", earlier).where("__kind = 1")
    nth = F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order))
    return led.withColumn(name, nth + F.col("__before")).drop("__kind", "__block", "__before")


def sessions(df: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """``key, start, end, n``: a gap of more than ``gap_seconds`` begins a new session."""
    order = ["ts", "event_id"]
    rows = in_blocks(df.select(key, *order), order).withColumn("__s", F.col("ts").cast("timestamp").cast("double"))
    last = rows.groupBy(key, "__block").agg(F.max("__s").alias("__s"))
    before = last.select(key, "__block", F.lag("__s").over(_along(key)).alias("__s")).where("__s is not null")
    led, inside = _led(rows, before), _in_block(key, order)
    new = F.coalesce(F.col("__s") - F.lag("__s").over(inside) > gap_seconds, F.lit(True)).cast("int")
    own = led.withColumn("__new", F.when(F.col("__kind") == 1, new).otherwise(0)).withColumn("__nth", F.sum("__new").over(inside.rowsBetween(*_ALL))).where("__kind = 1")
    parts = own.groupBy(key, "__block", "__nth").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    # sessions that earlier blocks have begun; the first part of a block may belong to the last of them
    begun = parts.groupBy(key, "__block").agg(F.max("__nth").alias("__nth"))
    earlier = begun.select(key, "__block", F.sum("__nth").over(_along(key).rowsBetween(*_BEFORE)).alias("__begun")).where("__begun > 0")
    numbered = _led(parts, earlier).withColumn("__begun", F.coalesce(F.max("__begun").over(Window.partitionBy(key, "__block")), F.lit(0))).where("__kind = 1")
    whole = numbered.groupBy(key, (F.col("__begun") + F.col("__nth")).alias("session"))
    return whole.agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n")).drop("session")


def cooled_down(df: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """``key, ts`` of alarms: the first candidate, then each one more than ``gap_seconds``
    after the last *alarm*.

    The rule is greedy, so a task walks through the sorted candidates of a key and jumps from
    alarm to alarm; it holds one batch and the last alarm, however many candidates a key has.
    """
    rows = df.select(key, "ts").where(F.col("ts").isNotNull())
    gap = int(gap_seconds * 1_000_000)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), 0
        for b in batches:
            keys, ts, fired = b.column(0).to_pylist(), b.column(1).cast(pa.int64()).to_numpy(), []
            new = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for lo, hi in zip(new[:-1], new[1:], strict=True):
                at = lo
                if keys[lo] == now:
                    at += int(np.searchsorted(ts[lo:hi], last + gap, side="right"))
                now = keys[lo]
                while at < hi:
                    fired.append(at)
                    last = int(ts[at])
                    at += int(np.searchsorted(ts[at:hi], last + gap, side="right"))
            yield b.take(pa.array(fired, pa.int64()))

    ordered = rows.repartition(key).sortWithinPartitions(key, "ts")
    return ordered.mapInArrow(walk, rows.schema)


def mode_as_of(commands: DataFrame, modes: DataFrame, key: str, first: str = "manual") -> DataFrame:
    """Commands with the mode in force then, and whether their source equals it.

    Both logs are merged in time order and the last mode is carried forward, so
    no range join is needed.  A change at the same time counts before the command.
    """
    log = modes.select(key, "ts", F.lit(0).alias("kind"), F.col("event_id"), F.col("mode"), F.lit(None).cast("string").alias("source"))
    log = log.unionByName(commands.select(key, "ts", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("string").alias("mode"), "source"))
    out = carried(log, key, ["ts", "kind", "event_id"], "mode", first).where("kind = 1").drop("kind")
    return out.withColumn("accepted", F.col("source") == F.col("mode"))
