"""Exact order statistics of groups of any size.

The value at a place is looked for in a range that shrinks: sketches cut the range into about equal parts, an
exact count of each part tells which one holds the place, and the search goes on there.  Sketches only
decide how even the parts are, never the result.  Once a range holds few rows, or one value, its values are
counted and ordered; no window ever takes a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import work_folder, written
from .candidates import is_small

#: Rows of a range that may be ordered at once, and parts into which a larger one is cut.
ROWS, PARTS = 1_000_000, 256


def _joined(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (g, v) within the spans (g, lo, hi)."""
    spans = spans.withColumnRenamed("g", "of")
    return rows.join(F.broadcast(spans) if is_small(spans) else spans, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("of")


def _span() -> Window:
    return Window.partitionBy("g", "lo", "hi")


def at_places(df: DataFrame, group: str, value: str, places: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``group, n`` and a column for each entry of ``places(n)``: the value at that place (from 0) of the group's sorted values.

    Null values do not count; a null group is a group; equal values are one after the other.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    every = F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places(F.col("n")).items()))
    wanted = stats.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("within"), F.inline(every))
    folder = work_folder(spark)
    wanted, turn = written(wanted, f"{folder}/0"), 0
    open_ = (F.col("within") > ROWS) & (F.col("lo") < F.col("hi"))
    while wanted.where(open_).limit(1).count():
        turn += 1
        spans = wanted.where(open_).select("g", "lo", "hi").distinct()
        cuts = _joined(rows, spans).groupBy("g", "lo", "hi").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)]).alias("cuts"))
        inside = _joined(rows, written(cuts, f"{folder}/cuts-{turn}"))
        # a value that is a cut is a part of its own, so every turn parts a range
        part = 2 * F.size(F.filter("cuts", lambda x: x < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        parts = inside.groupBy("g", "lo", "hi", part.alias("part")).agg(F.count("*").alias("k"), F.min("v").alias("first"), F.max("v").alias("last"))
        ends = parts.withColumn("end", F.sum("k").over(_span().orderBy("part"))).withColumnsRenamed({"g": "of", "lo": "from", "hi": "to"})
        same = F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))
        place = F.col("place") - F.col("before")
        found = wanted.where(open_).join(ends, same & (F.col("end") > place) & (F.col("end") - F.col("k") <= place))
        moved = found.select("g", "n", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("before") + F.col("end") - F.col("k")).alias("before"), F.col("k").alias("within"), "name", "place")
        wanted = written(wanted.where(~open_).unionByName(moved), f"{folder}/{turn}")
    left = wanted.where("lo < hi").select("g", "lo", "hi").distinct()
    counts = _joined(rows, left).groupBy("g", "lo", "hi", "v").agg(F.count("*").alias("k"))
    ends = counts.withColumn("end", F.sum("k").over(_span().orderBy("v"))).withColumnsRenamed({"g": "of", "lo": "from", "hi": "to"})
    same = F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))
    picked = wanted.where("lo < hi").join(ends, same).where(F.col("before") + F.col("end") > F.col("place")).groupBy("g", "n", "name").agg(F.min("v").alias("v"))
    single = wanted.where("lo = hi").select("g", "n", "name", F.col("lo").alias("v"))
    names = list(places(F.lit(1)))
    out = picked.unionByName(single).groupBy("g", "n").agg(*(F.max(F.when(F.col("name") == x, F.col("v"))).alias(x) for x in names))
    return out.withColumnRenamed("g", group)
