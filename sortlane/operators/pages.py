"""Pages of large tables without skipping rows.

``store`` writes a table in order, dealt by ranges into folders, and counts each folder's rows; ``page`` adds
up the counts to see which folders hold a page (one or two) and reads those alone.  ``after`` goes on
behind a row, as a user does who turns pages one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _directed(columns: Sequence[str]) -> list[Column]:
    """``-name`` for falling order."""
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in columns]


def store(df: DataFrame, path: str, order: Sequence[str], parts: int | None = None) -> None:
    """Write ``df`` in ``order`` (column names, ``-`` before falling ones) and the counts of its parts."""
    columns = _directed(order)
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/rows")
    counts = df.sparkSession.read.schema("part int").parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")


def page(spark: SparkSession, path: str, schema, order: Sequence[str], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; empty beyond the last one."""
    end = F.sum("n").over(Window.orderBy("part"))
    first, last = size * number, size * (number + 1)
    counts = spark.read.schema("part int, n long").parquet(f"{path}/counts").withColumn("end", end)  # a row a part
    held = counts.where((F.col("end") > first) & (F.col("end") - F.col("n") < last)).select("part", (F.col("end") - F.col("n")).alias("begin")).collect()
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/part={r.part}" for r in held)) if held else spark.createDataFrame([], schema)
    skipped = first - min((r.begin for r in held), default=first)
    return rows.orderBy(*_directed(order)).offset(skipped).limit(size).select(*schema.fieldNames())


def after(df: DataFrame, order: Sequence[str], row: dict | None, size: int) -> DataFrame:
    """The ``size`` rows behind ``row`` (its values of the order's columns, none of them null); the first page without one.

    The condition on the first column reaches the scan, so files and row groups before it are not read.
    """
    if row:
        names = [c.lstrip("-") for c in order]
        beyond = [F.col(n) < F.lit(row[n]) if c[0] == "-" else F.col(n) > F.lit(row[n]) for c, n in zip(order, names, strict=True)]
        first = F.col(names[0]) <= F.lit(row[names[0]]) if order[0][0] == "-" else F.col(names[0]) >= F.lit(row[names[0]])
        later, same = F.lit(False), F.lit(True)
        for n, b in zip(names, beyond, strict=True):
            later, same = later | (same & b), same & (F.col(n) == F.lit(row[n]))
        df = df.where(first & later)
    return df.orderBy(*_directed(order)).limit(size)
