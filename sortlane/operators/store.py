"""Scan-store operators: look-ups, pages, checks, statistics, appends with rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable
from .selection import at_places

RECENT = ("scan_id", "tracking_id", "ts", "confidence", "engine")
DETAIL = ("scan_id", "tracking_id", "order_id", "rider_id", "buyer_name", "buyer_address", "weight_g", "quantity", "payment_type", "confidence", "engine")


def successful(scans: DataFrame, least: float = 0.7) -> DataFrame:
    columns = ("scan_id", "tracking_id", "order_id", "rider_id", "buyer_name", "confidence", "engine", "ts")
    return scans.where(F.col("confidence") > least).select(*columns).orderBy(F.desc("ts"), F.desc("scan_id"))


def by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.where(F.col("scan_id") == scan_id)


def by_tracking(scans: DataFrame, tracking_id: str) -> DataFrame:
    return scans.where(F.col("tracking_id") == tracking_id).select(*DETAIL)


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column holds ``term``, without regard to case; ``term`` is taken literally."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return df.where(found)


def check_errors() -> Column:
    """Names of the broken rules of a scan."""
    bad = lambda c: F.when(F.col(c) < 0, F.lit(f"negative {c}"))
    outside = F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence outside 0 to 1"))
    return F.array_compact(F.array(outside, bad("weight_g"), bad("quantity"), bad("processing_time_ms")))


def checked(scans: DataFrame) -> DataFrame:
    return scans.withColumn("errors", check_errors()).withColumn("valid", F.size("errors") == 0)


def needs_review(order_found: Column) -> Column:
    missing = F.lit(False)
    for c in ("buyer_name", "buyer_address", "weight_g", "quantity"):
        missing = missing | F.col(c).isNull()
    return F.when(F.col("tracking_id").isNull(), True).when(order_found, False).when(F.coalesce("confidence", F.lit(0.0)) < 0.7, True).otherwise(missing)


def recent(scans: DataFrame, limit: int = 50) -> DataFrame:
    """The newest scans, at least 1 and at most 1000."""
    return scans.orderBy(F.desc("ts"), F.desc("scan_id")).limit(max(1, min(1000, limit))).select(*RECENT)


def page_counts(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(condition).alias("filtered"))


def daily_statistics(scans: DataFrame, exact: bool = True) -> DataFrame:
    """Figures of each day.  ``exact=False`` counts distinct ids with sketches, for very large days."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return scans.groupBy(F.to_date("ts").alias("scan_date")).agg(
        F.count("*").alias("total_scans"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.avg("processing_time_ms"), 6).alias("avg_processing_time"),
        distinct("tracking_id").alias("unique_parcels"),
        distinct("rider_id").alias("unique_riders"),
    )


def newest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def accepted(new: DataFrame, stored: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """New rows with ``reason``: null where the row may be appended.

    Broken rules come first, then a key that the store has, then a key that occurs
    earlier among the new rows.  A null time becomes ``now``.
    """
    rows = new if now is None else new.withColumn("ts", F.coalesce("ts", now))
    known = stored.select(F.col(key).alias("__k")).distinct().withColumn("__known", F.lit(True))
    rows = rows.join(known, F.col(key) == F.col("__k"), "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c) for c in new.columns)))
    broken = F.size(check_errors()) > 0 if "confidence" in new.columns else F.lit(False)
    reason = F.when(broken, "check").when(F.col("__known"), "duplicate").when(F.col("__nth") > 1, "duplicate in batch")
    return rows.withColumn("__nth", nth).withColumn("reason", reason).drop("__k", "__known", "__nth")


def append(new: DataFrame, table: VersionedTable, batch: str, key: str, now: Column | None = None) -> DataFrame:
    """Append the new rows that ``accepted`` lets pass, all of them or none; returns the rejected ones.

    A batch that is run again changes nothing, and of two writers that bring the same key one is rejected.
    """
    return table.append(new, batch, lambda rows, stored: accepted(rows, stored, key, now))


def upserted(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Stored and new rows with the row of the largest ``order`` for each key."""
    return newest(stored.unionByName(new), [key], F.desc(order))


def purge_counts(df: DataFrame, column: str) -> DataFrame:
    empty = F.col(column).isNull() | (F.col(column) == "")
    return df.agg(F.count("*").alias("before"), F.count_if(empty).alias("deleted"), F.count_if(~empty).alias("after"))


def purged(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def without(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def evicted(files: DataFrame, folder: str, n: int, *order: Column) -> DataFrame:
    """Rows beyond the newest ``n`` of each folder."""
    w = Window.partitionBy(folder).orderBy(*order)
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > n)


def label_statistics(results: DataFrame) -> DataFrame:
    """Success rate, mean points of "n/7", and the sum of non-zero times over all rows."""
    points = F.try_element_at(F.split("confidence", "/"), F.lit(1)).try_cast("double")
    total = F.count("*")
    return results.agg(
        total.alias("total"),
        F.round(100.0 * F.count_if(~F.contains("status", F.lit("Failed"))) / total, 6).alias("success_rate"),
        F.round(F.avg(points), 6).alias("avg_confidence"),
        F.round(F.sum(F.when(F.col("processing_time") > 0, F.col("processing_time")).otherwise(0.0)) / total, 6).alias("avg_time"),
    )


def latency_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(group).agg(F.round(F.avg(v), 6).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def latency_report(df: DataFrame, group: str, value: str, target: float = 200.0) -> DataFrame:
    """Mean, median, 95th percentile (the sorted value at place ``int(0.95 n)``), extremes and verdict.

    Places are found by ``selection.at_places``, so a group may have any number of values.
    """
    places = lambda n: {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.floor(n * F.lit(0.95))}
    found = at_places(df, group, value, places).withColumnRenamed(group, "__g")
    figures = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = figures.join(found, F.col(group).eqNullSafe(F.col("__g")))
    verdict = F.when(F.col("p95") < target, "PASS").otherwise("FAIL").alias("verdict")
    return out.select(group, "n", "mean", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95", "min", "max", verdict)


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, value``: a row for each distinct non-empty value, as text."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.where("value <> ''").distinct()


def distinct_values(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> DataFrame:
    """``field, values``: sorted distinct non-empty values of fields with few values.

    One row holds all values of a field, so more than ``most`` are an error; ``distinct_rows`` serves such fields.
    """
    rows = distinct_rows(df, columns)
    sized = rows.groupBy("field").agg(F.count("*").alias("n"))
    large = sized.where(F.col("n") > most).select("field").limit(3).collect()
    if large:
        raise ValueError(f"more than {most} values: {', '.join(r.field for r in large)}")
    return rows.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("values"))


def manifest(labels: DataFrame, courier: str, barangay: str, district: str, amount: str) -> DataFrame:
    """Figures of a batch in all and by courier, in one pass."""
    return labels.groupingSets([[], [F.col(courier)]], F.col(courier)).agg(
        F.count("*").alias("labels"),
        F.sum("weight_g").alias("total_weight"),
        F.round(F.avg("weight_g"), 6).alias("avg_weight"),
        F.count_if(F.col("payment_type") == "COD").alias("cod_count"),
        F.sum(amount).alias("cod_sum"),
        F.countDistinct(barangay).alias("barangays"),
        F.countDistinct(district).alias("districts"),
        F.grouping(courier).alias("is_total"),
    )
