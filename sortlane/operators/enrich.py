"""Enrichment of scans with orders, look-ups, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enriched(scans: DataFrame, orders: DataFrame, keep_name: Column) -> DataFrame:
    """Scans with their order by tracking id.

    The order's name replaces the scan's unless ``keep_name``; its address, weight and
    quantity win where they can be read; order id, code and rider only fill gaps.
    Orders grow with the business, so the join's side is left to the optimizer.
    """
    o = orders.select(F.col("tracking_id").alias("o_tracking"), *(F.col(c).alias(f"o_{c}") for c in orders.columns if c != "tracking_id"))
    rows = scans.join(o, F.col("tracking_id") == F.col("o_tracking"), "left").withColumn("order_found", F.col("o_tracking").isNotNull())
    new = {
        "buyer_name": F.when(F.col("order_found") & ~F.coalesce(keep_name, F.lit(False)), F.col("o_buyer_name")).otherwise(F.col("buyer_name")),
        "buyer_address": F.coalesce(F.nullif("o_address", F.lit("")), "buyer_address"),
        "weight_g": F.coalesce(F.trim(F.replace(F.col("o_weight"), F.lit("g"), F.lit(""))).try_cast("int"), F.col("weight_g")),
        "quantity": F.coalesce(F.col("o_quantity").try_cast("int"), F.col("quantity")),
        "order_id": F.coalesce("order_id", "o_order_id"),
    }
    for own, other in (("rts_code", "o_rts_code"), ("rider_id", "o_rider")):
        if own in scans.columns:
            new[own] = F.coalesce(own, other)
    return rows.withColumns(new).drop(*o.columns)


def two_tier(wanted: DataFrame, memory: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each wanted key from the first of two tables that has it; ``source`` names it."""
    values = [c for c in memory.columns if c != key]
    m = memory.select(key, F.struct(*values).alias("__m"))
    s = stored.select(key, F.struct(*values).alias("__s"))
    rows = wanted.join(m, key, "left").join(s, key, "left")
    source = F.when(F.col("__m").isNotNull(), "memory").when(F.col("__s").isNotNull(), "store").otherwise("none")
    return rows.withColumn("__v", F.coalesce("__m", "__s")).select(*wanted.columns, source.alias("source"), *(F.col(f"__v.{c}").alias(c) for c in values))


def accuracy(scans: DataFrame, truth: DataFrame) -> DataFrame:
    """Per scan with a truth row: does each field equal it (null counts as wrong)?"""
    t = truth.dropDuplicates(["tracking_id"]).select("tracking_id", F.col("order_id").alias("t_order"), F.col("buyer_name").alias("t_name"), F.replace(F.col("weight"), F.lit("g"), F.lit("")).try_cast("int").alias("t_weight"), F.col("quantity").try_cast("int").alias("t_quantity"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return scans.join(t, "tracking_id").withColumns({"order_ok": same("order_id", "t_order"), "name_ok": same("buyer_name", "t_name"), "weight_ok": same("weight_g", "t_weight"), "quantity_ok": same("quantity", "t_quantity")})


def accuracy_by_field(rows: DataFrame, fields: list[str]) -> DataFrame:
    long = rows.select(*fields).unpivot([], fields, "field", "ok")
    return long.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"), F.round(100.0 * F.count_if("ok") / F.count("*"), 6).alias("percent"))
