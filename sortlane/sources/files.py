"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCAN_SCHEMA = T.StructType(
    [T.StructField("scan_id", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("tracking_id", "order_id", "rts_code", "rider_id", "buyer_name", "buyer_address", "payment_type", "engine", "raw_text")]
    + [T.StructField("ts", T.TimestampNTZType()), T.StructField("weight_g", T.IntegerType()), T.StructField("quantity", T.IntegerType()), T.StructField("processing_time_ms", T.IntegerType()), T.StructField("confidence", T.DoubleType())]
)
ORDER_FIELDS = ("tracking_id", "order_id", "rts_code", "rider", "buyer_name", "address", "weight", "quantity", "seller")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="sortlane-work-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_SCHEMA).parquet(path)


def read_orders(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """JSON objects of orders by image, one a file or one a line: rows without a tracking id go,
    of repeated ids the last stays: files go by name, then objects by their place in the file."""
    order = T.StructType([T.StructField(c, T.StringType()) for c in ORDER_FIELDS])
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    text = spark.read.text(path, wholetext=not by_line).select(at.alias("at"), "value")
    entries = text.select("at", F.posexplode(F.map_entries(F.from_json("value", T.MapType(T.StringType(), order)))).alias("pos", "e"))
    rows = entries.select(F.struct("at", "pos").alias("place"), F.col("e.key").alias("image"), "e.value.*").where("tracking_id IS NOT NULL AND tracking_id <> ''")
    values = [c for c in rows.columns if c not in ("place", "tracking_id")]
    return rows.groupBy("tracking_id").agg(F.max_by(F.struct(*values), "place").alias("v")).select("tracking_id", "v.*")


def image_listing(spark: SparkSession, folder: str, kinds=("png", "jpg", "jpeg", "tiff", "bmp")) -> DataFrame:
    """Image files without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "modificationTime").where(F.lower("path").rlike(r"\.(" + "|".join(kinds) + ")$"))


#: Header of the batch export (fixed values).
BATCH_HEADER = ("File", "Success", "Tracking Number", "Order ID", "Buyer Name", "Weight", "Quantity", "Error")


def batch_rows(results: DataFrame, file: Column, error: Column, fields: list[Column]) -> DataFrame:
    """The eight cells of the batch export: fields are empty where there is an error, and the reverse."""
    cell = lambda c: F.when(error.isNull(), c.cast("string"))
    cells = [file, F.when(error.isNull(), "Yes").otherwise("No"), *map(cell, fields), error]
    return results.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(h) for h, c in zip(BATCH_HEADER, cells, strict=True)))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it is read back from the Parquet files at ``path``, to which it is written."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quoteAll", True).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
