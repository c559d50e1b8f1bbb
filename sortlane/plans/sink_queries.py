"""Queries of sinks: each writes files, and its result is read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lidar, store
from ..sources import files
from ..sources.files import work_folder
from ..sources.versioned import VersionedTable
from .catalog import query

C = F.col
_NEW = "SELECT CASE WHEN scan_id % 3 = 0 THEN scan_id ELSE scan_id + 100000000 END AS scan_id, CASE WHEN scan_id % 10 = 0 THEN confidence + 1 ELSE confidence END AS confidence, weight_g, quantity, processing_time_ms, CASE WHEN scan_id % 4 = 0 THEN NULL ELSE ts END AS ts FROM scans"


@query("sink_store_scans", "scans", f"WITH n AS ({_NEW}), old AS (SELECT scan_id FROM scans) SELECT n.scan_id, coalesce(n.ts, TIMESTAMP '2026-01-01 00:00:00') AS ts, CASE WHEN confidence < 0 OR confidence > 1 THEN 'check' WHEN old.scan_id IS NOT NULL THEN 'duplicate' ELSE 'stored' END AS outcome FROM n LEFT JOIN old ON old.scan_id = n.scan_id UNION ALL SELECT scan_id, ts, 'stored' FROM scans")
def _(scans):
    """A stored table, and every scan offered again, most of them under a new id."""
    folder = work_folder(scans.sparkSession)
    new = scans.select(F.when(C("scan_id") % 3 == 0, C("scan_id")).otherwise(C("scan_id") + 100000000).alias("scan_id"), F.when(C("scan_id") % 10 == 0, C("confidence") + 1).otherwise(C("confidence")).alias("confidence"), "weight_g", "quantity", "processing_time_ms", F.when(C("scan_id") % 4 != 0, C("ts")).alias("ts"))
    table = VersionedTable(scans.sparkSession, folder, new.schema)
    table.replace(lambda _: scans.select(new.columns), "first")
    rejected = store.append(new, table, "again", "scan_id", F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")))
    stored = table.rows().withColumn("outcome", F.lit("stored"))
    return stored.select("scan_id", "ts", "outcome").unionByName(rejected.select("scan_id", "ts", C("reason").alias("outcome")))


@query("sink_register_session", "scans", "WITH n AS (SELECT engine || rider_id AS session_name, min(ts) AS start_ts, 'sessions/' || engine || rider_id || '/' AS path, min(rider_id) AS rider_id FROM scans GROUP BY engine, rider_id) SELECT session_name, start_ts, path, 'stored' AS outcome FROM n UNION ALL SELECT session_name, start_ts, path, 'duplicate' FROM n WHERE rider_id < 'GY10'")
def _(scans):
    """Sessions with start and folder; those that the registry holds are rejected."""
    folder, name = work_folder(scans.sparkSession), F.concat("engine", "rider_id")
    sessions = scans.groupBy("engine", "rider_id").agg(F.min("ts").alias("start_ts")).select(name.alias("session_name"), "start_ts", F.concat(F.lit("sessions/"), name, F.lit("/")).alias("path"), "rider_id")
    new = sessions.drop("rider_id")
    table = VersionedTable(scans.sparkSession, folder, new.schema)
    table.replace(lambda _: sessions.where("rider_id < 'GY10'").drop("rider_id"), "first")
    rejected = store.append(new, table, "again", "session_name")
    stored = table.rows().withColumn("outcome", F.lit("stored"))
    return stored.unionByName(rejected.withColumnRenamed("reason", "outcome"))


@query("sink_upsert_label", "label_results", "SELECT id, image_name, status FROM label_results QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY id DESC) = 1")
def _(r):
    """A new version of the table, merged from the old version's files and new rows."""
    rows = r.select("id", "image_name", "status")
    table = VersionedTable(r.sparkSession, work_folder(r.sparkSession), rows.schema)
    table.replace(lambda _: rows.where("id % 2 = 0"), "even")
    table.replace(lambda stored: store.upserted(stored, rows.where("id % 2 = 1"), "image_name", "id"), "odd")
    return table.rows()


@query("sink_append_label", "label_results", "SELECT image_name, count(*) AS attempts, max(id) AS last_id FROM label_results GROUP BY image_name")
def _(r):
    """Every attempt is appended; the table keeps them all."""
    path = work_folder(r.sparkSession)
    rows = r.select("id", "image_name", "status")
    for part in (0, 1):
        rows.where(f"id % 2 = {part}").write.mode("append").parquet(path)
    return r.sparkSession.read.schema(rows.schema).parquet(path).groupBy("image_name").agg(F.count("*").alias("attempts"), F.max("id").alias("last_id"))


@query("sink_cascade_delete", "scans lidar_points detections", "SELECT 'scans' AS table_name, scan_id, count(*) AS n FROM scans WHERE scan_id % 7 <> 0 GROUP BY scan_id UNION ALL SELECT 'points', scan_id, count(*) FROM lidar_points WHERE scan_id NOT IN (SELECT scan_id FROM scans WHERE scan_id % 7 = 0) GROUP BY scan_id UNION ALL SELECT 'detections', obj_id, count(*) FROM detections WHERE obj_id NOT IN (SELECT scan_id FROM scans WHERE scan_id % 7 = 0) GROUP BY obj_id")
def _(scans, points, detections):
    """Deleted scans take the rows of both child tables along."""
    folder, gone = work_folder(scans.sparkSession), scans.where("scan_id % 7 = 0")
    children = {"scans": scans.select("scan_id"), "points": points.select("scan_id"), "detections": detections.select(C("obj_id").cast("long").alias("scan_id"))}
    left = [files.written(store.without(files.written(rows, f"{folder}/{name}/1"), gone, "scan_id"), f"{folder}/{name}/2").groupBy(F.lit(name).alias("table_name"), "scan_id").agg(F.count("*").alias("n")) for name, rows in children.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@query("sink_keep_newest", "label_results", "SELECT image_name, id FROM label_results QUALIFY row_number() OVER (PARTITION BY image_name ORDER BY id DESC) <= 10")
def _(r):
    """What retention leaves: the newest ten rows of each image."""
    folder = work_folder(r.sparkSession)
    stored = files.written(r.select("image_name", "id"), f"{folder}/1")
    evicted = store.evicted(stored, "image_name", 10, F.desc("id"))
    return files.written(stored.join(evicted.select("id"), "id", "left_anti").select("image_name", "id"), f"{folder}/2")


@query("sink_batch_csv", "label_results scans", "SELECT r.image_name AS file, CASE WHEN r.status LIKE '%Failed%' THEN 'No' ELSE 'Yes' END AS success, CASE WHEN r.status LIKE '%Failed%' THEN '' ELSE tracking_id END AS tracking_number, CASE WHEN r.status LIKE '%Failed%' THEN '' ELSE s.order_id END AS order_id, CASE WHEN r.status LIKE '%Failed%' THEN '' ELSE coalesce(buyer_name, '') END AS buyer_name, CASE WHEN r.status LIKE '%Failed%' THEN '' ELSE CAST(weight_g AS VARCHAR) END AS weight, CASE WHEN r.status LIKE '%Failed%' THEN '' ELSE coalesce(CAST(quantity AS VARCHAR), '') END AS quantity, CASE WHEN r.status LIKE '%Failed%' THEN r.status ELSE '' END AS error FROM label_results r JOIN scans s ON s.scan_id = r.id")
def _(r, scans):
    folder = work_folder(r.sparkSession)
    rows = r.join(scans, C("scan_id") == C("id"))
    error = F.when(F.contains("status", F.lit("Failed")), C("status"))
    files.write_csv(files.batch_rows(rows, C("image_name"), error, [C("tracking_id"), C("order_id"), C("buyer_name"), C("weight_g"), C("quantity")]), folder)
    back = r.sparkSession.read.option("header", True).option("escape", '"').schema(", ".join(f"`{h}` string" for h in files.BATCH_HEADER)).csv(folder)
    return back.select(*(F.coalesce(C(h), F.lit("")).alias(h.lower().replace(" ", "_")) for h in files.BATCH_HEADER))


@query("sink_batch_json", "label_results", "SELECT id, image_name, status, confidence, processing_time FROM label_results")
def _(r):
    folder = work_folder(r.sparkSession)
    files.write_json(r, folder)
    return r.sparkSession.read.schema(r.schema).json(folder)


@query("sink_scan_json", "lidar_points", "SELECT scan_id, count(*) AS points, count_if(distance < 1000) AS obstacles FROM lidar_points GROUP BY scan_id")
def _(p):
    """Scans with their points and obstacles as JSON lines."""
    folder, nested = work_folder(p.sparkSession), lidar.nested_scans(p, "scan_id").select("scan_id", "points", "obstacles")
    files.write_json(nested, folder)
    return p.sparkSession.read.schema(nested.schema).json(folder).select("scan_id", F.size("points").cast("long").alias("points"), F.size("obstacles").cast("long").alias("obstacles"))


@query("sink_dictionary_json", "scans", "SELECT DISTINCT 'payment_type' AS field, payment_type AS value FROM scans UNION SELECT DISTINCT 'engine', engine FROM scans UNION SELECT DISTINCT 'rider_id', rider_id FROM scans")
def _(scans):
    """The distinct values of some fields as JSON, one line a field and value."""
    folder = work_folder(scans.sparkSession)
    values = store.distinct_rows(scans, ["payment_type", "engine", "rider_id"])
    files.write_json(values, folder)
    return scans.sparkSession.read.schema(values.schema).json(folder)


@query("sink_purge_empty_ts", "scans", "SELECT count(*) AS before, count_if(coalesce(buyer_name, '') = '') AS deleted, count_if(coalesce(buyer_name, '') <> '') AS after, sum(CASE WHEN coalesce(buyer_name, '') <> '' THEN scan_id END) AS kept_ids FROM scans")
def _(scans):
    """Rows of an empty column are deleted; the figures come from the files before and after."""
    folder = work_folder(scans.sparkSession)
    before = files.written(scans.select("scan_id", "buyer_name"), f"{folder}/1")
    after = files.written(store.purged(before, "buyer_name"), f"{folder}/2")
    rows = before.select(F.lit(1).alias("b"), F.lit(0).alias("a"), F.lit(None).cast("long").alias("id")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a"), C("scan_id").alias("id")))
    return rows.agg(F.sum("b").alias("before"), (F.sum("b") - F.sum("a")).alias("deleted"), F.sum("a").alias("after"), F.sum("id").alias("kept_ids"))
