"""Streaming queries, each compared with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lidar
from ..operators.enrich import enriched
from ..sources.files import write_json
from ..streaming import event_time, jobs
from ..views import sql, view
from .catalog import QUERIES, SQL
from .lidar_queries import _minima, _quoted
from .sequence_queries import _greedy

C = F.col
NTZ = "timestamp_ntz"


def stream_query(name: str, views: str, oracle: str | None):
    def add(f):
        def run(spark, sf_dir):
            return f(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            SQL[name] = sql(views, oracle)
        return f

    return add


@stream_query("st_lidar_points", "lidar_points", "SELECT point_id, round((angle + 18) % 360, 6) AS angle, round(distance * cos(radians((angle + 18) % 360)), 2) AS x, distance < 1000 AS obstacle FROM lidar_points")
def _(spark, d):
    return jobs.run(jobs.points(jobs.stream_view(spark, d, "lidar_points")), "append").select("point_id", F.round("angle", 6).alias("angle"), "x", "obstacle")


@stream_query("st_scan_sectors", "lidar_points", _quoted(_minima("lidar_points")))
def _(spark, d):
    """The sectors of each scan, given out once when the watermark has passed its end."""
    points = jobs.replayed(view(spark, d, "lidar_points").select("scan_id", "point_id", "ts", "angle", "distance"), key="point_id")
    return jobs.run(jobs.scan_sectors(points), "append").select("scan_id", *lidar.SECTORS)


@stream_query("st_daily_stats", "scans", None)
def _(spark, d):
    """Daily statistics of scans as they come in, with exact counts of distinct parcels and riders."""
    scans = view(spark, d, "scans").select("scan_id", "ts", "confidence", "processing_time_ms", "tracking_id", "rider_id")
    return jobs.daily(jobs.replayed(scans, key="scan_id", end=False))


SQL["st_daily_stats"] = SQL["agg_daily_stats"]


@stream_query("st_latest_state", "status_updates", "SELECT robot_id, event_id, ts AS updated_at FROM status_updates QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    rows = jobs.newest(jobs.run(jobs.latest_state(jobs.stream_view(spark, d, "status_updates")), "update"), "robot_id")
    return rows.withColumn("updated_at", C("updated_at").cast(NTZ))


@stream_query("st_error_log", "status_updates", "SELECT event_id, robot_id, last_error FROM status_updates WHERE trim(last_error) <> ''")
def _(spark, d):
    return jobs.run(jobs.errors(jobs.stream_view(spark, d, "status_updates")), "append").drop("batch")


def _frames(spark, d):
    """Frames that arrive up to two hours late, in four micro-batches."""
    return jobs.replayed(view(spark, d, "frames").select("robot_id", "event_id", "ts", "outcome"))


@stream_query("st_debounce", "frames", None)
def _(spark, d):
    return jobs.run(event_time.debounced(_frames(spark, d)), "append", jobs.ROCKS).select("event_id", "robot_id", "streak")


SQL["st_debounce"] = SQL["win_debounce"]


@stream_query("st_cooldown", "frames", None)
def _(spark, d):
    hits = _frames(spark, d).where("outcome = 'hit' or robot_id is null")
    return jobs.run(event_time.cooled_down(hits, 7200), "append", jobs.ROCKS).select("robot_id", C("ts").cast(NTZ).alias("ts"))


SQL["st_cooldown"] = sql("frames", _greedy("SELECT * FROM frames WHERE outcome = 'hit'"))


@stream_query("st_heartbeat_sessions", "commands", None)
def _(spark, d):
    commands = jobs.replayed(view(spark, d, "commands").select("robot_id", "event_id", "ts"))
    rows = jobs.run(jobs.heartbeat_sessions(commands, 3600, "3 hours"), "append")
    return rows.select("robot_id", C("start_ts").cast(NTZ).alias("start_ts"), C("end_ts").cast(NTZ).alias("end_ts"), "n")


SQL["st_heartbeat_sessions"] = SQL["win_heartbeat_sessions"]


@stream_query("st_dedup_scans", "lidar_points", "SELECT point_id, quality FROM lidar_points")
def _(spark, d):
    """Every point comes again after eleven days with another value; the first stays."""
    points = view(spark, d, "lidar_points").select("point_id", C("ts").cast("timestamp").alias("ts"), "quality")
    again = points.select("point_id", (C("ts") + F.expr("INTERVAL 11 DAYS")).alias("ts"), (C("quality") + 1000).alias("quality"))
    stream = jobs.replayed(points.unionByName(again), key="point_id", end=False)
    return jobs.run(jobs.unique(stream, "point_id"), "append").select("point_id", "quality")


@stream_query("st_enrich_orders", "scans order_truth", "SELECT s.scan_id, coalesce(o.address, s.buyer_address) AS buyer_address, o.tracking_id IS NOT NULL AS order_found FROM scans s LEFT JOIN order_truth o USING (tracking_id)")
def _(spark, d):
    orders, customers = jobs.source(spark, d, "orders"), view(spark, d, "customer")
    from ..views import VIEWS, _marked

    scans = spark.sql(_marked(VIEWS["scans"][1], VIEWS["scans"][0]), t_orders=orders, t_customer=customers)
    done = enriched(scans, view(spark, d, "order_truth"), keep_name=C("buyer_name").isNotNull())
    return jobs.run(done.select("scan_id", "buyer_address", "order_found"), "append").drop("batch")


@stream_query("st_rolling_min", "lidar_points", "WITH w AS (SELECT distance, time_bucket(INTERVAL 5 MINUTE, ts) AS a FROM lidar_points WHERE distance > 0), u AS (SELECT a AS start_ts, distance FROM w UNION ALL SELECT a - INTERVAL 5 MINUTE, distance FROM w) SELECT start_ts, min(distance) AS nearest FROM u GROUP BY start_ts")
def _(spark, d):
    rows = jobs.newest(jobs.run(jobs.rolling_minimum(jobs.stream_view(spark, d, "lidar_points"), "10 minutes", "5 minutes", "1 day"), "update"), "window")
    return rows.select(C("window.start").cast(NTZ).alias("start_ts"), "nearest")


@stream_query("cb_foreach_batch", "lidar_points", "SELECT scan_id, count(*) AS points FROM lidar_points GROUP BY scan_id")
def _(spark, d):
    folder = jobs.work_folder(spark)

    def broken(rows, batch):
        raise RuntimeError("a listener that fails")

    def keep(rows, batch):
        write_json(rows.select("scan_id", "point_id"), f"{folder}/batch={batch}")

    jobs.with_callbacks(jobs.stream_view(spark, d, "lidar_points"), [broken, keep])
    return spark.read.schema("scan_id long, point_id long").json(folder).groupBy("scan_id").agg(F.count("*").alias("points"))


@stream_query("cb_detection", "frames", None)
def _(spark, d):
    folder = jobs.work_folder(spark)
    fired = event_time.debounced(_frames(spark, d))

    def captured(rows, batch):
        write_json(rows.select("robot_id", F.concat(F.lit("auto_"), C("event_id").cast("string"), F.lit(".jpg")).alias("file")), f"{folder}/batch={batch}")

    jobs.with_callbacks(fired, [captured], jobs.ROCKS)
    return spark.read.schema("robot_id long, file string").json(folder).select("robot_id", "file")


SQL["cb_detection"] = f"SELECT robot_id, 'auto_' || event_id || '.jpg' AS file FROM ({SQL['win_debounce']})"
