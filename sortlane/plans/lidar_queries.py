"""Queries over range-sensor points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lidar, store
from .catalog import query

C = F.col
_A = "((({a} + 180) % 360 + 360) % 360 - 180)"
_NORM = _A.format(a="angle")
_SECTOR = f"CASE WHEN {_NORM} BETWEEN -30 AND 30 THEN 'front' WHEN {_NORM} > 30 AND {_NORM} <= 90 THEN 'front_left' WHEN {_NORM} > 90 AND {_NORM} <= 150 THEN 'left' WHEN {_NORM} >= -150 AND {_NORM} < -90 THEN 'right' WHEN {_NORM} >= -90 AND {_NORM} < -30 THEN 'front_right' ELSE 'rear' END"
_INF = "CAST('Infinity' AS DOUBLE)"


def _minima(source: str, keys: str = "scan_id", front: bool = False) -> str:
    cells = ", ".join(f"coalesce(min(distance) FILTER (distance > 0 AND distance <= 8000 AND s = '{s}'), {_INF}) AS {s}" for s in lidar.SECTORS)
    more = f", coalesce(min(distance) FILTER (distance > 0 AND {_NORM} BETWEEN -30 AND 30), {_INF}) AS front_min" if front else ""
    return f"SELECT {keys}, {cells}{more} FROM (SELECT *, {_SECTOR} AS s FROM {source}) GROUP BY {keys}"


_DECIDE = "CASE WHEN front > 500 THEN 'forward' WHEN least(\"left\", front_left) > 500 AND least(\"left\", front_left) > least(\"right\", front_right) THEN 'left' WHEN least(\"right\", front_right) > 500 THEN 'right' WHEN rear > 500 THEN 'backward' ELSE 'stop' END"


def _quoted(text: str) -> str:
    return text.replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"')


_SECTORS = _quoted(_minima("lidar_points"))


@query("flt_point_range", "lidar_points", "SELECT point_id, angle, distance FROM lidar_points WHERE distance > 0 AND distance <= 8000")
def _(p):
    return lidar.in_range(p).select("point_id", "angle", "distance")


@query("flt_obstacles", "lidar_points", "SELECT point_id, distance FROM lidar_points WHERE distance < 1000")
def _(p):
    return p.where("distance < 1000").select("point_id", "distance")


_VALID = "length(trim(name)) BETWEEN 1 AND 64 AND angle_min BETWEEN -180 AND 360 AND angle_max BETWEEN -180 AND 360 AND angle_min <= angle_max AND min_distance_mm BETWEEN 0 AND 500"


@query("flt_mask_valid", "robot_masks", f"WITH r AS (SELECT *, {_VALID} AS valid FROM robot_masks) SELECT event_id, robot_id, valid, bool_and(valid) OVER (PARTITION BY robot_id) AND count(*) OVER (PARTITION BY robot_id) BETWEEN 1 AND 10 AS mask_valid FROM r")
def _(masks):
    return lidar.checked_masks(masks, "robot_id").select("event_id", "robot_id", "valid", "mask_valid")


@query("join_body_mask", "lidar_points sector_mask", f"SELECT point_id, angle, distance FROM lidar_points p WHERE distance > 0 AND NOT EXISTS (SELECT 1 FROM sector_mask m WHERE {_NORM} BETWEEN m.angle_min AND m.angle_max AND p.distance < m.min_distance_mm)")
def _(p, mask):
    return lidar.body_masked(p, mask).select("point_id", "angle", "distance")


@query("agg_sector_min", "lidar_points", _SECTORS)
def _(p):
    return lidar.sector_minima(p, "scan_id")


@query("agg_front_min", "lidar_points", f"SELECT scan_id, coalesce(min(distance) FILTER (distance > 0 AND {_NORM} BETWEEN -30 AND 30), {_INF}) AS front_min FROM lidar_points GROUP BY scan_id")
def _(p):
    return lidar.front_minimum(p, "scan_id")


@query("agg_scan_min", "lidar_points", "SELECT scan_id, min(distance) FILTER (distance > 0) AS min_distance FROM lidar_points GROUP BY scan_id")
def _(p):
    return lidar.scan_minimum(p, "scan_id")


@query("agg_scan_summary", "lidar_points", "SELECT scan_id, count(*) AS points, round(avg(quality), 6) AS avg_quality, count_if(distance < 1000) AS obstacles, max(ts) AS last_update FROM lidar_points GROUP BY scan_id")
def _(p):
    return lidar.scan_summary(p, "scan_id")


@query("agg_scan_nested", "lidar_points", "SELECT scan_id, count(*) AS points, count_if(distance < 1000) AS obstacles, round(sum(angle), 4) AS angles FROM lidar_points GROUP BY scan_id")
def _(p):
    n = lidar.nested_scans(p, "scan_id")
    total = F.aggregate("points", F.lit(0.0), lambda a, x: a + x["angle"])
    return n.select("scan_id", F.size("points").cast("long").alias("points"), F.size("obstacles").cast("long").alias("obstacles"), F.round(total, 4).alias("angles"))


@query("math_norm_angle", "lidar_points", f"SELECT point_id, round({_NORM}, 6) AS angle FROM lidar_points")
def _(p):
    return p.select("point_id", F.round(lidar.norm_angle(C("angle")), 6).alias("angle"))


@query("math_offset_xy", "lidar_points", "SELECT point_id, round((angle + 18) % 360, 6) AS angle, round(distance * cos(radians((angle + 18) % 360)), 2) AS x, round(distance * sin(radians((angle + 18) % 360)), 2) AS y, distance < 1000 AS obstacle FROM lidar_points")
def _(p):
    return lidar.offset_points(p).select("point_id", F.round("angle", 6).alias("angle"), "x", "y", "obstacle")


@query("math_polar_xy", "lidar_points", "SELECT point_id, round(distance * cos(radians(angle)), 4) AS x, round(distance * sin(radians(angle)), 4) AS y FROM lidar_points WHERE distance > 0")
def _(p):
    rows = p.where("distance > 0")
    return rows.select("point_id", F.round(lidar.x_of(C("angle"), C("distance")), 4).alias("x"), F.round(lidar.y_of(C("angle"), C("distance")), 4).alias("y"))


@query("src_sdk_points", "lidar_points", "SELECT point_id, round(degrees(radians(angle)), 6) AS angle, round(distance / 1000 * 1000, 6) AS distance, quality FROM lidar_points")
def _(p):
    raw = p.select("point_id", F.radians("angle").alias("angle_rad"), (C("distance") / 1000).alias("distance_m"), (C("quality") + 0.7).alias("intensity"))
    return lidar.sdk_points(raw).select("point_id", F.round("angle", 6).alias("angle"), F.round("distance", 6).alias("distance"), "quality")


@query("src_lidar_csv_lines", "lidar_points", "SELECT point_id, angle, round(distance, 3) AS distance, CASE WHEN point_id % 3 = 0 THEN 255 ELSE quality END AS quality FROM lidar_points WHERE round(distance, 3) BETWEEN 100 AND 8000 AND point_id % 11 <> 0")
def _(p):
    line = F.when(C("point_id") % 11 == 0, "noise").otherwise(F.concat_ws(",", C("angle").cast("string"), F.round("distance", 3).cast("decimal(12,3)").cast("string"), F.when(C("point_id") % 3 != 0, C("quality").cast("string"))))
    return lidar.parsed_lines(p.select("point_id", line.alias("value"))).select("point_id", "angle", "distance", "quality")


@query("src_lidar_packets", "lidar_points", "WITH r AS (SELECT point_id, quality, CAST(floor(angle * 64) AS INT) AS a, CAST(least(floor(distance * 4), 65535) AS INT) AS d FROM lidar_points) SELECT point_id, quality, a / 64.0 AS angle, d / 4.0 AS distance FROM r WHERE d > 0 AND d < 48000")
def _(p):
    two = lambda n: F.concat(F.substring(F.lpad(F.hex(n), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(n), 4, "0"), 1, 2))
    a, d = F.floor(C("angle") * 64).cast("int"), F.least(F.floor(C("distance") * 4), F.lit(65535)).cast("int")
    packets = p.select("point_id", F.unhex(F.concat(F.lpad(F.hex("quality"), 2, "0"), two(a), two(d))).alias("packet"))
    return lidar.decoded_packets(packets).select("point_id", "quality", "angle", "distance")


@query("rule_decision", "lidar_points", f"WITH s AS ({_SECTORS}) SELECT scan_id, {_DECIDE} AS decision FROM s")
def _(p):
    return lidar.sector_minima(p, "scan_id").select("scan_id", lidar.decision().alias("decision"))


@query("math_speed_scale", "lidar_points", "SELECT point_id, CASE WHEN distance <= 300 THEN 0 WHEN distance >= 700 THEN 100 ELSE CAST(trunc(100 * ((distance - 300) / 400)) AS INT) END AS speed FROM lidar_points")
def _(p):
    return p.select("point_id", lidar.scaled_speed(C("distance"), F.lit(100)).alias("speed"))


@query("math_turn_speed", "commands", "SELECT event_id, CASE WHEN source = 'auto' THEN CAST(trunc(speed * 0.5) AS INT) ELSE speed END AS speed FROM commands")
def _(c):
    return c.select("event_id", lidar.turn_speed(F.when(C("source") == "auto", "left").otherwise("forward"), C("speed")).alias("speed"))


@query("math_pwm_governor", "commands", "SELECT event_id, CASE WHEN source = 'auto' AND speed > 0 THEN 40 + CAST(trunc(110.0 * speed / 255) AS INT) ELSE speed END AS pwm FROM commands")
def _(c):
    return c.select("event_id", lidar.governed_pwm(C("source") == "auto", C("speed")).alias("pwm"))


_TURNED = f"m AS (SELECT * REPLACE ((angle + 18) % 360 AS angle) FROM lidar_points), k AS (SELECT * FROM m p WHERE distance > 0 AND NOT EXISTS (SELECT 1 FROM sector_mask q WHERE {_NORM} BETWEEN q.angle_min AND q.angle_max AND p.distance < q.min_distance_mm))"


@query("pipe_avoidance", "lidar_points sector_mask", f"WITH {_TURNED}, s AS ({_quoted(_minima('k', front=True))}), d AS (SELECT *, {_DECIDE} AS decision, CASE WHEN front_min <= 300 THEN 0 WHEN front_min >= 700 THEN 100 ELSE CAST(trunc(100 * ((front_min - 300) / 400)) AS INT) END AS base FROM s) SELECT * EXCLUDE (base), CASE WHEN decision IN ('left', 'right') THEN CAST(trunc(base * 0.5) AS INT) ELSE base END AS speed FROM d")
def _(p, mask):
    return lidar.avoidance(p, mask, 100, "scan_id")


@query("win_latest_n_points", "lidar_points", "SELECT point_id, robot_id, rank FROM (SELECT point_id, robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC, point_id DESC) AS rank FROM lidar_points) WHERE rank <= 20")
def _(p):
    return lidar.latest_points(p, 20, "robot_id").select("point_id", "robot_id", "rank")


@query("top_nearest_front", "lidar_points", f"SELECT scan_id, point_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY distance, point_id) AS rank FROM lidar_points WHERE distance > 0 AND {_NORM} BETWEEN -30 AND 30) WHERE rank <= 3")
def _(p):
    front = p.where((C("distance") > 0) & lidar.norm_angle(C("angle")).between(-30, 30))
    return store.first_n(front, ["scan_id"], 3, C("distance"), C("point_id")).select("scan_id", "point_id", "distance", "rank")


_PER_ROBOT = _quoted(_minima("lidar_points", "robot_id, scan_id"))


@query("win_decision_changes", "lidar_points", f"WITH s AS ({_PER_ROBOT}), d AS (SELECT robot_id, scan_id, {_DECIDE} AS decision FROM s), l AS (SELECT *, lag(decision, 1, 'stop') OVER (PARTITION BY robot_id ORDER BY scan_id) AS previous FROM d) SELECT * FROM l WHERE previous <> decision")
def _(p):
    from ..operators.sequence import changes

    d = lidar.sector_minima(p, "robot_id", "scan_id").select("robot_id", "scan_id", lidar.decision().alias("decision"))
    return changes(d, "robot_id", ["scan_id"], "decision", "stop")


@query("win_carry_decision", "lidar_points", f"WITH s AS ({_PER_ROBOT}), d AS (SELECT robot_id, scan_id, CASE WHEN scan_id % 3 <> 0 THEN {_DECIDE} END AS decision FROM s) SELECT robot_id, scan_id, coalesce(last_value(decision IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY scan_id ROWS UNBOUNDED PRECEDING), 'stop') AS decision FROM d")
def _(p):
    from ..operators.sequence import carried

    d = lidar.sector_minima(p, "robot_id", "scan_id").select("robot_id", "scan_id", F.when(C("scan_id") % 3 != 0, lidar.decision()).alias("decision"))
    return carried(d, "robot_id", ["scan_id"], "decision", "stop")
