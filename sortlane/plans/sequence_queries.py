"""Queries over event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lidar, sequence
from .catalog import query

C = F.col
_ORDER = "PARTITION BY robot_id ORDER BY ts, event_id"


@query("win_debounce", "frames", f"WITH k AS (SELECT *, sum(CASE WHEN outcome = 'hit' THEN 0 ELSE 1 END) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM frames WHERE outcome <> 'skip'), n AS (SELECT event_id, robot_id, row_number() OVER (PARTITION BY robot_id, run ORDER BY ts, event_id) AS streak FROM k WHERE outcome = 'hit') SELECT event_id, robot_id, streak FROM n WHERE streak % 3 = 0")
def _(frames):
    return sequence.debounced(frames, "robot_id", ["ts", "event_id"]).select("event_id", "robot_id", "streak")


@query("win_failure_run", "frames", f"WITH k AS (SELECT *, sum(CASE WHEN outcome = 'hit' THEN 0 ELSE 1 END) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM frames), n AS (SELECT event_id, robot_id, row_number() OVER (PARTITION BY robot_id, run ORDER BY ts, event_id) AS failures FROM k WHERE outcome = 'hit') SELECT event_id, robot_id, failures FROM n WHERE failures = 4")
def _(frames):
    return sequence.failure_runs(frames, "robot_id", ["ts", "event_id"], C("outcome") == "hit", 3).select("event_id", "robot_id", "failures")


@query("win_new_capture", "frames", f"WITH l AS (SELECT event_id, robot_id, outcome, lag(outcome) OVER ({_ORDER}) AS previous FROM frames) SELECT * FROM l WHERE previous IS DISTINCT FROM outcome")
def _(frames):
    return sequence.changes(frames, "robot_id", ["ts", "event_id"], "outcome").select("event_id", "robot_id", "outcome", "previous")


@query("win_status_fill", "status_updates", "SELECT event_id, robot_id, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("mode", "battery_voltage", "last_error")) + " FROM status_updates")
def _(s):
    return sequence.filled(s, "robot_id", ["ts", "event_id"], ["mode", "battery_voltage", "last_error"]).select("event_id", "robot_id", "mode", "battery_voltage", "last_error")


@query("win_stop_latch", "status_updates", f"SELECT event_id, robot_id, bool_or(stop_flag) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS latched FROM status_updates")
def _(s):
    return sequence.latched(s, "robot_id", ["ts", "event_id"], "stop_flag").select("event_id", "robot_id", "latched")


_SESSIONS = "WITH k AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY robot_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM commands), s AS (SELECT *, sum(new) OVER (PARTITION BY robot_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM k) SELECT robot_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY robot_id, session"


@query("win_heartbeat_sessions", "commands", _SESSIONS)
def _(c):
    return sequence.sessions(c, "robot_id", 3600)


def _greedy(hits: str) -> str:
    """Alarms of ``hits`` (robot_id, ts, event_id) by the rule, one after the other."""
    return f"WITH RECURSIVE h AS (SELECT robot_id, ts, row_number() OVER (PARTITION BY robot_id ORDER BY ts, event_id) AS i FROM ({hits})), f(robot_id, i, ts, last_ts, fired) AS (SELECT robot_id, i, ts, ts, true FROM h WHERE i = 1 UNION ALL SELECT h.robot_id, h.i, h.ts, CASE WHEN epoch(h.ts) - epoch(f.last_ts) > 7200 THEN h.ts ELSE f.last_ts END, epoch(h.ts) - epoch(f.last_ts) > 7200 FROM f JOIN h ON h.robot_id = f.robot_id AND h.i = f.i + 1) SELECT robot_id, ts FROM f WHERE fired"


_MODES = "SELECT robot_id, ts, arg_max(mode, event_id) AS mode FROM mode_changes GROUP BY robot_id, ts"


@query("win_cooldown", "lidar_points mode_changes", _greedy(f"SELECT p.robot_id, p.ts, p.point_id AS event_id FROM lidar_points p ASOF LEFT JOIN ({_MODES}) m ON p.robot_id = m.robot_id AND p.ts >= m.ts WHERE p.distance > 0 AND p.distance < 500 AND m.mode = 'auto'"))
def _(points, modes):
    """Warnings: something nearer than 500 mm while the robot drives itself, then a pause."""
    near = lidar.in_range(points).where(F.col("distance") < 500).select("robot_id", "ts", C("point_id").alias("event_id"), F.lit("auto").alias("source"))
    return sequence.cooled_down(sequence.mode_as_of(near, modes, "robot_id").where("accepted"), "robot_id", 7200)


@query("join_mode_asof", "commands mode_changes", "WITH m AS (SELECT robot_id, ts, arg_max(mode, event_id) AS mode FROM mode_changes GROUP BY robot_id, ts) SELECT c.event_id, c.robot_id, c.ts, c.source, coalesce(m.mode, 'manual') AS mode, c.source = coalesce(m.mode, 'manual') AS accepted FROM commands c ASOF LEFT JOIN m ON c.robot_id = m.robot_id AND c.ts >= m.ts")
def _(c, m):
    return sequence.mode_as_of(c, m, "robot_id").select("event_id", "robot_id", "ts", "source", "mode", "accepted")


@query("win_next_line", "label_text", "WITH l AS (SELECT scan_id, string_split(raw_text, chr(10)) AS a FROM label_text), p AS (SELECT scan_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l), n AS (SELECT *, lead(line) OVER (PARTITION BY scan_id ORDER BY pos) AS next FROM p) SELECT scan_id, next AS sort_code FROM n WHERE line = 'RTS Sort Code:'")
def _(t):
    lines = F.split("raw_text", "\n")
    at = F.array_position(lines, "RTS Sort Code:")
    return t.where(at > 0).select("scan_id", F.get(lines, at.cast("int")).alias("sort_code"))


@query("win_reading_order", "detections", "SELECT event_id, robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY y, x, event_id) AS place FROM detections")
def _(d):
    return sequence.places(d, "robot_id", ["y", "x", "event_id"], "place", 16).select("event_id", "robot_id", "place")


@query("win_keyword_next", "conversations", "WITH n AS (SELECT conv_id, turn, role, lead(role, 1) OVER w AS a, lead(role, 2) OVER w AS b, lead(role, 3) OVER w AS c, lead(role, 4) OVER w AS d FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN a <> 'user' THEN a WHEN b <> 'user' THEN b WHEN c <> 'user' THEN c WHEN d <> 'user' THEN d END AS value FROM n WHERE role = 'user'")
def _(t):
    from pyspark.sql import Window

    following = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 4))
    rows = t.withColumn("value", F.get(F.filter(following, lambda x: x != "user"), F.lit(0)))
    return rows.where("role = 'user'").select("conv_id", "turn", "value")
