"""Input views of the queries over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (tables or views that it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "scans": (
        ('customer', 'orders'),
        """SELECT o.o_orderkey AS scan_id,
  'FE' || lpad(CAST(1000000000 + o.o_custkey AS STRING), 10, '0') AS tracking_id,
  'FE' || lpad(CAST(o.o_orderkey % 1000000 AS STRING), 6, '0') || 'A' || lpad(CAST(o.o_custkey % 100000 AS STRING), 5, '0') AS order_id,
  'GY' || lpad(CAST(o.o_custkey % 23 + 1 AS STRING), 2, '0') AS rider_id,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_name END AS buyer_name,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_custkey AS STRING) || ' Mabini St, Brgy. Muzon, San Jose del Monte, Bulacan ' || CAST(3020 + o.o_custkey % 10 AS STRING) END AS buyer_address,
  CAST(100 + o.o_orderkey * 7 % 6901 AS INT) AS weight_g,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o.o_orderkey % 14 AS INT) END AS quantity,
  CASE o.o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'COD' ELSE 'cop' END AS payment_type,
  CAST(o.o_orderkey * 37 % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE WHEN o.o_orderkey * 37 % 101 < 85 THEN 'paddle' ELSE 'tesseract' END AS engine,
  o.o_orderdate + INTERVAL '1' SECOND * CAST(o.o_orderkey * 97 % 86400 AS INT) AS ts,
  CAST(1000 + o.o_orderkey * 13 % 3700 AS INT) AS processing_time_ms
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    ),
    "lidar_points": (
        ('events',),
        """SELECT event_id AS point_id, CAST(floor(event_id / 100) AS BIGINT) AS scan_id, user_id AS robot_id, ts,
  CAST(event_id * 37 % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) AS angle, CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE value * 40 END AS distance, CAST(event_id % 256 AS INT) AS quality FROM events""",
    ),
    "frames": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, ts, CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'hit' WHEN 'purchase' THEN 'miss' WHEN 'signup' THEN 'skip' ELSE 'blurry' END AS outcome FROM events""",
    ),
    "commands": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, ts, CASE WHEN event_type = 'click' THEN 'manual' ELSE 'auto' END AS source, CAST(event_id % 256 AS INT) AS speed FROM events WHERE event_type IN ('click', 'view')""",
    ),
    "mode_changes": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, ts, CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS mode FROM events WHERE event_type = 'signup'""",
    ),
    "label_text": (
        ('scans',),
        """SELECT scan_id, confidence, engine, concat_ws(chr(10),
  'FLASH EXPRESS', tracking_id, 'RTS Sort Code:', 'FEX-BUL-SJDM-MZN' || CAST(scan_id % 4 + 1 AS STRING) || '-GY0' || CAST(scan_id % 4 + 1 AS STRING),
  'Rider: ' || CASE WHEN scan_id % 5 = 0 THEN translate(rider_id, '01', 'Ol') ELSE rider_id END,
  'Order ID: ' || order_id, 'BUYER', CASE WHEN scan_id % 3 = 0 THEN 'Carlos Johnson' ELSE 'Thomas Gonzalez' END, buyer_address,
  'Quantity: ' || CAST(quantity AS STRING), 'Weight: ' || CAST(weight_g AS STRING) || 'g', payment_type) AS raw_text FROM scans""",
    ),
    "places": (
        ('scans',),
        """SELECT scan_id, CASE scan_id % 6 WHEN 0 THEN 'Muzonn' WHEN 1 THEN 'Gracevile' WHEN 2 THEN 'Tungk0' WHEN 3 THEN 'sapang palay' WHEN 4 THEN 'Loma de Gat' ELSE 'Unknown' END AS barangay_text FROM scans""",
    ),
    "order_truth": (
        ('customer',),
        """SELECT 'FE' || lpad(CAST(1000000000 + c_custkey AS STRING), 10, '0') AS tracking_id, 'FE' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0') || 'T00000' AS order_id,
  'FEX-BUL-SJDM-TKO1-GY22' AS rts_code, 'GY22' AS rider, 'Carlos Johnson' AS buyer_name, CAST(c_custkey AS STRING) || ' Carriedo St, Brgy. Tungko Main, San Jose del Monte, Bulacan 3024' AS address,
  CASE WHEN c_custkey % 10 = 1 THEN 'n/a' ELSE CAST(100 + c_custkey * 11 % 6901 AS STRING) || 'g' END AS weight, CAST(1 + c_custkey % 14 AS STRING) AS quantity FROM customer WHERE c_custkey % 3 <> 0""",
    ),
    "detections": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, ts, CASE event_type WHEN 'click' THEN 'ALGORITHM_FACE_RECOGNITION' WHEN 'view' THEN 'ALGORITHM_COLOR_RECOGNITION' WHEN 'purchase' THEN 'ALGORITHM_OBJECT_TRACKING' WHEN 'signup' THEN 'ALGORITHM_OBJECT_CLASSIFICATION' ELSE 'ALGORITHM_TAG_RECOGNITION' END AS algorithm,
  CAST(event_id % 6 AS INT) AS obj_id, CAST(event_id % 320 AS INT) AS x, CAST(event_id * 3 % 240 AS INT) AS y, CAST(10 + event_id % 50 AS INT) AS width, CAST(10 + event_id % 40 AS INT) AS height FROM events""",
    ),
    "status_updates": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, ts, CASE WHEN event_type = 'click' THEN 'moving' WHEN event_type = 'view' THEN 'idle' END AS mode, CASE WHEN event_type = 'purchase' THEN value END AS battery_voltage,
  CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id AS STRING) END AS last_error, CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN true ELSE false END AS stop_flag FROM events""",
    ),
    "sector_mask": (
        (),
        """SELECT * FROM (VALUES ('front_chassis', CAST(-30 AS DOUBLE), CAST(30 AS DOUBLE), CAST(280 AS DOUBLE)), ('rear_chassis_pos', CAST(150 AS DOUBLE), CAST(180 AS DOUBLE), CAST(180 AS DOUBLE)), ('rear_chassis_neg', CAST(-180 AS DOUBLE), CAST(-150 AS DOUBLE), CAST(180 AS DOUBLE))) AS m(name, angle_min, angle_max, min_distance_mm)""",
    ),
    "robot_masks": (
        ('events',),
        """SELECT event_id, user_id AS robot_id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE 'sector ' || CAST(event_id AS STRING) END AS name, CAST(event_id * 37 % 370 - 180 AS DOUBLE) AS angle_min,
  CAST(event_id * 37 % 370 - 180 + event_id % 60 - 2 AS DOUBLE) AS angle_max, CAST(event_id * 13 % 520 AS DOUBLE) AS min_distance_mm FROM events WHERE event_type = 'signup'""",
    ),
    "label_results": (
        ('orders',),
        """SELECT o_orderkey AS id, 'img_' || CAST(o_custkey AS STRING) || '.jpg' AS image_name, CASE WHEN o_orderstatus = 'P' THEN 'Extraction Failed' ELSE 'RTS Code Corrected' END AS status, CAST(o_orderkey % 8 AS STRING) || '/7' AS confidence, CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 100000 END AS processing_time FROM orders""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = VIEWS[name]
    return spark.sql(_marked(text, needs), **{f"t_{n}": view(spark, sf_dir, n) for n in needs}) if needs else spark.sql(text)


def _marked(text: str, needs: tuple[str, ...]) -> str:
    """The view's SQL with its inputs as parameters."""
    import re

    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{t_{n}}}", text)
    return text


def sql(names: str, body: str) -> str:
    """SQL for DuckDB: the views ``names`` (and what they need), then ``body`` (which may begin with WITH)."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in VIEWS and n not in order:
            for x in VIEWS[n][0]:
                add(x)
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    body = body.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        body = body[len("WITH " + recursive) :]
        return f"WITH {recursive}" + ", ".join([*parts, body])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
