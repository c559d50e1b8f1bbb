"""Range-sensor operators: points to sectors, decisions and speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mounting offset in degrees, least free distance, stop and full-speed distances, range of sector points.
OFFSET, SAFETY, STOP, FULL, FARTHEST = 18.0, 500.0, 300.0, 700.0, 8000.0
SECTORS = ("front", "front_left", "left", "rear", "right", "front_right")


def norm_angle(a: Column) -> Column:
    """Wrapped to [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def x_of(angle: Column, distance: Column) -> Column:
    return distance * F.cos(F.radians(angle))


def y_of(angle: Column, distance: Column) -> Column:
    return distance * F.sin(F.radians(angle))


def in_range(points: DataFrame, low: float = 0.0, high: float = FARTHEST) -> DataFrame:
    return points.where((F.col("distance") > low) & (F.col("distance") <= high))


def offset_points(points: DataFrame, offset: float = OFFSET) -> DataFrame:
    """Angles turned by the mounting offset, with x and y and the obstacle flag."""
    a = F.pmod(F.col("angle") + offset, F.lit(360.0))
    out = points.withColumn("angle", a)
    return out.withColumns({"x": F.round(x_of(F.col("angle"), F.col("distance")), 2), "y": F.round(y_of(F.col("angle"), F.col("distance")), 2), "obstacle": F.col("distance") < 1000})


#: A mask has so many sectors at most (fixed value).
MOST_SECTORS = 10


def sector_valid() -> Column:
    """Is a row ``name, angle_min, angle_max, min_distance_mm`` a proper sector?"""
    angles = F.col("angle_min").between(-180, 360) & F.col("angle_max").between(-180, 360) & (F.col("angle_min") <= F.col("angle_max"))
    ok = F.length(F.trim("name")).between(1, 64) & angles & F.col("min_distance_mm").between(0, 500)
    return F.coalesce(ok, F.lit(False))


def checked_masks(sectors: DataFrame, key: str) -> DataFrame:
    """Sectors of many masks with ``valid`` (the sector's own) and ``mask_valid``: all sectors of
    the key are valid and there are 1 to MOST_SECTORS."""
    rows = sectors.withColumn("valid", sector_valid())
    masks = rows.groupBy(key).agg((F.bool_and("valid") & F.count("*").between(1, MOST_SECTORS)).alias("mask_valid"))
    return rows.join(masks, key)


def body_masked(points: DataFrame, mask: DataFrame) -> DataFrame:
    """Points outside the robot's own body: a point goes if a sector of the mask holds
    its angle and it is nearer than the sector's least distance, or if its distance is
    not positive.  An empty mask changes nothing; one of more than MOST_SECTORS sectors is an
    error, so the range anti-join is a broadcast of a few rows.
    """
    n = mask.limit(MOST_SECTORS + 1).count()
    if n > MOST_SECTORS:
        raise ValueError(f"a body mask has {MOST_SECTORS} sectors at most")
    if n == 0:
        return points
    a = norm_angle(F.col("angle"))
    return points.where(F.col("distance") > 0).join(F.broadcast(mask), a.between(F.col("angle_min"), F.col("angle_max")) & (F.col("distance") < F.col("min_distance_mm")), "left_anti")


def sector(angle: Column) -> Column:
    a = norm_angle(angle)
    return (
        F.when((a >= -30) & (a <= 30), "front").when((a > 30) & (a <= 90), "front_left").when((a > 90) & (a <= 150), "left")
        .when((a >= -150) & (a < -90), "right").when((a >= -90) & (a < -30), "front_right").otherwise("rear")
    )


def nearest(condition: Column) -> Column:
    """The least distance where the condition holds, infinite where it never does."""
    return F.coalesce(F.min(F.when(condition, F.col("distance"))), F.lit(float("inf")))


def sector_minima(points: DataFrame, *keys: str) -> DataFrame:
    usable = (F.col("distance") > 0) & (F.col("distance") <= FARTHEST)
    rows = points.withColumn("__s", sector(F.col("angle")))
    return rows.groupBy(*keys).agg(*(nearest(usable & (F.col("__s") == s)).alias(s) for s in SECTORS))


def front_minimum(points: DataFrame, *keys: str) -> DataFrame:
    a = norm_angle(F.col("angle"))
    return points.groupBy(*keys).agg(nearest((F.col("distance") > 0) & a.between(-30, 30)).alias("front_min"))


def scan_minimum(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min(F.when(F.col("distance") > 0, F.col("distance"))).alias("min_distance"))


def scan_summary(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("points"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.count_if(F.col("distance") < 1000).alias("obstacles"), F.max("ts").alias("last_update"))


def decision(safety: float = SAFETY) -> Column:
    """From the sector columns: forward, a turn to the freer side, backward or stop."""
    left, right = F.least("left", "front_left"), F.least("right", "front_right")
    return F.when(F.col("front") > safety, "forward").when((left > safety) & (left > right), "left").when(right > safety, "right").when(F.col("rear") > safety, "backward").otherwise("stop")


def scaled_speed(nearest_front: Column, base: Column) -> Column:
    share = (nearest_front - STOP) / (FULL - STOP)
    return F.when(nearest_front <= STOP, 0).when(nearest_front >= FULL, base).otherwise((base * share).cast("int")).cast("int")


def turn_speed(move: Column, speed: Column) -> Column:
    return F.when(move.isin("left", "right"), (speed * 0.5).cast("int")).otherwise(speed).cast("int")


def governed_pwm(moving: Column, speed: Column) -> Column:
    """Clamped to 0 to 255; while moving, 40 plus 110 times the share of 255."""
    s = F.greatest(F.lit(0), F.least(F.lit(255), speed))
    return F.when(moving & (s > 0), F.lit(40) + (F.lit(110.0) * s / 255).cast("int")).otherwise(s).cast("int")


def avoidance(points: DataFrame, mask: DataFrame, base: int = 100, *keys: str, offset: float = OFFSET) -> DataFrame:
    """Offset, body mask, sectors, decision and speed of each scan."""
    turned = body_masked(points.withColumn("angle", F.pmod(F.col("angle") + offset, F.lit(360.0))), mask)
    usable = (F.col("distance") > 0) & (F.col("distance") <= FARTHEST)
    rows = turned.withColumn("__s", sector(F.col("angle")))
    front = nearest((F.col("distance") > 0) & norm_angle(F.col("angle")).between(-30, 30)).alias("front_min")
    out = rows.groupBy(*keys).agg(*(nearest(usable & (F.col("__s") == s)).alias(s) for s in SECTORS), front)
    out = out.withColumn("decision", decision()).withColumn("speed", scaled_speed(F.col("front_min"), F.lit(base)))
    return out.withColumn("speed", turn_speed(F.col("decision"), F.col("speed")))


def nested_scans(points: DataFrame, *keys: str) -> DataFrame:
    """Points, polar pairs and obstacles of each scan as sorted arrays (a scan is bounded by the sensor)."""
    p = F.struct("angle", "distance", "quality")
    near = F.when(F.col("distance") < 1000, F.struct("angle", "distance"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(p)).alias("points"), F.array_sort(F.collect_list(near)).alias("obstacles"))


def latest_points(points: DataFrame, n: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("point_id"))
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def decoded_packets(packets: DataFrame, raw: str = "packet") -> DataFrame:
    """Aligned five-byte packets: quality, angle in 1/64 degree, distance in 1/4 mm."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(raw), i, 1)), 16, 10).cast("int")
    low_high = lambda i: byte(i) + F.shiftleft(byte(i + 1), 8)
    out = packets.withColumns({"quality": byte(1), "angle": low_high(2) / 64.0, "distance": low_high(4) / 4.0})
    return out.where((F.col("angle") >= 0) & (F.col("angle") < 360) & (F.col("distance") > 0) & (F.col("distance") < 12000))


def parsed_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines "angle,distance[,quality]"; quality 255 where absent, other lines go."""
    part = F.split(F.trim(text), ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    out = lines.withColumns({"angle": number(0), "distance": number(1), "quality": F.when(F.size(part) > 2, F.get(part, F.lit(2)).try_cast("int")).otherwise(255)})
    return out.where(F.col("angle").isNotNull() & F.col("quality").isNotNull() & F.col("distance").between(100, 8000))


def sdk_points(points: DataFrame) -> DataFrame:
    """Radians and metres to degrees and millimetres."""
    out = points.withColumns({"angle": F.degrees("angle_rad"), "distance": F.col("distance_m") * 1000, "quality": F.col("intensity").cast("int")})
    return out.withColumns({"x": x_of(F.col("angle"), F.col("distance")), "y": y_of(F.col("angle"), F.col("distance"))})
