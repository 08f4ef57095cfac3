"""The `trace` of the driver's `events` table: each user's events in order, as a track.

Latitude steps by a ten-thousandth of a degree, longitude and height come from the event, so that every
track operator has input from tables that any engine can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, seq, time_ms, lat_deg, lon_deg, elevation, power_w."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    ms = F.expr("CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000e0) AS BIGINT)")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.withColumn("seq", seq).select(
        F.col("user_id").alias("track_id"),
        "seq",
        ms.alias("time_ms"),
        (45.0 + (F.col("user_id") % 100) / 100.0 + F.col("seq") * 1e-4).alias("lat_deg"),
        (6.0 + (F.col("event_id") * 7919 % 1000) * 1e-6).alias("lon_deg"),
        (100.0 + F.col("value")).alias("elevation"),
        (F.col("value") * 2.0).alias("power_w"),
    )


def trace_points(spark: SparkSession, sf_dir: str, time_scale: float = 1.0) -> DataFrame:
    """The trace as points: angles in radians, time in (scaled) milliseconds."""
    t = trace(spark, sf_dir)
    return t.select("track_id", "seq", F.radians("lat_deg").alias("latitude"), F.radians("lon_deg").alias("longitude"), (F.col("time_ms") * time_scale).alias("time"), "elevation", F.col("power_w").alias("pInputPower"))


# The same in SQL that DuckDB runs.
TRACE = """
t AS (SELECT user_id AS track_id, event_id, CAST(floor(epoch_us(ts)/1000e0) AS BIGINT) AS time_ms,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value FROM events),
tr AS (SELECT track_id, seq, time_ms, 45e0 + (track_id % 100) / 100e0 + seq * 1e-4 AS lat_deg,
        6e0 + ((event_id * 7919) % 1000) * 1e-6 AS lon_deg, 100e0 + value AS elevation, value * 2e0 AS power_w FROM t)
"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"least(1e0, greatest(0e0, pow(sin(({lat2} - {lat1}) / 2e0), 2) + cos({lat1}) * cos({lat2}) * pow(sin(({lon2} - {lon1}) / 2e0), 2)))"
    return f"(6371000e0 * 2e0 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


POINTS = (
    TRACE
    + f"""
, p AS (SELECT track_id, seq, radians(lat_deg) AS lat, radians(lon_deg) AS lon, CAST(time_ms AS DOUBLE) AS time, elevation, power_w FROM tr),
ps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(elevation) OVER w AS pele FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
pg AS (SELECT *, CASE WHEN plat IS NULL THEN 0e0 ELSE {haversine_sql("plat", "plon", "lat", "lon")} END AS segment FROM ps),
pd AS (SELECT *, sum(segment) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS distance,
        (time - first_value(time) OVER (PARTITION BY track_id ORDER BY seq)) / 1000e0 AS elapsed FROM pg)
"""
)


def _derived() -> str:
    names = ("distance", "elevation", "time", "lat", "lon")
    near = ", ".join(f"coalesce(lag({c}) OVER w, {c}) AS b_{c}, coalesce(lead({c}) OVER w, {c}) AS a_{c}" for c in names)
    return f"""
, dn AS (SELECT *, {near} FROM pd WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
dd AS (SELECT *, (a_distance - b_distance) / 2e0 AS dx, (a_elevation - b_elevation) / 2e0 AS de, (a_time - b_time) / 2000e0 AS dt, a_lon - b_lon AS dlon FROM dn),
d AS (SELECT track_id, seq, lat, lon, time, elevation, power_w, segment, distance, elapsed, dx, dt,
        CASE WHEN dx = 0 THEN 0e0 ELSE de / dx END AS grade, CASE WHEN dt = 0 THEN 0e0 ELSE dx / dt END AS speed,
        atan2(-(a_lat - b_lat), (CASE WHEN dlon > pi() THEN dlon - 2e0 * pi() WHEN dlon <= -pi() THEN dlon + 2e0 * pi() ELSE dlon END) * cos((b_lat + a_lat) / 2e0)) AS bearing FROM dd)
"""


DERIVED = POINTS + _derived()


def milli(expr: str, unit: int = 1000) -> str:
    """A double as a whole number of thousandths: the same in every engine."""
    return f"CAST(floor(({expr}) * {unit} + 0.5) AS BIGINT)"


def m(column, unit: int = 1000):
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * unit + 0.5).cast("long")
