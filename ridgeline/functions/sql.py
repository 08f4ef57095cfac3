"""The operators from SQL text: functions of one row, a table function, and views.

`register(spark)` makes temporary functions, so `SELECT haversine_m(...)` runs inside codegen like any
expression; `one_hz_points` is a table function over a partitioned table argument.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ridgeline.options import EARTH_RADIUS, G, Bike, Cyclist

_C, _B = Cyclist(), Bike()
_A = "least(1D, greatest(0D, pow(sin((lat2 - lat1) / 2D), 2) + cos(lat1) * cos(lat2) * pow(sin((lon2 - lon1) / 2D), 2)))"

#: name, parameters, body.
FUNCTIONS = [
    ("haversine_m", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", f"{EARTH_RADIUS}D * 2D * atan2(sqrt({_A}), sqrt(1D - {_A}))"),
    ("air_density", "elevation DOUBLE, celsius DOUBLE", f"101325D * pow(1D - 0.0065D * coalesce(nanvl(elevation, 0D), 0D) / 288.15D, {G}D / (287.05D * 0.0065D)) / (287.05D * (coalesce(nanvl(celsius, 15D), 15D) + 273.15D))"),
    ("aero_power", "speed DOUBLE, rho DOUBLE", f"-{_C.drag_coefficient * _C.frontal_area_m2 / 2}D * rho * speed * speed * speed"),
    ("gravity_power", "speed DOUBLE, grade DOUBLE, mass DOUBLE", f"-mass * {G}D * speed * sin(atan(grade))"),
    ("rolling_power", "speed DOUBLE, grade DOUBLE, mass DOUBLE", f"-cos(atan(grade)) * mass * {G}D * speed * {_B.crr}D"),
    ("bearing_power", "speed DOUBLE", "-speed * (91D + 8.7D * speed) / 1000D"),
    ("cornering_limit", "radius DOUBLE", f"CASE WHEN radius >= 200D THEN {_C.max_speed}D ELSE least({_C.max_speed}D, sqrt({G}D * radius * {_C.tan_lean}D)) END"),
    ("tile_of", "lon_deg DOUBLE, lat_deg DOUBLE, zoom INT", "named_struct('x', CAST(floor((lon_deg + 180D) / 360D * pow(2D, zoom)) AS INT), 'y', CAST(floor((1D - ln(tan(radians(lat_deg)) + 1D / cos(radians(lat_deg))) / pi()) / 2D * pow(2D, zoom)) AS INT))"),
    ("terrarium_height", "r INT, g INT, b INT", "CASE WHEN r = 0 AND g = 0 AND b = 0 THEN double('NaN') ELSE floor((r * 256D + g + b / 256D - 32768D) * 100D + 0.5D) / 100D END"),
    ("semicircles", "deg DOUBLE", "CAST(pmod(floor(deg * 2147483648D / 180D + 0.5D) + 2147483648D, 4294967296D) - 2147483648D AS BIGINT)"),
]


class OneHz:
    """Rows (track_id, time ms, value) in order of time, one partition a track: a row at each whole second."""

    def __init__(self):
        self.last = None

    def eval(self, row):
        key, t, v = row["track_id"], float(row["time"]), float(row["value"])
        if self.last is None:
            second = int(t // 1000)
            if second * 1000 == t:
                yield str(key), second, v
        else:
            t0, v0 = self.last
            for second in range(int(t0 // 1000) + 1, int(t // 1000) + 1):
                yield str(key), second, v0 + (second * 1000 - t0) / (t - t0) * (v - v0)
        self.last = (t, v)


def register(spark: SparkSession) -> None:
    for name, parameters, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.udtf.register("one_hz_points", udtf(OneHz, returnType="track_id string, second bigint, value double"))


def views(points: DataFrame) -> None:
    """`points` with motion data, and `track_stats`, as temporary views."""
    from ridgeline.operators.derive import derive, track_stats

    derive(points).createOrReplaceTempView("points")
    track_stats(points).createOrReplaceTempView("track_stats")
