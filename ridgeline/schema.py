"""The point table: one row for each point of a track, 44 numeric columns in a fixed order.

`track_id, seq` identify a point; order is data. Angles are in radians, `time` in milliseconds, `elapsed`
and `dt` in seconds, `grade` is a ratio. A missing measurement is NaN, as the fold and sequence operators
expect; `to_null` gives SQL nulls at the edges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name, unit, description, category, flags (n: NaN by default, c: circular when
# interpolated, s: not offered for selection, a: an angle in radians).
_FIELDS = """
latitude|radians|Latitude (radians)|coordinates|sa
longitude|radians|Longitude (radians)|coordinates|csa
distance|meters|Distance (meters)|coordinates|
dx|meters|dx (meters)|coordinates|
time|ms|Timestamp (ms since epoch)|temporal|s
elapsed|s|Elapsed duration (s)|temporal|
dt|s|dt (s)|temporal|
bearing|radians|Direction bearing (radians)|angles|ca
elevation|meters|Elevation (meters)|elevation|
grade|%|Road grade/slope (%)|grade|
radius|meters|Turn radius (meters)|radius|
aeroCoef|aero|Aerodynamic coefficient|aero_coef|
windBearing|radians|Wind bearing (radians)|cyclist_wind|ca
windAlpha|radians|Wind angle (radians)|cyclist_wind|ca
pAero|watts|Aerodynamic power|power_physics|
pGravity|watts|Gravitational power|power_physics|
pRollingResistance|watts|Rolling resistance power|power_physics|
pWheelBearings|watts|Wheel bearings power|power_physics|
pInputPower|watts|GPX input power|power_cyclist|
pCyclistProvidedOptimalPower|watts|Optimal power|power_cyclist|
pCyclistProvidedOptimalPowerWithHarmonics|watts|Optimal power with harmonics|power_cyclist|
pCyclistPowerNeeded|watts|Power needed|power_cyclist|
pCyclistProvidedMuscular|watts|Raw cyclist power|power_cyclist|
pCyclistProvidedWheel|watts|Cyclist power transmitted to ground|power_cyclist|
pComputedTotalPower|watts|Power from kinetic energy change|power_post|
pComputedWheelPower|watts|Wheel power from kinetic energy change|power_post|
pComputedPower|watts|Total power (watts)|power_post|
speed|m/s|Current speed (m/s)|speed|
speedMax|m/s|Maximum speed (m/s)|speed|
speedMaxIncline|m/s|Max speed on incline (m/s)|speed|
virtSpeedCurrent|m/s|Virtual current speed (m/s)|speed|
temperature|celsius|Temperature (celsius)|environmental|
windSpeed|m/s|Wind speed (m/s)|environmental|
windDirection|radians|Wind direction (radians)|environmental|ca
heartRate|bpm|Heart rate (bpm)|physiological|
cadence|rpm|Pedaling cadence (rpm)|physiological|
wPrimeBalance|joules|W′ balance (J)|physiological|
pBrake|watts|Braking power|power_physics|
trajectoryCurvature|1/m|Trajectory curvature (1/m, + = left)|radius|n
roadWidth|meters|Road width (m)|road|n
lateralOffset|meters|Lateral offset (m, + = left)|road|n
sourceLatitude|radians|Original latitude before the racing line (radians)|road|nsa
sourceLongitude|radians|Original longitude before the racing line (radians)|road|cnsa
sourceElevation|meters|Original elevation before smoothing (m)|elevation|ns
"""
CATALOG = [tuple(line.split("|")) for line in _FIELDS.strip().split("\n")]
FIELDS = [c[0] for c in CATALOG]
UNITS = {c[0]: c[1] for c in CATALOG}
NAN_DEFAULT = frozenset(c[0] for c in CATALOG if "n" in c[4])
CIRCULAR = frozenset(c[0] for c in CATALOG if "c" in c[4])
KEYS = ["track_id", "seq"]
COLUMNS = KEYS + FIELDS

POINTS = T.StructType(
    [T.StructField("track_id", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.DoubleType(), True, {"unit": u, "description": d, "category": c, "ordinal": i, "selectable": "s" not in f, "angle": "a" in f}) for i, (n, u, d, c, f) in enumerate(CATALOG)]
)


def default(name: str) -> float:
    return math.nan if name in NAN_DEFAULT else 0.0


def field_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, n, u, d, c, "s" not in f, "a" in f, "n" in f, "c" in f) for i, (n, u, d, c, f) in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "ordinal int, prop string, unit string, description string, category string, selectable boolean, angle boolean, nan_default boolean, circular boolean")


def points(df: DataFrame) -> DataFrame:
    """The rows as a complete point table: missing columns get their defaults, others are cast."""
    have = {c.lower(): c for c in df.columns}
    cols = [F.col("track_id").cast("string").alias("track_id"), F.col("seq").cast("long").alias("seq")]
    for n in FIELDS:
        cols.append((F.coalesce(F.col(have[n.lower()]).cast("double"), F.lit(default(n))) if n.lower() in have else F.lit(default(n))).alias(n))
    return df.select(*cols)


def to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
