"""Geodesy and map projection as Column expressions: they stay in the JVM and inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.options import EARTH_RADIUS

PI = math.pi
A, E2 = 6_378_137.0, 0.00669437999014  # WGS-84
MERCATOR_LIMIT = 85.0511287798066


def d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, d(lo)), d(hi))


def wrap(a: Column) -> Column:
    """An angle difference of at most one turn too many brought into (-pi, pi]."""
    return F.when(a > PI, a - 2 * PI).when(a <= -PI, a + 2 * PI).otherwise(a)


def normalize_angle(a: Column) -> Column:
    """Into [-pi, pi] by whole turns; both ends stay as they are."""
    return F.when(F.abs(a) <= PI, a).otherwise(a - 2 * PI * F.ceil((F.abs(a) - PI) / (2 * PI)) * F.signum(a))


def unwrap(a: Column) -> Column:
    """Into (-pi, pi] by the nearest whole turn."""
    r = a - 2 * PI * F.floor(a / (2 * PI) + 0.5)
    return F.when(r <= -PI, r + 2 * PI).otherwise(r)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in radians on the mean sphere."""
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    a = clamp(a, 0, 1)
    return EARTH_RADIUS * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction of a short step: east 0, north -pi/2."""
    return F.atan2(-(lat2 - lat1), wrap(lon2 - lon1) * F.cos((lat1 + lat2) / 2))


def ecef(lat_deg: Column, lon_deg: Column, ele: Column, z: float = 3.0) -> Column:
    """struct<x, y, z>, metres from the earth's centre, heights exaggerated; a null height is 0."""
    lat, lon, h = F.radians(lat_deg), F.radians(lon_deg), F.coalesce(ele, d(0)) * z
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    return F.struct(((n + h) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + h) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - E2) + h) * F.sin(lat)).alias("z"))


def vec(x, y, z) -> Column:
    return F.struct(d(x).alias("x"), d(y).alias("y"), d(z).alias("z"))


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def plus(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def times(a: Column, k) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    m = magnitude(a)
    return F.when(m == 0, vec(0, 0, 0)).otherwise(vec(a["x"] / m, a["y"] / m, a["z"] / m))


def euclidean(a: Column, b: Column) -> Column:
    return magnitude(minus(a, b))


def point_to_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of p to the segment a-b: the projection is clamped to its ends; a segment of no length is
    its point."""
    ab = minus(b, a)
    length2 = dot(ab, ab)
    t = F.when(length2 == 0, d(0)).otherwise(clamp(dot(minus(p, a), ab) / length2, 0, 1))
    return euclidean(p, plus(a, times(ab, t)))


def tile_x(lon_deg: Column, zoom: int) -> Column:
    return (lon_deg + 180) / 360 * float(1 << zoom)


def tile_y(lat_deg: Column, zoom: int) -> Column:
    lat = F.radians(lat_deg)
    return (1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / PI) / 2 * float(1 << zoom)


def lon_to_x(lon_deg: Column, zoom: int) -> Column:
    """Map pixels, 256 a tile, clamped to the map."""
    most = 256.0 * (1 << zoom)
    return clamp((lon_deg + 180) / 360 * most, 0, most - 1)


def lat_to_y(lat_deg: Column, zoom: int) -> Column:
    most = 256.0 * (1 << zoom)
    return clamp(tile_y(clamp(lat_deg, -MERCATOR_LIMIT, MERCATOR_LIMIT), zoom) * 256, 0, most - 1)


def x_to_lon(x: Column, zoom: int) -> Column:
    return x / (256.0 * (1 << zoom)) * 360 - 180


def y_to_lat(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(PI * (1 - 2 * y / (256.0 * (1 << zoom))))))


def normalize_pixel(tx: Column, ty: Column, px: Column, py: Column, zoom: int, size: int = 256) -> Column:
    """struct<x, y, px, py>: a pixel outside its tile is carried to the neighbour; at the map's edge it stays
    on the edge."""
    last = (1 << zoom) - 1

    def carry(t, p):
        move = F.floor(p / size).cast("int")
        to = t + move
        return clamp_int(to, 0, last), F.when(to < 0, F.lit(0)).when(to > last, F.lit(size - 1)).otherwise(p - move * size)

    x, qx = carry(tx, px)
    y, qy = carry(ty, py)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), qx.cast("int").alias("px"), qy.cast("int").alias("py"))


def clamp_int(x: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a fixed ring of (lon, lat)."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (d(y1) > lat) != (d(y2) > lat)
        left = lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        inside = inside + F.when(spans & left, 1).otherwise(0)
    return inside % 2 == 1


def interpolate(a: Column, b: Column, t: Column, circular: bool) -> Column:
    """Between a (t = 0) and b (t = 1); circular quantities take the shorter arc. NaN spreads."""
    return unwrap(a + t * unwrap(b - a)) if circular else a + t * (b - a)
