"""Registered queries of the track operators over the trace, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo, physics
from ridgeline.operators import derive as D
from ridgeline.operators import energetics, motion, resample
from ridgeline.options import Wind
from ridgeline.plans import track_sql as S
from ridgeline.plans.trace import DERIVED, POINTS, TRACE, m, milli, trace, trace_points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def derived(spark: SparkSession, sf_dir: str, time_scale: float = 1.0) -> DataFrame:
    return D.derive(trace_points(spark, sf_dir, time_scale))


# --- statistics and derived data ---------------------------------------------------------------

STATS = f"""WITH {POINTS}, g AS (SELECT *, elevation - pele AS rise FROM pd), st AS (
 SELECT track_id, count(*) AS n_points, sum(segment) AS distance, coalesce(sum(CASE WHEN rise > 0 THEN rise END), 0e0) AS gain,
   coalesce(sum(CASE WHEN rise <= 0 THEN rise END), 0e0) AS loss, min(elevation) AS lo, max(elevation) AS hi,
   CASE WHEN count(*) >= 2 THEN max_by(time, seq) - min_by(time, seq) ELSE 0e0 END AS duration, min(lat) AS lat0, max(lat) AS lat1 FROM g GROUP BY track_id)"""


@register("path_stats", STATS + f" SELECT track_id, n_points, {milli('distance')} AS distance_mm, {milli('gain')} AS gain_mm, {milli('loss')} AS loss_mm, {milli('lo')} AS min_mm, {milli('hi')} AS max_mm, {milli('duration', 1)} AS duration_ms, {milli('lat0', 1000000)} AS min_lat, {milli('lat1', 1000000)} AS max_lat FROM st")
def path_stats(spark, sf_dir):
    s = D.track_stats(trace_points(spark, sf_dir))
    return s.select("track_id", "n_points", m("distance").alias("distance_mm"), m("gain").alias("gain_mm"), m("loss").alias("loss_mm"), m("min_elevation").alias("min_mm"), m("max_elevation").alias("max_mm"), m("duration_ms", 1).alias("duration_ms"), m("min_lat", 1000000).alias("min_lat"), m("max_lat", 1000000).alias("max_lat"))


@register("derived_points", f"WITH {DERIVED} SELECT track_id, seq, {milli('distance')} AS distance, {milli('elapsed')} AS elapsed, {milli('dx')} AS dx, {milli('dt')} AS dt, {milli('grade')} AS grade, {milli('speed')} AS speed, {milli('bearing')} AS bearing FROM d")
def derived_points(spark, sf_dir):
    return derived(spark, sf_dir).select("track_id", "seq", *[m(c).alias(c) for c in ("distance", "elapsed", "dx", "dt", "grade", "speed", "bearing")])


@register("haversine_segments", f"WITH {POINTS} SELECT track_id, seq, {milli('segment')} AS segment FROM pg")
def haversine_segments(spark, sf_dir):
    return D.segments(trace_points(spark, sf_dir)).select("track_id", "seq", m("segment").alias("segment"))


@register("sub_path", f"WITH {TRACE} SELECT track_id, seq - 5 AS seq, {milli('elevation')} AS elevation FROM tr WHERE seq >= 5 AND seq < 20")
def sub_path(spark, sf_dir):
    return D.sub_path(trace(spark, sf_dir), 5, 20).select("track_id", "seq", m("elevation").alias("elevation"))


@register("without_time", f"WITH {POINTS} SELECT track_id, count(*) AS n, {milli('max(distance)')} AS distance, CAST(0 AS BIGINT) AS speed FROM pd GROUP BY track_id")
def without_time(spark, sf_dir):
    d = D.without_time(trace_points(spark, sf_dir))
    return d.groupBy("track_id").agg(F.count("*").alias("n"), m(F.max("distance")).alias("distance"), m(F.max(F.abs("speed"))).alias("speed"))


@register("track_rollup", STATS + f" SELECT coalesce(track_id, -1) AS track_id, sum(n_points)::BIGINT AS n_points, {milli('sum(distance)')} AS distance_mm FROM st GROUP BY ROLLUP (track_id)")
def track_rollup(spark, sf_dir):
    return D.totals(D.track_stats(trace_points(spark, sf_dir))).select(F.coalesce("track_id", F.lit(-1)).alias("track_id"), "n_points", m("distance").alias("distance_mm"))


@register("bounding_box", f"WITH {POINTS} SELECT {milli('min(lat)', 1000000)} AS lat0, {milli('max(lat)', 1000000)} AS lat1, {milli('min(lon)', 1000000)} AS lon0, {milli('max(lon)', 1000000)} AS lon1 FROM p")
def bounding_box(spark, sf_dir):
    b = D.bounds(trace_points(spark, sf_dir))
    return b.select(m("min_latitude", 1000000).alias("lat0"), m("max_latitude", 1000000).alias("lat1"), m("min_longitude", 1000000).alias("lon0"), m("max_longitude", 1000000).alias("lon1"))


# --- geodesy -----------------------------------------------------------------------------------


@register("ecef", f"WITH {TRACE}, e AS (SELECT *, 6378137e0 / sqrt(1e0 - 0.00669437999014e0 * pow(sin(radians(lat_deg)), 2)) AS n FROM tr) SELECT track_id, seq, {milli('(n + elevation * 3e0) * cos(radians(lat_deg)) * cos(radians(lon_deg))', 10)} AS x, {milli('(n + elevation * 3e0) * cos(radians(lat_deg)) * sin(radians(lon_deg))', 10)} AS y, {milli('(n * (1e0 - 0.00669437999014e0) + elevation * 3e0) * sin(radians(lat_deg))', 10)} AS z FROM e")
def ecef(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("e", geo.ecef(F.col("lat_deg"), F.col("lon_deg"), F.col("elevation")))
    return t.select("track_id", "seq", *[m(F.col(f"e.{c}"), 10).alias(c) for c in "xyz"])


@register("tile_xy", f"WITH {TRACE} SELECT track_id, seq, CAST(floor((lon_deg + 180e0) / 360e0 * 4096e0) AS BIGINT) AS x, CAST(floor((1e0 - ln(tan(radians(lat_deg)) + 1e0 / cos(radians(lat_deg))) / pi()) / 2e0 * 4096e0) AS BIGINT) AS y FROM tr")
def tile_xy(spark, sf_dir):
    t = trace(spark, sf_dir)
    return t.select("track_id", "seq", F.floor(geo.tile_x(F.col("lon_deg"), 12)).cast("long").alias("x"), F.floor(geo.tile_y(F.col("lat_deg"), 12)).cast("long").alias("y"))


@register("mercator_pixels", f"WITH {TRACE} SELECT track_id, seq, {milli('(lon_deg + 180e0) / 360e0 * 1048576e0', 100)} AS x, {milli('(1e0 - ln(tan(radians(lat_deg)) + 1e0 / cos(radians(lat_deg))) / pi()) / 2e0 * 4096e0 * 256e0', 100)} AS y FROM tr")
def mercator_pixels(spark, sf_dir):
    t = trace(spark, sf_dir)
    return t.select("track_id", "seq", m(geo.lon_to_x(F.col("lon_deg"), 12), 100).alias("x"), m(geo.lat_to_y(F.col("lat_deg"), 12), 100).alias("y"))


RING = [(6.0, 45.2), (6.0008, 45.25), (6.001, 45.6), (6.0003, 45.55), (5.9999, 45.7)]


def _ring_sql() -> str:
    tests = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True):
        tests.append(f"CASE WHEN (({y1}e0 > lat_deg) <> ({y2}e0 > lat_deg)) AND lon_deg < ({x2}e0 - {x1}e0) * (lat_deg - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END")
    return " + ".join(tests)


@register("point_in_polygon", f"WITH {TRACE} SELECT track_id, CAST(sum(CASE WHEN ({_ring_sql()}) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM tr GROUP BY track_id")
def point_in_polygon(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("i", geo.in_polygon(F.col("lon_deg"), F.col("lat_deg"), RING))
    return t.groupBy("track_id").agg(F.sum(F.when(F.col("i"), 1).otherwise(0)).cast("long").alias("inside"))


@register("bearing_wrap", f"WITH {TRACE}, a AS (SELECT track_id, seq, radians(((seq * 37 + track_id * 11) % 1440) - 720.5e0) AS v FROM tr), b AS (SELECT *, v - 2e0 * pi() * floor(v / (2e0 * pi()) + 0.5e0) AS r FROM a) SELECT track_id, seq, {milli('CASE WHEN r <= -pi() THEN r + 2e0 * pi() ELSE r END')} AS angle FROM b")
def bearing_wrap(spark, sf_dir):
    a = F.radians((F.col("seq") * 37 + F.col("track_id") * 11) % 1440 - 720.5)
    return trace(spark, sf_dir).select("track_id", "seq", m(geo.unwrap(a)).alias("angle"))


@register("segment_distance", f"WITH {TRACE}, v AS (SELECT track_id, seq, elevation AS px, power_w AS py, CAST(seq AS DOUBLE) AS pz, 100e0 AS x1, 200e0 AS y1, 0e0 AS z1, 400e0 AS x2, 300e0 AS y2, 50e0 AS z2 FROM tr), u AS (SELECT *, least(1e0, greatest(0e0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) + (pz - z1) * (z2 - z1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)))) AS k FROM v) SELECT track_id, seq, {milli('sqrt(pow(px - x1 - k * (x2 - x1), 2) + pow(py - y1 - k * (y2 - y1), 2) + pow(pz - z1 - k * (z2 - z1), 2))')} AS dist FROM u")
def segment_distance(spark, sf_dir):
    p = geo.vec(F.col("elevation"), F.col("power_w"), F.col("seq").cast("double"))
    return trace(spark, sf_dir).select("track_id", "seq", m(geo.point_to_segment(p, geo.vec(100, 200, 0), geo.vec(400, 300, 50))).alias("dist"))


# --- physics -----------------------------------------------------------------------------------

G_ = "9.80665e0"


@register("air_density", f"WITH {TRACE} SELECT track_id, seq, {milli('101325e0 * pow(1e0 - 0.0065e0 * elevation / 288.15e0, 9.80665e0 / (287.05e0 * 0.0065e0)) / (287.05e0 * 288.15e0)', 100000)} AS rho FROM tr")
def air_density(spark, sf_dir):
    return trace(spark, sf_dir).select("track_id", "seq", m(physics.air_density(F.col("elevation"), F.lit(float("nan"))), 100000).alias("rho"))


POWERS = f"(91e0 + 8.7e0 * speed) * -speed / 1000e0 AS wb, -cos(atan(grade)) * 80e0 * {G_} * speed * 0.004e0 AS rr, -(0.7e0 * 0.5e0 * 1.225e0 / 2e0) * speed * speed * speed AS pa, -80e0 * {G_} * speed * sin(atan(grade)) AS pg"


@register("power_balance", f"WITH {DERIVED}, f AS (SELECT *, {POWERS} FROM d) SELECT track_id, seq, {milli('pa')} AS aero, {milli('pg')} AS gravity, {milli('rr')} AS rolling, {milli('wb')} AS bearings FROM f")
def power_balance(spark, sf_dir):
    f = motion.forces(derived(spark, sf_dir))
    return f.select("track_id", "seq", m("pAero").alias("aero"), m("pGravity").alias("gravity"), m("pRollingResistance").alias("rolling"), m("pWheelBearings").alias("bearings"))


@register("aero_power_wind", f"WITH {DERIVED}, a AS (SELECT *, speed * 1000e0 AS v, (pi() / 2e0 - 1e0) - bearing AS alpha FROM d), b AS (SELECT *, v + 3e0 * cos(alpha) AS l1, v * v + 9e0 + 2e0 * v * 3e0 * cos(alpha) AS l3 FROM a), c AS (SELECT *, CASE WHEN l3 = 0 THEN 0e0 ELSE l1 * l1 / l3 END AS l4 FROM b) SELECT track_id, seq, {milli('-(0.7e0 * 0.5e0 * 1.225e0 / 2e0) * (l4 + 1.2e0 * (1e0 - l4)) * sqrt(greatest(l3, 0e0)) * l1 * v', 100)} AS aero FROM c")
def aero_power_wind(spark, sf_dir):
    d = derived(spark, sf_dir).withColumn("speed", F.col("speed") * 1000)
    return motion.forces(d, wind=Wind(3.0, 1.0)).select("track_id", "seq", m("pAero", 100).alias("aero"))


@register("inverse_power", f"WITH {DERIVED}, f AS (SELECT *, {POWERS} FROM d), l AS (SELECT *, lag(wb + rr + pa + pg) OVER w AS drag, lag(speed) OVER w AS v1 FROM f WINDOW w AS (PARTITION BY track_id ORDER BY seq)), e AS (SELECT track_id, seq, CASE WHEN v1 IS NULL OR dt <= 0 THEN 0e0 ELSE 0.5e0 * (80e0 + 0.12e0 / 0.1225e0) * (speed * speed - v1 * v1) / dt END AS total, CASE WHEN v1 IS NULL OR dt <= 0 THEN 0e0 ELSE 0.5e0 * (80e0 + 0.12e0 / 0.1225e0) * (speed * speed - v1 * v1) / dt - drag END AS wheel FROM l) SELECT track_id, seq, {milli('total')} AS total, {milli('wheel')} AS wheel, {milli('least(0e0, wheel)')} AS brake, {milli('greatest(0e0, wheel) / 0.976e0')} AS power FROM e")
def inverse_power(spark, sf_dir):
    f = motion.inverse_power(derived(spark, sf_dir))
    return f.select("track_id", "seq", m("pComputedTotalPower").alias("total"), m("pComputedWheelPower").alias("wheel"), m("pBrake").alias("brake"), m("pComputedPower").alias("power"))


RADIUS = f"""{DERIVED}, tn AS (SELECT *, bearing - lag(bearing) OVER (PARTITION BY track_id ORDER BY seq) AS raw FROM d),
tw AS (SELECT *, coalesce(CASE WHEN raw > pi() THEN raw - 2e0 * pi() WHEN raw < -pi() THEN raw + 2e0 * pi() ELSE raw END, 0e0) AS turn FROM tn),
tr2 AS (SELECT *, abs(coalesce(sum(turn) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING), 0e0)) AS chg, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn,
  last_value(distance) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) - first_value(distance) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS way FROM tw),
rad AS (SELECT *, CASE WHEN chg < 0.001e0 THEN 200e0 ELSE least(200e0, greatest(5e0, way / chg)) END AS radius FROM tr2),
cor AS (SELECT *, CASE WHEN radius >= 200e0 THEN 100e0 / 3.6e0 ELSE least(100e0 / 3.6e0, sqrt({G_} * radius * tan(radians(35e0)))) END AS corner FROM rad)"""


@register("windowed_radius", f"WITH {RADIUS} SELECT track_id, seq, {milli('radius', 10)} AS radius FROM rad")
def windowed_radius(spark, sf_dir):
    return motion.windowed_radius(derived(spark, sf_dir)).select("track_id", "seq", m("radius", 10).alias("radius"))


@register("cornering_limit", f"WITH {RADIUS} SELECT track_id, seq, {milli('corner', 100)} AS corner FROM cor")
def cornering_limit(spark, sf_dir):
    d = motion.windowed_radius(derived(spark, sf_dir))
    return d.select("track_id", "seq", m(physics.cornering_limit(F.col("radius")), 100).alias("corner"))


@register("braking_free", f"WITH RECURSIVE {RADIUS}, x AS (SELECT track_id, seq, distance, corner, row_number() OVER (PARTITION BY track_id ORDER BY seq DESC) AS k FROM cor), f AS (SELECT track_id, seq, k, distance, 2e0 AS v FROM x WHERE k = 1 UNION ALL SELECT x.track_id, x.seq, x.k, x.distance, least(x.corner, sqrt(f.v * f.v + 2e0 * 0.4e0 * {G_} * (f.distance - x.distance))) FROM f JOIN x ON x.track_id = f.track_id AND x.k = f.k + 1) SELECT track_id, seq, {milli('v', 100)} AS v FROM f")
def braking_free(spark, sf_dir):
    """The braking fold with all grip for braking (radius taken as straight)."""
    d = motion.windowed_radius(derived(spark, sf_dir)).withColumn("speedMaxIncline", physics.cornering_limit(F.col("radius"))).withColumn("radius", F.lit(200.0))
    return motion.braking_pass(d.select("track_id", "seq", "distance", "radius", "speedMaxIncline")).select("track_id", "seq", m("speedMax", 100).alias("v"))


#: A point's limit takes one step, or one step for each of 24 halvings: `it` counts them, 99 is a point's result.
SLACK = "(after * after + 2e0 * a * sqrt(1e0 - pow(least(1e0, greatest(0e0, {v} * {v} / radius / hold)), 2)) * way - {v} * {v})"
BRAKING = f"""WITH RECURSIVE {RADIUS}, x AS MATERIALIZED (SELECT track_id, seq, distance, corner, radius, row_number() OVER (PARTITION BY track_id ORDER BY seq DESC) AS k FROM cor),
f AS (SELECT track_id, seq, k, 99 AS it, distance, 0e0 AS way, 0e0 AS after, 0e0 AS lo, 0e0 AS hi, 2e0 AS v FROM x WHERE k = 1
UNION ALL SELECT track_id, seq, k, CASE WHEN fresh AND (straight OR whole) THEN 99 WHEN fresh THEN 0 WHEN it = 23 THEN 99 ELSE it + 1 END, distance, way, after,
 CASE WHEN fresh THEN least(after, corner) WHEN ok THEN mid ELSE lo END, CASE WHEN fresh THEN corner WHEN ok THEN hi ELSE mid END,
 CASE WHEN fresh AND straight THEN least(corner, sqrt(after * after + 2e0 * a * way)) WHEN fresh THEN corner WHEN ok THEN mid ELSE lo END
 FROM (SELECT *, radius >= 200e0 AS straight, {SLACK.format(v="corner")} >= 0 AS whole, {SLACK.format(v="mid")} >= 0 AS ok
  FROM (SELECT x.track_id, x.seq, x.k, f.it, f.it = 99 AS fresh, x.distance, x.radius, x.corner, 0.4e0 * {G_} AS a, {G_} * tan(radians(35e0)) AS hold, f.lo, f.hi, (f.lo + f.hi) / 2e0 AS mid,
   CASE WHEN f.it = 99 THEN f.distance - x.distance ELSE f.way END AS way, CASE WHEN f.it = 99 THEN f.v ELSE f.after END AS after
   FROM f JOIN x ON x.track_id = f.track_id AND x.k = f.k + CASE WHEN f.it = 99 THEN 1 ELSE 0 END)))
SELECT track_id, seq, {milli('v', 100)} AS v FROM f WHERE it = 99"""


@register("braking_pass", BRAKING)
def braking_pass(spark, sf_dir):
    d = motion.windowed_radius(derived(spark, sf_dir)).withColumn("speedMaxIncline", physics.cornering_limit(F.col("radius")))
    return motion.braking_pass(d.select("track_id", "seq", "distance", "radius", "speedMaxIncline")).select("track_id", "seq", m("speedMax", 100).alias("v"))


# --- energetics --------------------------------------------------------------------------------


@register("wprime_balance", f"WITH RECURSIVE {TRACE}, b AS (SELECT track_id, seq, time_ms, power_w, 20000e0 AS w FROM tr WHERE seq = 0 UNION ALL SELECT x.track_id, x.seq, x.time_ms, x.power_w, CASE WHEN x.time_ms > b.time_ms THEN least(20000e0, greatest(0e0, CASE WHEN x.power_w >= 250e0 THEN b.w - (x.power_w - 250e0) * ((x.time_ms - b.time_ms) / 1000e0 / 1000e0) ELSE 20000e0 - (20000e0 - b.w) * exp(-(250e0 - x.power_w) * ((x.time_ms - b.time_ms) / 1000e0 / 1000e0) / 20000e0) END)) ELSE b.w END FROM b JOIN tr x ON x.track_id = b.track_id AND x.seq = b.seq + 1) SELECT track_id, seq, {milli('w', 10)} AS w FROM b")
def wprime_balance(spark, sf_dir):
    d = trace_points(spark, sf_dir, 0.001)
    return energetics.w_prime_balance(d, "pInputPower").select("track_id", "seq", m("wPrimeBalance", 10).alias("w"))


HYST = f"""WITH RECURSIVE {TRACE}, n AS (SELECT track_id, count(*) AS n FROM tr GROUP BY track_id),
f AS (SELECT track_id, seq, 0 AS way, FALSE AS hl, 0 AS legs, elevation AS h0, elevation AS hi, elevation AS lo, elevation AS ref, elevation AS ext, 0e0 AS gain, 0e0 AS loss FROM tr WHERE seq = 0
UNION ALL SELECT y.track_id, y.seq,
 CASE WHEN y.opens AND y.hl2 THEN 1 WHEN y.opens THEN -1 WHEN y.turns THEN -y.way ELSE y.way END, y.hl2,
 y.legs + CASE WHEN (y.opens AND y.hl2 AND y.lo2 < y.h0) OR (y.opens AND NOT y.hl2 AND y.hi2 > y.h0) OR y.turns THEN 1 ELSE 0 END, y.h0,
 CASE WHEN y.way = 0 THEN y.hi2 ELSE y.hi END, CASE WHEN y.way = 0 THEN y.lo2 ELSE y.lo END,
 CASE WHEN y.opens AND y.hl2 THEN y.lo2 WHEN y.opens THEN y.hi2 WHEN y.turns THEN y.ext ELSE y.ref END,
 CASE WHEN y.opens AND y.hl2 THEN y.hi2 WHEN y.opens THEN y.lo2 WHEN y.further OR y.turns THEN y.e ELSE y.ext END,
 y.gain + CASE WHEN y.opens AND NOT y.hl2 AND y.hi2 > y.h0 THEN y.hi2 - y.h0 WHEN y.turns AND y.way > 0 THEN y.ext - y.ref ELSE 0e0 END,
 y.loss + CASE WHEN y.opens AND y.hl2 AND y.lo2 < y.h0 THEN y.lo2 - y.h0 WHEN y.turns AND y.way < 0 THEN y.ext - y.ref ELSE 0e0 END
 FROM (SELECT z.*, (z.way <> 0 AND NOT z.further AND (z.ext - z.e) * z.way >= 30e0) AS turns, (z.way = 0 AND z.hi2 - z.lo2 >= 30e0) AS opens
  FROM (SELECT f.*  EXCLUDE (seq), x.seq, x.elevation AS e, greatest(f.hi, x.elevation) AS hi2, least(f.lo, x.elevation) AS lo2,
    CASE WHEN x.elevation > f.hi THEN TRUE WHEN x.elevation < f.lo THEN FALSE ELSE f.hl END AS hl2,
    ((f.way > 0 AND x.elevation > f.ext) OR (f.way < 0 AND x.elevation < f.ext)) AS further
    FROM f JOIN tr x ON x.track_id = f.track_id AND x.seq = f.seq + 1) z) y)
SELECT f.track_id, {milli('gain + CASE WHEN way > 0 AND ext > ref THEN ext - ref ELSE 0e0 END', 100)} AS gain, {milli('loss + CASE WHEN way < 0 AND ext < ref THEN ext - ref ELSE 0e0 END', 100)} AS loss,
 CAST(legs + CASE WHEN way <> 0 AND (ext - ref) * way > 0 THEN 1 ELSE 0 END AS INTEGER) AS legs FROM f JOIN n ON n.track_id = f.track_id AND f.seq = n.n - 1"""


@register("hysteresis_gain", HYST)
def hysteresis_gain(spark, sf_dir):
    g = energetics.hysteresis_gain(trace(spark, sf_dir), 30.0)
    return g.select("track_id", m("gain", 100).alias("gain"), m("loss", 100).alias("loss"), "legs")


@register("gain_presets", S.PRESETS)
def gain_presets(spark, sf_dir):
    return energetics.gain_sweep(derived(spark, sf_dir)).select("track_id", "preset", m("gain").alias("gain"), m("loss").alias("loss"), "legs")


@register("gain_grid_pivot", S.GRID)
def gain_grid_pivot(spark, sf_dir):
    g = energetics.gain_grid(derived(spark, sf_dir))
    return g.select("track_id", "window_m", *[m(F.col(f"`{c}`")).alias(f"t{c}") for c in g.columns[2:]])


# --- resampling --------------------------------------------------------------------------------


@register("one_hz", f"""WITH {POINTS}, q AS (SELECT track_id, seq, time * 1e-5 AS t, elevation, lead(time * 1e-5) OVER w AS nt, lead(elevation) OVER w AS ne FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 s AS (SELECT *, CAST(floor(t / 1000e0) AS BIGINT) AS e1, CAST(floor(nt / 1000e0) AS BIGINT) AS e2 FROM q),
 x AS (SELECT track_id, seq, unnest(generate_series(CASE WHEN t = e1 * 1000e0 THEN e1 ELSE e1 + 1 END, e2)) AS e, t, nt, elevation, ne FROM s WHERE nt IS NOT NULL AND e1 <> e2
  UNION ALL SELECT track_id, seq, e1, t, NULL, elevation, NULL FROM s WHERE seq = 0
  UNION ALL SELECT track_id, seq, e1 + 1, t, NULL, elevation, NULL FROM s WHERE nt IS NULL AND t <> e1 * 1000e0),
 y AS (SELECT *, row_number() OVER (PARTITION BY track_id, e ORDER BY seq DESC, nt DESC NULLS LAST) AS rk FROM x)
 SELECT track_id, count(*) AS n, min(e) AS e0, max(e) AS e1, {milli('sum(CASE WHEN nt IS NULL OR nt <= t THEN elevation ELSE elevation + (e * 1000e0 - t) / (nt - t) * (ne - elevation) END)', 10)} AS total FROM y WHERE rk = 1 GROUP BY track_id""")
def one_hz(spark, sf_dir):
    d = trace_points(spark, sf_dir, 1e-5).select("track_id", "seq", "time", "elevation")
    e = resample.one_hz(d, rederive=False)
    sec = (F.col("time") / 1000).cast("long")
    return e.groupBy("track_id").agg(F.count("*").alias("n"), F.min(sec).alias("e0"), F.max(sec).alias("e1"), m(F.sum("elevation"), 10).alias("total"))


@register("densify_5m", f"""WITH {POINTS}, q AS (SELECT track_id, seq, distance, elevation, lead(distance) OVER w - distance AS gap, lead(elevation) OVER w AS ne FROM pd WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 s AS (SELECT *, CAST(CASE WHEN gap > 5e0 THEN ceil(gap / 5e0) ELSE 1 END AS BIGINT) AS k FROM q), x AS (SELECT *, unnest(generate_series(0, k - 1)) AS j FROM s)
 SELECT track_id, count(*) AS n, {milli('sum(CASE WHEN j = 0 THEN elevation ELSE elevation + CAST(j AS DOUBLE) / k * (ne - elevation) END)', 10)} AS total FROM x GROUP BY track_id""")
def densify_5m(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation")
    x = resample.densify(d, 5.0, rederive=False)
    return x.groupBy("track_id").agg(F.count("*").alias("n"), m(F.sum("elevation"), 10).alias("total"))


@register("stations_asof", f"""WITH {POINTS}, q AS (SELECT track_id, seq, distance AS a, elevation AS ea, lead(distance) OVER w AS b, lead(elevation) OVER w AS eb FROM pd WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 s AS (SELECT *, CASE WHEN seq = 0 THEN 0 ELSE CAST(floor(a / 25e0) AS BIGINT) + 1 END AS lo, CAST(floor(b / 25e0) AS BIGINT) AS hi FROM q WHERE b IS NOT NULL), x AS (SELECT *, unnest(generate_series(lo, hi)) AS k FROM s WHERE hi >= lo)
 SELECT track_id, k, {milli('CASE WHEN b > a AND k * 25e0 - a <> 0 THEN ea + (k * 25e0 - a) / (b - a) * (eb - ea) ELSE ea END', 100)} AS elevation FROM x""")
def stations_asof(spark, sf_dir):
    return resample.stations(derived(spark, sf_dir), 25.0, ("elevation",)).select("track_id", "k", m("elevation", 100).alias("elevation"))


@register("coursepoint_snap", f"""WITH {POINTS}, w AS (SELECT DISTINCT track_id, track_id % 7 * 50e0 + 33e0 AS s FROM pd), c AS (SELECT w.track_id, w.s, pd.seq, pd.distance, abs(pd.distance - w.s) AS gap FROM w JOIN pd ON pd.track_id = w.track_id), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY gap, distance, seq) AS k FROM c) SELECT track_id, seq, {milli('distance')} AS distance FROM r WHERE k = 1""")
def coursepoint_snap(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance")
    wanted = d.select("track_id").distinct().withColumn("s", F.col("track_id") % 7 * 50.0 + 33.0)
    return resample.nearest(d, wanted).select("track_id", "seq", m("distance").alias("distance"))


@register("elevation_at", f"""WITH {POINTS}, w AS (SELECT DISTINCT track_id, track_id % 7 * 50e0 + 33e0 AS s FROM pd), q AS (SELECT track_id, distance AS a, elevation AS ea, lead(distance) OVER (PARTITION BY track_id ORDER BY seq) AS b, lead(elevation) OVER (PARTITION BY track_id ORDER BY seq) AS eb FROM pd) SELECT w.track_id, {milli('ea + (s - a) / (b - a) * (eb - ea)', 100)} AS elevation FROM w JOIN q ON q.track_id = w.track_id AND a < s AND s <= b""")
def elevation_at(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation")
    wanted = d.select("track_id").distinct().withColumn("s", F.col("track_id") % 7 * 50.0 + 33.0)
    ends = d.groupBy("track_id").agg(F.max("distance").alias("end"))
    return resample.values_at(d, wanted).join(ends, "track_id").where("s <= end").select("track_id", m("elevation", 100).alias("elevation"))


@register("decimate", f"WITH {TRACE}, n AS (SELECT track_id, max(seq) AS last FROM tr GROUP BY track_id) SELECT tr.track_id, tr.seq FROM tr JOIN n ON n.track_id = tr.track_id WHERE seq % 7 = 0 OR seq = last")
def decimate(spark, sf_dir):
    return resample.decimate(trace(spark, sf_dir), 7).select("track_id", "seq")


@register("fill_linear", f"WITH {TRACE}, h AS (SELECT track_id, seq, CASE WHEN seq % 4 = 0 THEN elevation END AS v FROM tr), k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS sa, last_value(v IGNORE NULLS) OVER w AS va, first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER x AS sb, first_value(v IGNORE NULLS) OVER x AS vb FROM h WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT track_id, seq, {milli('CASE WHEN sb IS NULL OR sb = sa THEN va ELSE va + (seq - sa) / CAST(sb - sa AS DOUBLE) * (vb - va) END', 100)} AS v FROM k")
def fill_linear(spark, sf_dir):
    d = trace(spark, sf_dir).withColumn("v", F.when(F.col("seq") % 4 == 0, F.col("elevation")))
    return resample.fill_linear(d, "v").select("track_id", "seq", m("v", 100).alias("v"))


@register("densified_bound", STATS + " SELECT track_id, CAST(n_points + ceil(distance / 30e0) + ceil(distance / 2e0) AS BIGINT) AS point_bound FROM st")
def densified_bound(spark, sf_dir):
    return resample.densified_bound(D.track_stats(trace_points(spark, sf_dir))).select("track_id", "point_bound")

