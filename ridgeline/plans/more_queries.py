"""Registered queries of the shape, terrain, road, format and relational operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.operators import derive as D
from ridgeline.operators import motion, resample, road, shape, terrain
from ridgeline.operators.windows import in_order
from ridgeline.plans import enhance as E
from ridgeline.plans import track_sql as S
from ridgeline.plans.queries import derived, register
from ridgeline.plans.trace import DERIVED, POINTS, TRACE, haversine_sql, m, milli, trace, trace_points
from ridgeline.schema import points
from ridgeline.sources import fit, gpx, text


def complete(spark, sf_dir, scale: float = 1.0):
    """The trace as a complete point table with motion data."""
    return points(derived(spark, sf_dir, scale))


# --- shape -------------------------------------------------------------------------------------

HEAD = f"""WITH {POINTS}, h AS (SELECT track_id, seq, (lon - first_value(lon) OVER w) * cos(first_value(lat) OVER w) AS dx, lat - first_value(lat) OVER w AS dy FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 u AS (SELECT *, sqrt(dx * dx + dy * dy) AS l FROM h), g AS (SELECT track_id, count(*) AS n, sum(CASE WHEN l >= 1e-12 THEN dx / l END) / (count(*) - 1) AS x, sum(CASE WHEN l >= 1e-12 THEN dy / l END) / (count(*) - 1) AS y FROM u GROUP BY track_id HAVING count(*) > 3),
 a AS (SELECT track_id, degrees(atan2(-x, -y)) AS d FROM g)"""


@register("dominant_headwind", HEAD + f" SELECT track_id, {milli('CASE WHEN d < 0 THEN d + 360e0 ELSE d END')} AS azimuth FROM a")
def dominant_headwind(spark, sf_dir):
    return shape.headwind(trace_points(spark, sf_dir)).select("track_id", m("azimuth_deg").alias("azimuth"))


@register("triangular_smooth", f"WITH {POINTS} SELECT a.track_id, a.seq, {milli('sum((1e0 - abs(b.distance - a.distance) / 60e0) * b.elevation) / sum(1e0 - abs(b.distance - a.distance) / 60e0)', 100)} AS elevation FROM pd a JOIN pd b ON a.track_id = b.track_id AND abs(b.distance - a.distance) < 60e0 GROUP BY a.track_id, a.seq")
def triangular_smooth(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation")
    return shape.smooth_samples(d, 60.0).select("track_id", "seq", m("smoothed", 100).alias("elevation"))


@register("kernel_smooth", S.SMOOTH)
def kernel_smooth(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation")
    return shape.smooth_profile(d, 150.0).select("track_id", "seq", m("smoothed", 100).alias("elevation"))


HEADING = f"""{DERIVED}, hx AS (SELECT *, lon * cos(avg(lat) OVER (PARTITION BY track_id)) AS x, lat AS y FROM d),
 hr AS (SELECT *, atan2(coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y), coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) AS raw FROM hx WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 hc AS (SELECT *, raw - lag(raw) OVER (PARTITION BY track_id ORDER BY seq) AS c FROM hr),
 hw AS (SELECT *, c - 2e0 * pi() * floor(c / (2e0 * pi()) + 0.5e0) AS r FROM hc),
 hh AS (SELECT *, sum(coalesce(CASE WHEN r <= -pi() THEN r + 2e0 * pi() ELSE r END, raw)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS heading FROM hw)"""


@register("headings", f"WITH {HEADING} SELECT track_id, seq, {milli('heading')} AS heading FROM hh")
def headings(spark, sf_dir):
    return shape.headings(derived(spark, sf_dir)).select("track_id", "seq", m("heading").alias("heading"))


@register("curvature_regression", f"WITH {HEADING}, k AS (SELECT track_id, seq, regr_slope(heading, distance) OVER (PARTITION BY track_id ORDER BY distance RANGE BETWEEN 35e0 PRECEDING AND 35e0 FOLLOWING) AS k FROM hh) SELECT track_id, seq, {milli('CASE WHEN k IS NULL OR isnan(k) THEN 0e0 ELSE k END', 100000)} AS kappa FROM k")
def curvature_regression(spark, sf_dir):
    d = shape.heading_regression(shape.headings(derived(spark, sf_dir)), 35.0)
    return d.select("track_id", "seq", m(F.coalesce("kappa", F.lit(0.0)), 100000).alias("kappa"))


@register("curvature_multiscale")
def curvature_multiscale(spark, sf_dir):
    return shape.curvature(complete(spark, sf_dir)).select("track_id", "seq", m("trajectoryCurvature", 100000).alias("kappa"))


@register("rolling_median", f"WITH {TRACE} SELECT track_id, seq, {milli('quantile_cont(elevation, 0.5) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS v FROM tr")
def rolling_median(spark, sf_dir):
    return shape.rolling_median(trace(spark, sf_dir), "elevation", 2, "v").select("track_id", "seq", m("v").alias("v"))


@register("rolling_mean_max", f"WITH {TRACE} SELECT track_id, seq, {milli('avg(elevation) OVER w')} AS mean, {milli('max(elevation) OVER w')} AS max FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_mean_max(spark, sf_dir):
    return shape.rolling(trace(spark, sf_dir), "elevation", 3).select("track_id", "seq", m("mean").alias("mean"), m("max").alias("max"))


@register("centred_slope", f"WITH {TRACE} SELECT track_id, seq, {milli('(coalesce(lead(elevation, 2) OVER w, last_value(elevation) OVER e) - coalesce(lag(elevation, 2) OVER w, first_value(elevation) OVER e)) / 20e0')} AS slope FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY seq), e AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def centred_slope(spark, sf_dir):
    return shape.centred_slope(trace(spark, sf_dir), "elevation", 2, 5.0).select("track_id", "seq", m("slope").alias("slope"))


@register("douglas_peucker", S.SIMPLIFY)
def douglas_peucker(spark, sf_dir):
    d = derived(spark, sf_dir)
    kept = shape.simplify_indices(d, 100.0).withColumn("track_id", F.col("track_id").cast("long"))
    return d.join(kept, ["track_id", "seq"], "left_semi").select("track_id", "seq", m("elevation").alias("elevation"))


CAND = f"""WITH {POINTS}, r AS (SELECT track_id, seq, distance, elevation, coalesce(elevation - pele, 0e0) AS rise, segment AS way FROM pd),
 c AS (SELECT *, sum(greatest(rise, 0e0)) OVER w AS up, sum(CASE WHEN rise > 0 THEN way ELSE 0e0 END) OVER w AS cl FROM r WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 nd AS (SELECT track_id, greatest(10e0, least(35e0, max(up) / 100e0)) AS need FROM c GROUP BY track_id),
 j AS (SELECT a.track_id, a.seq AS first, b.seq AS last, b.distance - a.distance AS len, b.elevation - a.elevation AS net, b.up - a.up AS up, b.cl - a.cl AS cl FROM c a JOIN c b ON a.track_id = b.track_id AND b.seq > a.seq),
 q AS (SELECT j.*, len * pow(100e0 * net / len, 1.3e0) AS score FROM j JOIN nd ON nd.track_id = j.track_id WHERE len > 10e0 AND net >= need AND 100e0 * net / len >= 3e0 AND (100e0 * up / nullif(cl, 0e0)) / (100e0 * net / len) <= 1.3e0)"""


@register("climb_candidates", CAND + f" SELECT track_id, first, {milli('max(score)', 1)} AS score FROM q GROUP BY track_id, first")
def climb_candidates(spark, sf_dir):
    d = derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation")
    return shape.climb_candidates(d).select("track_id", "first", m("score", 1).alias("score"))


@register("topk_climbs", CAND + f", b AS (SELECT track_id, first, max(score) AS score FROM q GROUP BY track_id, first), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, first) AS rank FROM b) SELECT track_id, rank, first, {milli('score', 1)} AS score FROM k WHERE rank <= 3")
def topk_climbs(spark, sf_dir):
    d = shape.climb_candidates(derived(spark, sf_dir).select("track_id", "seq", "distance", "elevation"))
    w = Window.partitionBy("track_id").orderBy(F.desc("score"), "first")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("track_id", "rank", "first", m("score", 1).alias("score"))


@register("climbs")
def climbs(spark, sf_dir):
    c = shape.climbs(derived(spark, sf_dir))
    return c.select("track_id", "first", "last", m("elevation").alias("elevation"), m("grade", 100000).alias("grade"), F.size("parts").alias("parts"))


# --- the ride ----------------------------------------------------------------------------------


@register("virtualize")
def virtualize(spark, sf_dir):
    d = motion.virtualize(motion.max_speeds(complete(spark, sf_dir, 0.001)))
    return d.groupBy("track_id").agg(F.count("*").alias("n"), m(F.max("elapsed"), 10).alias("elapsed"), m(F.sum("pBrake"), 1).alias("brake"))


@register("enhance_pipeline")
def enhance_pipeline(spark, sf_dir):
    d = E.enhance(complete(spark, sf_dir, 0.001))
    return D.track_stats(d).select("track_id", "n_points", m("distance", 10).alias("distance"), m("duration_ms", 1).alias("duration_ms"))


@register("per_distance", S.PER_DISTANCE)
def per_distance(spark, sf_dir):
    d = resample.per_distance(complete(spark, sf_dir), 15.0, 30.0)
    return d.groupBy("track_id").agg(F.count("*").alias("n"), m(F.max("distance")).alias("distance"))


@register("corners")
def corners(spark, sf_dir):
    return road.corners(complete(spark, sf_dir)).select("track_id", "first", "last", "kind", m("length").alias("length"))


@register("racing_line")
def racing_line(spark, sf_dir):
    return road.racing_report(complete(spark, sf_dir)).select("track_id", "i", m("offset").alias("offset"), m("lo").alias("lo"), m("hi").alias("hi"))


# --- road --------------------------------------------------------------------------------------


@register("segment_gap", f"WITH {POINTS}, s AS (SELECT track_id, seq // 10 AS g, min_by(lat, seq) AS la, min_by(lon, seq) AS lo, max_by(lat, seq) AS lb, max_by(lon, seq) AS ln FROM p GROUP BY track_id, seq // 10), q AS (SELECT *, lag(lb) OVER w AS pa, lag(ln) OVER w AS po FROM s WINDOW w AS (PARTITION BY track_id ORDER BY g)) SELECT track_id, {milli('coalesce(sum(CASE WHEN pa IS NOT NULL THEN ' + haversine_sql('pa', 'po', 'la', 'lo') + ' END), 0e0)')} AS gap FROM q GROUP BY track_id")
def segment_gap(spark, sf_dir):
    d = trace_points(spark, sf_dir).withColumn("seg_idx", F.floor(F.col("seq") / 10)).withColumn("pt_idx", F.col("seq"))
    return road.segment_gap(d).select("track_id", m("gap_m").alias("gap"))


@register("segment_order")
def segment_order(spark, sf_dir):
    d = trace_points(spark, sf_dir).withColumn("seg_idx", F.pmod(F.floor(F.col("seq") / 10) * 3, F.lit(8)).cast("int")).withColumn("pt_idx", F.col("seq"))
    return road.order_segments(d, 0.0).select("track_id", "place", "seg_idx", F.col("reversed").cast("int").alias("reversed"))


@register("self_proximity", f"WITH {TRACE}, g AS (SELECT track_id, seq, (lon_deg - 6e0) * 1e5 AS x, CAST(seq % 20 AS DOUBLE) * 5e0 AS y, CAST(seq AS DOUBLE) * 11e0 AS s, CAST(floor((lon_deg - 6e0) * 1e5 / 12e0) AS BIGINT) AS cx, CAST(floor(CAST(seq % 20 AS DOUBLE) * 5e0 / 12e0) AS BIGINT) AS cy FROM tr) SELECT a.track_id, a.seq, {milli('min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)))')} AS clearance FROM g a JOIN g b ON a.track_id = b.track_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.s - b.s) > 60e0 GROUP BY a.track_id, a.seq")
def self_proximity(spark, sf_dir):
    t = trace(spark, sf_dir)
    d = t.select("track_id", "seq", ((F.col("lon_deg") - 6.0) * 1e5).alias("x"), ((F.col("seq") % 20).cast("double") * 5.0).alias("y"), (F.col("seq").cast("double") * 11.0).alias("s"))
    return road.nearest_elsewhere(d, 60.0).select("track_id", "seq", m("clearance").alias("clearance"))


@register("runs_gaps_islands", f"WITH {TRACE}, f AS (SELECT track_id, seq, elevation > 300e0 AS tall, CASE WHEN (elevation > 300e0) IS DISTINCT FROM lag(elevation > 300e0) OVER (PARTITION BY track_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM tr), g AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT track_id, min(seq) AS first, max(seq) AS last FROM g WHERE tall GROUP BY track_id, run")
def runs_gaps_islands(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("seq")
    d = trace(spark, sf_dir).withColumn("tall", F.col("elevation") > 300)
    d = d.withColumn("c", F.when(F.col("tall").eqNullSafe(F.lag("tall").over(w)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("tall").groupBy("track_id", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).drop("run")


# --- terrain -----------------------------------------------------------------------------------


@register("terrarium_decode", "SELECT l_orderkey, l_linenumber, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN NULL ELSE CAST(floor((r * 256e0 + g + b / 256e0 - 32768e0) * 100e0 + 0.5e0) AS BIGINT) END AS cm FROM (SELECT l_orderkey, l_linenumber, l_partkey % 4 + 127 AS r, l_suppkey % 256 AS g, CAST(l_quantity AS BIGINT) AS b FROM lineitem)")
def terrarium_decode(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    h = terrain.terrarium(F.col("l_partkey") % 4 + 127, F.col("l_suppkey") % 256, F.col("l_quantity").cast("long"))
    return li.select("l_orderkey", "l_linenumber", F.when(~F.isnan(h), m(h, 100)).alias("cm"))


ZOOM = 12


def _plane(spark, sf_dir):
    """Tiles whose heights rise evenly over the map, for the trace's points."""
    p = trace(spark, sf_dir).select("lat_deg", "lon_deg")
    need = terrain.reached(terrain.placed(p, {"mapterhorn": ZOOM}, 256, ()), 256).select("layer", "z", "x", "y")

    def run(batches):
        i = np.arange(256)
        for b in batches:
            for r in b.to_pylist():
                hundredths = (r["x"] * 256 + i)[None, :] + (r["y"] * 256 + i)[:, None] * 2
                v = np.floor(hundredths * 2.56 + 0.5).astype(np.int64) + (32768 << 8)
                rgba = np.stack([v >> 16, v >> 8 & 255, v & 255, np.full_like(v, 255)], axis=-1).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([r | {"encoding": "terrarium", "data": rgba.tobytes()}], schema)

    made = T._parse_datatype_string("layer string, z int, x int, y int, encoding string, data binary")
    schema = to_arrow_schema(made)
    return need.mapInArrow(run, made)


@register("bilinear_dem", f"WITH {TRACE} SELECT track_id, seq, {milli('((lon_deg + 180e0) / 360e0 * 4096e0 * 256e0 - 0.5e0) * 0.01e0 + ((1e0 - ln(tan(radians(lat_deg)) + 1e0 / cos(radians(lat_deg))) / pi()) / 2e0 * 4096e0 * 256e0 - 0.5e0) * 0.02e0', 10)} AS h FROM tr")
def bilinear_dem(spark, sf_dir):
    found = terrain.lookup(trace(spark, sf_dir), _plane(spark, sf_dir), ZOOM, "mapterhorn")
    return found.select("track_id", "seq", m("h", 10).alias("h"))


@register("provenance_pivot", f"WITH {POINTS}, o AS (SELECT track_id, seq, (coalesce(distance - lag(distance) OVER w, 0e0) + coalesce(lead(distance) OVER w - distance, 0e0)) / 2000e0 AS km, CASE WHEN seq % 3 = 0 THEN 'IGN_LIDAR_HD' WHEN seq % 3 = 1 THEN 'MAPTERHORN' ELSE 'NONE' END AS origin FROM pd WINDOW w AS (PARTITION BY track_id ORDER BY seq)) SELECT track_id, {milli('sum(CASE WHEN origin = ' + chr(39) + 'IGN_LIDAR_HD' + chr(39) + ' THEN km ELSE 0e0 END)')} AS ign, {milli('sum(CASE WHEN origin = ' + chr(39) + 'MAPTERHORN' + chr(39) + ' THEN km ELSE 0e0 END)')} AS mapterhorn, {milli('sum(CASE WHEN origin = ' + chr(39) + 'NONE' + chr(39) + ' THEN km ELSE 0e0 END)')} AS none FROM o GROUP BY track_id")
def provenance_pivot(spark, sf_dir):
    d = derived(spark, sf_dir).withColumn("origin", F.when(F.col("seq") % 3 == 0, "IGN_LIDAR_HD").when(F.col("seq") % 3 == 1, "MAPTERHORN").otherwise("NONE"))
    p = terrain.provenance(d)
    return p.select("track_id", m("IGN_LIDAR_HD").alias("ign"), m("MAPTERHORN").alias("mapterhorn"), m("NONE").alias("none"))


DECKS = f"""WITH {TRACE}, st AS (SELECT track_id, seq, elevation % 3e0 + 80e0 AS mnt FROM tr WHERE seq >= 20 AND seq < 45),
 n AS (SELECT track_id, count(*) AS n FROM tr GROUP BY track_id),
 sp AS (SELECT track_id, min(seq) AS first, max(seq) AS last, max(100e0 - mnt) AS canyon, min(mnt) AS low, max_by(mnt, seq) AS bank FROM st GROUP BY track_id HAVING count(*) >= 3)
 SELECT CAST(track_id AS VARCHAR) AS track_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CASE WHEN (CASE WHEN n > last + 1 THEN 100e0 ELSE bank END) - low > 3e0 THEN 'DECK' ELSE 'NO_CANYON' END AS status, {milli('canyon')} AS canyon FROM sp JOIN n USING (track_id)"""


@register("bridge_decks", DECKS)
def bridge_decks(spark, sf_dir):
    k = F.col("seq")
    canyon = F.when((k >= 20) & (k < 45), F.col("elevation") % 3 + 80).otherwise(100.0)
    d = trace(spark, sf_dir).select("track_id", "seq", canyon.alias("mnt"), F.lit(100.0).alias("mns")).withColumn("mnh", F.col("mns") - F.col("mnt"))
    return terrain.bridge_decks(d).select("track_id", "first", "last", "status", m("canyon").alias("canyon"))


# --- formats -----------------------------------------------------------------------------------


@register("fit_units", f"WITH {TRACE} SELECT track_id, seq, CAST(floor(lat_deg * 2147483648e0 / 180e0 + 0.5e0) AS BIGINT) AS lat, CAST(floor(lon_deg * 2147483648e0 / 180e0 + 0.5e0) AS BIGINT) AS lon, CAST(floor((elevation + 500e0) * 5e0 + 0.5e0) AS BIGINT) AS altitude, CAST(floor((time_ms - 631065600000) / 1000e0) AS BIGINT) AS ts FROM tr")
def fit_units(spark, sf_dir):
    t = trace(spark, sf_dir)
    return t.select("track_id", "seq", fit.semicircles_column(F.col("lat_deg")).alias("lat"), fit.semicircles_column(F.col("lon_deg")).alias("lon"), fit.altitude_column(F.col("elevation")).alias("altitude"), F.floor((F.col("time_ms") - fit.EPOCH_MS) / 1000).cast("long").alias("ts"))


@register("fit_course")
def fit_course(spark, sf_dir):
    f = fit.to_fit(complete(spark, sf_dir), 1_700_000_000_000)
    return f.select("track_id", F.length("fit").alias("n_bytes"), F.sha2("fit", 256).alias("digest"))


@register("gpx_round_trip", f"WITH {POINTS} SELECT CAST(track_id AS VARCHAR) AS track_id, count(*) AS n, {milli('sum(elevation)')} AS elevation FROM p GROUP BY track_id")
def gpx_round_trip(spark, sf_dir):
    """Written as GPX documents, read back."""
    docs = text.to_gpx(complete(spark, sf_dir)).select(F.col("track_id").alias("file"), F.col("text").alias("xml"))
    back = gpx.paths(gpx.from_xml(docs))
    return back.groupBy(F.split("track_id", "#")[0].alias("track_id")).agg(F.count("*").alias("n"), m(F.sum("elevation")).alias("elevation"))


@register("csv_text", S.csv_text(["speed", "elevation", "distance"]))
def csv_text(spark, sf_dir):
    return text.to_csv(complete(spark, sf_dir), ["speed", "elevation", "distance"], decimals=2).select("track_id", F.sha2("text", 256).alias("digest"))


@register("json_text", S.json_text(["elevation", "distance"]))
def json_text(spark, sf_dir):
    return text.to_json(complete(spark, sf_dir), ["elevation", "distance"], decimals=2).select("track_id", F.sha2("text", 256).alias("digest"))


@register("highway_width", "SELECT e.event_type AS highway, count(*) AS n, max(CASE e.event_type WHEN 'view' THEN 6500 WHEN 'click' THEN 5000 ELSE NULL END)::BIGINT AS width FROM events e GROUP BY 1")
def highway_width(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_type") == "view", " Primary ").when(F.col("event_type") == "click", "RESIDENTIAL").otherwise(F.col("event_type"))
    return e.groupBy(F.col("event_type").alias("highway")).agg(F.count("*").alias("n"), F.max(m(gpx.width_of(name))).alias("width"))


# --- relational staples over tracks ------------------------------------------------------------


@register("track_union_except", f"WITH {TRACE} SELECT track_id, seq FROM (SELECT track_id, seq FROM tr WHERE seq < 30 UNION SELECT track_id, seq FROM tr WHERE seq >= 20) EXCEPT SELECT track_id, seq FROM tr WHERE seq BETWEEN 10 AND 25")
def track_union_except(spark, sf_dir):
    t = trace(spark, sf_dir).select("track_id", "seq")
    return t.where("seq < 30").union(t.where("seq >= 20")).distinct().exceptAll(t.where("seq BETWEEN 10 AND 25"))


@register("sessionised_tracks", f"WITH {TRACE}, g AS (SELECT track_id, time_ms, CASE WHEN time_ms - lag(time_ms) OVER w > 21600000 OR lag(time_ms) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM tr WINDOW w AS (PARTITION BY track_id ORDER BY seq)), n AS (SELECT *, sum(s) OVER (PARTITION BY track_id ORDER BY time_ms ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT track_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(time_ms) - min(time_ms) AS ms FROM n GROUP BY track_id, session")
def sessionised_tracks(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("seq")
    last = F.lag("time_ms").over(w)
    g = trace(spark, sf_dir).withColumn("s", F.when(last.isNull() | (F.col("time_ms") - last > 21_600_000), 1).otherwise(0))
    g = g.withColumn("session", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return g.groupBy("track_id", "session").agg(F.count("*").alias("n"), (F.max("time_ms") - F.min("time_ms")).alias("ms"))


@register("error_metrics", f"WITH {TRACE}, e AS (SELECT track_id, elevation - avg(elevation) OVER (PARTITION BY track_id) AS err FROM tr) SELECT track_id, count(*) AS n, {milli('sqrt(avg(err * err))', 10)} AS rms, {milli('max(abs(err))', 10)} AS worst, {milli('quantile_cont(abs(err), 0.95)', 10)} AS p95 FROM e GROUP BY track_id")
def error_metrics(spark, sf_dir):
    # Summed along the track: a sum in the order of arrival has other last digits with other files or partitions.
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = trace(spark, sf_dir).select("track_id", (F.col("elevation") - F.avg("elevation").over(whole)).alias("err"))
    return e.groupBy("track_id").agg(F.count("*").alias("n"), m(F.sqrt(F.avg(F.col("err") * F.col("err"))), 10).alias("rms"), m(F.max(F.abs("err")), 10).alias("worst"), m(F.percentile(F.abs("err"), F.lit(0.95)), 10).alias("p95"))


@register("lower_quantile", f"WITH {TRACE}, s AS (SELECT track_id, list_sort(list(elevation)) AS v FROM tr GROUP BY track_id) SELECT track_id, {milli('v[CAST(floor((len(v) - 1) * 0.2e0) AS BIGINT) + 1]')} AS q20, {milli('v[len(v) // 2 + 1]')} AS upper_median FROM s")
def lower_quantile(spark, sf_dir):
    s = trace(spark, sf_dir).groupBy("track_id").agg(F.sort_array(F.collect_list("elevation")).alias("v"))
    n = F.size("v")
    return s.select("track_id", m(F.element_at("v", (F.floor((n - 1) * 0.2) + 1).cast("int"))).alias("q20"), m(F.element_at("v", (F.floor(n / 2) + 1).cast("int"))).alias("upper_median"))


