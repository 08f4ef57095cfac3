"""DuckDB queries for operators that go along a track: smoothing, counted ascent, thinning, simplifying, texts."""

from __future__ import annotations

from ridgeline.options import GAIN_PRESETS
from ridgeline.plans.trace import DERIVED, POINTS, haversine_sql, milli
from ridgeline.schema import UNITS

ALONG = "(PARTITION BY track_id ORDER BY seq)"
BEFORE = "(PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _integral(p: str, x: str) -> tuple[str, str]:
    """The heights' first and second integral up to x, which lies on piece p."""
    u = f"({x} - {p}.s)"
    one = f"({p}.i1 + {p}.e * {u} + {p}.slope * {u} * {u} / 2e0)"
    two = f"({p}.i2 + {p}.s * {p}.e * {u} + ({p}.e + {p}.s * {p}.slope) * {u} * {u} / 2e0 + {p}.slope * {u} * {u} * {u} / 3e0)"
    return one, two


def smoothed(halves: tuple[float, ...]) -> str:
    """`sm`: track_id, seq, half, h, the heights under a triangular kernel of each half-width (0: as they are)."""
    (a1, a2), (b1, b2) = _integral("a", "q.lo"), _integral("b", "q.hi")
    width = ", ".join(f"({w}e0)" for w in halves)
    total = f"((1e0 - q.s / q.half) * (q.i1 - {a1}) + (q.i2 - {a2}) / q.half + (1e0 + q.s / q.half) * ({b1} - q.i1) - ({b2} - q.i2) / q.half)"
    left, right = "(q.s - q.lo)", "(q.hi - q.s)"
    mass = f"({left} - {left} * {left} / (2e0 * q.half) + {right} - {right} * {right} / (2e0 * q.half))"
    return f"""{DERIVED},
 z0 AS (SELECT track_id, seq, elevation, distance - first_value(distance) OVER {ALONG} AS s, avg(elevation) OVER (PARTITION BY track_id) AS level, count(*) OVER (PARTITION BY track_id) AS n, lead(distance) OVER {ALONG} - distance AS h, lead(elevation) OVER {ALONG} - elevation AS de FROM d),
 z1 AS (SELECT *, elevation - level AS e, CASE WHEN h > 0 THEN de / h ELSE 0e0 END AS slope, max(s) OVER (PARTITION BY track_id) AS total FROM z0),
 z AS MATERIALIZED (SELECT *, coalesce(sum(h * (e + e + de) / 2e0) OVER {BEFORE}, 0e0) AS i1, coalesce(sum(s * e * h + (e + s * slope) * h * h / 2e0 + slope * h * h * h / 3e0) OVER {BEFORE}, 0e0) AS i2 FROM z1),
 pc AS (SELECT * FROM z WHERE h IS NOT NULL),
 w AS (SELECT half FROM (VALUES {width}) AS v(half)),
 q AS (SELECT z.*, w.half, greatest(s - half, 0e0) AS lo, least(s + half, total) AS hi FROM z, w WHERE half > 0 AND n >= 3),
 sm AS (SELECT q.track_id, q.seq, q.half, CASE WHEN {mass} > 0 THEN {total} / {mass} + q.level ELSE q.elevation END AS h FROM q ASOF JOIN pc a ON q.track_id = a.track_id AND q.lo >= a.s ASOF JOIN pc b ON q.track_id = b.track_id AND q.hi >= b.s
  UNION ALL SELECT z.track_id, z.seq, w.half, z.elevation FROM z, w WHERE half = 0 OR n < 3)"""


SMOOTH = f"WITH {smoothed((150,))} SELECT track_id, seq, {milli('h', 100)} AS elevation FROM sm"


def counted(kinds: list[tuple[str, float, float]]) -> str:
    """`gn`: track_id, kind, gain, loss, legs between turns of at least a threshold, for (kind, threshold, half-width);
    without a threshold, all rises and falls."""
    halves = tuple(dict.fromkeys(w for _, _, w in kinds))
    rows = ", ".join(f"('{k}', {t}e0, {w}e0)" for k, t, w in kinds)
    return f"""WITH RECURSIVE {smoothed(halves)},
 kd AS (SELECT * FROM (VALUES {rows}) AS v(kind, threshold, half)),
 hs AS MATERIALIZED (SELECT track_id, seq, kind, threshold, h, lead(h) OVER (PARTITION BY track_id, kind ORDER BY seq) - h AS step FROM sm JOIN kd USING (half)),
 f AS (SELECT track_id, kind, seq, 0 AS way, FALSE AS up, 0 AS legs, h AS h0, h AS hi, h AS lo, h AS ref, h AS ext, 0e0 AS gain, 0e0 AS loss FROM hs WHERE seq = 0 AND threshold > 0
  UNION ALL SELECT track_id, kind, seq,
   CASE WHEN opens AND up2 THEN 1 WHEN opens THEN -1 WHEN turns THEN -way ELSE way END, up2,
   legs + CASE WHEN (opens AND up2 AND lo2 < h0) OR (opens AND NOT up2 AND hi2 > h0) OR turns THEN 1 ELSE 0 END, h0,
   CASE WHEN way = 0 THEN hi2 ELSE hi END, CASE WHEN way = 0 THEN lo2 ELSE lo END,
   CASE WHEN opens AND up2 THEN lo2 WHEN opens THEN hi2 WHEN turns THEN ext ELSE ref END,
   CASE WHEN opens AND up2 THEN hi2 WHEN opens THEN lo2 WHEN further OR turns THEN h ELSE ext END,
   gain + CASE WHEN opens AND NOT up2 AND hi2 > h0 THEN hi2 - h0 WHEN turns AND way > 0 THEN ext - ref ELSE 0e0 END,
   loss + CASE WHEN opens AND up2 AND lo2 < h0 THEN lo2 - h0 WHEN turns AND way < 0 THEN ext - ref ELSE 0e0 END
   FROM (SELECT *, way <> 0 AND NOT further AND (ext - h) * way >= threshold AS turns, way = 0 AND hi2 - lo2 >= threshold AS opens
    FROM (SELECT f.* EXCLUDE (seq), x.seq, x.h, x.threshold, greatest(f.hi, x.h) AS hi2, least(f.lo, x.h) AS lo2, CASE WHEN x.h > f.hi THEN TRUE WHEN x.h < f.lo THEN FALSE ELSE f.up END AS up2, (f.way > 0 AND x.h > f.ext) OR (f.way < 0 AND x.h < f.ext) AS further
     FROM f JOIN hs x ON x.track_id = f.track_id AND x.kind = f.kind AND x.seq = f.seq + 1))),
 ends AS (SELECT *, way <> 0 AND (ext - ref) * way > 0 AS open FROM f QUALIFY row_number() OVER (PARTITION BY track_id, kind ORDER BY seq DESC) = 1),
 gn AS (SELECT track_id, kind, gain + CASE WHEN open AND way > 0 THEN ext - ref ELSE 0e0 END AS gain, loss + CASE WHEN open AND way < 0 THEN ext - ref ELSE 0e0 END AS loss, legs + CASE WHEN open THEN 1 ELSE 0 END AS legs FROM ends
  UNION ALL SELECT track_id, kind, coalesce(sum(greatest(step, 0e0)), 0e0), coalesce(sum(least(step, 0e0)), 0e0), 0 FROM hs WHERE threshold <= 0 GROUP BY track_id, kind)"""


PRESETS = f"{counted([(n, *o) for n, o in GAIN_PRESETS.items()])} SELECT CAST(track_id AS VARCHAR) AS track_id, kind AS preset, {milli('gain')} AS gain, {milli('loss')} AS loss, CAST(legs AS INTEGER) AS legs FROM gn"

GRID_WINDOWS, GRID_THRESHOLDS = (0, 15, 30, 50, 150), (0, 2, 3, 5, 10)
GRID = f"""{counted([(f"{w}|{t}", t, w) for w in GRID_WINDOWS for t in GRID_THRESHOLDS])}
 SELECT CAST(track_id AS VARCHAR) AS track_id, CAST(split_part(kind, '|', 1) AS DOUBLE) AS window_m, {", ".join(milli(f"max(CASE WHEN split_part(kind, '|', 2) = '{t}' THEN gain END)") + f" AS t{t}" for t in GRID_THRESHOLDS)} FROM gn GROUP BY ALL"""

PER_DISTANCE = f"""WITH RECURSIVE {POINTS}, x AS MATERIALIZED (SELECT track_id, seq, lat, lon, distance AS d, lead(distance) OVER {ALONG} AS nd, lead(lat) OVER {ALONG} AS nlat, lead(lon) OVER {ALONG} AS nlon FROM pd),
 f AS (SELECT track_id, seq, d AS kept, d AS start, 0e0 AS gap FROM x WHERE seq = 0
  UNION ALL SELECT x.track_id, x.seq, CASE WHEN x.d - f.kept >= 15e0 THEN x.d ELSE f.kept END, f.kept, CASE WHEN x.d - f.kept >= 15e0 THEN x.d - f.kept ELSE -1e0 END FROM f JOIN x ON x.track_id = f.track_id AND x.seq = f.seq + 1),
 k AS (SELECT track_id, seq, start, gap, CASE WHEN gap > 30e0 THEN CAST(ceil(gap / 30e0) AS BIGINT) ELSE 1 END AS pieces FROM f WHERE gap >= 0),
 j AS (SELECT *, unnest(generate_series(1, pieces - 1)) AS j FROM k),
 tg AS (SELECT track_id, seq, j, start + j * (gap / pieces) AS target FROM j),
 pts AS (SELECT t.track_id, t.seq, t.j, x.lat + (target - d) / (nd - d) * (nlat - lat) AS lat, x.lon + (target - d) / (nd - d) * (nlon - lon) AS lon FROM tg t ASOF JOIN x ON t.track_id = x.track_id AND t.target > x.d
  UNION ALL SELECT k.track_id, k.seq, k.pieces, x.lat, x.lon FROM k JOIN x ON x.track_id = k.track_id AND x.seq = k.seq),
 o AS (SELECT *, lag(lat) OVER v AS plat, lag(lon) OVER v AS plon FROM pts WINDOW v AS (PARTITION BY track_id ORDER BY seq, j))
 SELECT CAST(track_id AS VARCHAR) AS track_id, count(*) AS n, {milli(f"sum(CASE WHEN plat IS NULL THEN 0e0 ELSE {haversine_sql('plat', 'plon', 'lat', 'lon')} END)")} AS distance FROM o GROUP BY track_id"""

#: Each round splits all pieces at the point farthest from their line; the ends of all pieces ever made stay.
SIMPLIFY = f"""WITH RECURSIVE {DERIVED}, cn AS (SELECT track_id, seq, lat, lon, elevation, elevation * 3e0 AS h, 6378137e0 / sqrt(1e0 - 0.00669437999014e0 * sin(lat) * sin(lat)) AS n FROM d),
 x AS MATERIALIZED (SELECT track_id, seq, elevation, (n + h) * cos(lat) * cos(lon) AS x, (n + h) * cos(lat) * sin(lon) AS y, (n * (1e0 - 0.00669437999014e0) + h) * sin(lat) AS z FROM cn),
 f AS (SELECT track_id, min(seq) AS a, max(seq) AS b FROM x GROUP BY track_id
  UNION ALL SELECT track_id, unnest([a, far]) AS a, unnest([far, b]) AS b FROM
   (SELECT track_id, a, b, max_by(seq, off) AS far FROM
    (SELECT track_id, a, b, seq, sqrt(pow(qx - u * vx, 2) + pow(qy - u * vy, 2) + pow(qz - u * vz, 2)) AS off FROM
     (SELECT *, CASE WHEN l > 0 THEN least(1e0, greatest(0e0, (qx * vx + qy * vy + qz * vz) / l)) ELSE 0e0 END AS u FROM
      (SELECT f.track_id, f.a, f.b, p.seq, p.x - s.x AS qx, p.y - s.y AS qy, p.z - s.z AS qz, e.x - s.x AS vx, e.y - s.y AS vy, e.z - s.z AS vz, pow(e.x - s.x, 2) + pow(e.y - s.y, 2) + pow(e.z - s.z, 2) AS l
       FROM f JOIN x s ON s.track_id = f.track_id AND s.seq = f.a JOIN x e ON e.track_id = f.track_id AND e.seq = f.b JOIN x p ON p.track_id = f.track_id AND p.seq > f.a AND p.seq < f.b)))
    GROUP BY track_id, a, b HAVING max(off) > 100e0)),
 kept AS (SELECT track_id, a AS seq FROM f UNION SELECT track_id, b FROM f)
 SELECT track_id, seq, {milli('elevation')} AS elevation FROM x JOIN kept USING (track_id, seq)"""


def _fixed(x: str) -> str:
    """Two decimals, none for whole numbers."""
    text = f"regexp_replace(printf('%.2f', {x}), '\\.00$', '')"
    return f"CASE WHEN {text} = '-0' THEN '0' ELSE {text} END"


def csv_text(fields: list[str]) -> str:
    head = ",".join(f"{f} ({UNITS[f]})" for f in fields)
    line = " || ',' || ".join(_fixed(f) for f in fields)
    return f"WITH {DERIVED} SELECT CAST(track_id AS VARCHAR) AS track_id, sha256('{head}' || chr(10) || string_agg({line} || chr(10), '' ORDER BY seq)) AS digest FROM d GROUP BY track_id"


def json_text(fields: list[str]) -> str:
    units = ",".join(f'"{f}":"{UNITS[f]}"' for f in fields)
    number = lambda f: f"regexp_replace({_fixed(f)}, '(\\.[0-9]*[1-9])0+$', '\\1')"
    arrays = " || ',' || ".join(f"'\"{f}\":[' || string_agg({number(f)}, ',' ORDER BY seq) || ']'" for f in fields)
    return f"WITH {DERIVED} SELECT CAST(track_id AS VARCHAR) AS track_id, sha256('{{\"size\":' || count(*) || ',\"meta\":{{\"units\":{{{units}}}}},\"fields\":{{' || {arrays} || '}}}}') AS digest FROM d GROUP BY track_id"
