"""Terrain heights by tile: decoding, lookup as a join of points with their tile, fallback, and corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.functions import decks, geo, kernels, sequence
from ridgeline.operators.tracks import add_columns, arrays, map_tracks, ordered, summarize
from ridgeline.options import DeckOptions, TunnelOptions
from ridgeline.schema import FIELDS, POINTS, points

#: Tile sources with their usual zoom; the first that has a value wins.
SOURCES = {"mapterhorn": 12, "ign_lidar_hd": 15}
NO_DATA_BELOW = -9000.0
TILE = ["layer", "z", "x", "y"]
#: A pixel without a height; and how many points of one tile a task takes.
NONE, GROUP = -(2**31), 1 << 20


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Height of a colour, to 0.01 m; black has none."""
    h = r * 256.0 + g + b / 256.0 - 32768.0
    return F.when((r == 0) & (g == 0) & (b == 0), float("nan")).otherwise(F.floor(h * 100 + 0.5) / 100)


def terrarium_array(rgba: np.ndarray) -> np.ndarray:
    c = rgba[..., :3].astype(float)
    h = np.floor((c[..., 0] * 256 + c[..., 1] + c[..., 2] / 256 - 32768) * 100 + 0.5) / 100
    return np.where((c == 0).all(axis=-1), np.nan, h)


def bil32(data: bytes, size: int) -> np.ndarray:
    """Heights of a raster of little-endian floats, on the 1/256 m grid that tiles keep; low values are none."""
    h = np.frombuffer(data, dtype="<f4").astype(float).reshape(-1, size)
    q = np.floor((h + 32768) * 256 + 0.5) / 256 - 32768
    return np.where(np.isnan(h) | (h <= NO_DATA_BELOW), np.nan, np.floor(q * 100 + 0.5) / 100)


def tile_url(template: str, z: Column, x: Column, y: Column) -> Column:
    out = F.lit(template)
    for name, v in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), v.cast("string"))
    return out


def tile_key(url: Column) -> Column:
    """struct<z, x, y> of a tile's address."""
    part = lambda i: F.regexp_extract(url, r"/(\d+)/(\d+)/(\d+)(?:\.\w+)?(?:\?.*)?$", i).cast("int")
    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


def raster(data: bytes, encoding: str, size: int = 256) -> np.ndarray:
    if encoding == "bil32":
        return bil32(data, size)
    if encoding == "webp":
        from ridgeline.sources.vp8l import decode

        return terrarium_array(decode(data))
    return terrarium_array(np.frombuffer(data, dtype=np.uint8).reshape(size, size, 4))


def rasters(tiles: DataFrame, size: int = 256) -> DataFrame:
    """layer, z, x, y, part, data of tiles (layer, z, x, y, encoding, data), each decoded once, to hundredths of a
    metre. Part 0 is the tile itself; its first column, row and pixel (1, 2, 3) go to the tiles to the left, above
    and across, whose last points reach over the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h = raster(r["data"], r["encoding"], size)
                h = np.where(np.isnan(h), NONE, np.floor(h * 100 + 0.5)).astype("<i4")
                rows = [(0, 0, h), (1, 0, h[:, 0]), (0, 1, h[0]), (1, 1, h[0, 0])]
                yield pa.RecordBatch.from_pylist([{"layer": r["layer"], "z": r["z"], "x": r["x"] - dx, "y": r["y"] - dy, "part": dx + 2 * dy, "data": v.tobytes()} for dx, dy, v in rows], schema)

    made = T._parse_datatype_string("layer string, z int, x int, y int, part int, data binary")
    schema = to_arrow_schema(made)
    return tiles.select("layer", *[F.col(c).cast("int") for c in TILE[1:]], "encoding", "data").mapInArrow(run, made)


def placed(where: DataFrame, sources: dict[str, int], size: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, layer, z, x, y, px, py, u, v for each point and source: the pixel above and to the left of the point, its
    tile, and how far the point is on to the next pixels. At the map's edges pixels repeat."""

    def axis(f: Column, zoom: int) -> tuple[Column, Column, Column]:
        tile, last = F.floor(f).cast("int"), (1 << zoom) - 1
        at = (f - tile) * size - 0.5
        left = F.floor(at).cast("int")
        carried = (left < 0) & (tile > 0)
        home, pixel = F.when(carried, tile - 1).otherwise(tile), F.when(carried, left + size).otherwise(left)
        pixel = F.when(home > last, size - 1).when(home < 0, -1).otherwise(pixel)
        return geo.clamp_int(home, 0, last), pixel, at - left

    def on(layer: str, zoom: int) -> Column:
        x, px, u = axis(geo.tile_x(F.col("lon_deg"), zoom), zoom)
        y, py, v = axis(geo.tile_y(F.col("lat_deg"), zoom), zoom)
        named = {"layer": F.lit(layer), "z": F.lit(zoom), "x": x.cast("int"), "y": y.cast("int"), "px": px, "py": py, "u": u, "v": v}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    return where.select(*keys, F.explode(F.array(*[on(*s) for s in sources.items()])).alias("_p")).select(*keys, "_p.*")


def reached(at: DataFrame, size: int) -> DataFrame:
    """layer, z, x, y of the tiles whose pixels the placed points need, with `n`, how many points lie on each."""
    last = F.expr("shiftleft(1, z) - 1")
    beyond = lambda t, p: F.least(F.col(t) + F.when(F.col(p) == size - 1, 1).otherwise(0), last)
    counts = at.groupBy(*TILE, beyond("x", "px").alias("x2"), beyond("y", "py").alias("y2")).count()
    tile = lambda x, y, n: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), n.alias("n"))
    none = F.lit(0).cast("long")
    four = F.array(tile("x", "y", F.col("count")), tile("x2", "y", none), tile("x", "y2", none), tile("x2", "y2", none))
    return counts.select("layer", "z", F.explode(four).alias("_t")).groupBy("layer", "z", "_t.x", "_t.y").agg(F.sum("_t.n").alias("n"))


def heights(points: DataFrame, tiles: DataFrame, sources: dict[str, int], size: int = 256, keys: tuple[str, ...] = ("track_id", "seq")) -> DataFrame:
    """keys, layer, h: bilinear height of each point (lat_deg, lon_deg) in each source; NaN if any of the four
    pixels around has none. Only tiles that points need are decoded. Points are shuffled once, to their tile; those
    of a tile that more than `GROUP` of them share are dealt out over copies of it. One row a tile is expected."""
    at = placed(points, sources, size, keys)
    need = reached(at, size)
    # At most one row for `GROUP` points.
    shared = F.broadcast(need.where(F.col("n") > GROUP).select(*TILE, F.ceil(F.col("n") / GROUP).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = at.join(shared, TILE, "left").withColumn("salt", F.pmod(F.xxhash64(*keys), copies).cast("int")).drop("copies")
    maps = rasters(tiles.join(need, TILE, "left_semi"), size)
    maps = maps.join(shared, TILE, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    schema = T.StructType([at.schema[k] for k in (*keys, "layer")] + [T.StructField("h", T.DoubleType())])

    def run(p: pa.Table, m: pa.Table) -> pa.Table:
        h = np.full((size + 1, size + 1), np.nan)
        where = [np.s_[:size, :size], np.s_[:size, size], np.s_[size, :size], np.s_[size, size]]
        for part, data in zip(m.column("part").to_pylist(), m.column("data").to_pylist(), strict=True):
            v = np.frombuffer(data, dtype="<i4")
            h[where[part]] = np.where(v == NONE, np.nan, v / 100).reshape(h[where[part]].shape)
        number = lambda c: pc.fill_null(p.column(c).cast(pa.float64()), np.nan).to_numpy()
        if p.num_rows and p.column("x")[0].is_valid:
            last = (1 << p.column("z")[0].as_py()) - 1
            if p.column("x")[0].as_py() == last:
                h[:, size] = h[:, size - 1]
            if p.column("y")[0].as_py() == last:
                h[size] = h[size - 1]
        px, py = (np.nan_to_num(number(c), nan=-1).astype(int) for c in ("px", "py"))
        u, v, x, y = number("u"), number("v"), np.maximum(px, 0), np.maximum(py, 0)
        found = (1 - u) * (1 - v) * h[y, x] + u * (1 - v) * h[y, px + 1] + (1 - u) * v * h[py + 1, x] + u * v * h[py + 1, px + 1]
        return pa.table([p.column(c) for c in (*keys, "layer")] + [pa.array(found, pa.float64())], names=schema.names)

    by = (*TILE, "salt")
    return dealt.groupBy(*by).cogroup(maps.groupBy(*by)).applyInArrow(run, schema)


def lookup(points: DataFrame, tiles: DataFrame, zoom: int, layer: str, size: int = 256, keys: tuple[str, ...] = ("track_id", "seq")) -> DataFrame:
    """keys, h: bilinear height of each point in one source; NaN where there is none."""
    return heights(points, tiles, {layer: zoom}, size, keys).drop("layer")


def elevations(points: DataFrame, tiles: DataFrame, sources: dict[str, int] = SOURCES, size: int = 256, keys: tuple[str, ...] = ("track_id", "seq"), beside: dict[str, int] | None = None) -> DataFrame:
    """keys, elevation, origin: the first source with a value for the whole point, otherwise 0 and NONE. Sources
    named in `beside` add a column each with their own heights."""
    beside = beside or {}
    found = heights(points, tiles, sources | beside, size, keys)
    rank = F.create_map(*[F.lit(x) for i, layer in enumerate(sources) for x in (layer, i)])[F.col("layer")]
    best = F.min_by(F.struct("h", F.upper("layer").alias("origin")), F.when(~F.isnan("h"), rank))
    others = [F.max(F.when(F.col("layer") == layer, F.col("h"))).alias(layer) for layer in beside]
    return found.groupBy(*keys).agg(best.alias("_b"), *others).select(*keys, F.coalesce("_b.h", F.lit(0.0)).alias("elevation"), F.coalesce("_b.origin", F.lit("NONE")).alias("origin"), *beside)


def fix_elevation(df: DataFrame, tiles: DataFrame, sources: dict[str, int] = SOURCES, size: int = 256) -> DataFrame:
    """Points with their heights replaced by the terrain's and motion data derived anew."""
    from ridgeline.operators.derive import derive

    p = df.select("track_id", "seq", F.degrees("latitude").alias("lat_deg"), F.degrees("longitude").alias("lon_deg"))
    found = elevations(p, tiles, sources, size).select("track_id", "seq", F.col("elevation").alias("_h"))
    d = df.join(found, ["track_id", "seq"], "left").withColumn("elevation", F.coalesce("_h", F.lit(0.0))).drop("_h")
    return derive(d).select(*df.columns)


def failures(points: DataFrame, tiles: DataFrame, zoom: int, layer: str, size: int = 256) -> DataFrame:
    """z, x, y of tiles that points (lat_deg, lon_deg) need and no table has."""
    need = reached(placed(points, {layer: zoom}, size, ()), size).select("z", "x", "y")
    return need.join(tiles.where(F.col("layer") == layer), ["z", "x", "y"], "left_anti")


def provenance(df: DataFrame) -> DataFrame:
    """Kilometres of each track by where its heights come from (`origin`): each point owns half of the pieces
    beside it."""
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("seq")
    share = (F.coalesce(F.col("distance") - F.lag("distance").over(w), F.lit(0.0)) + F.coalesce(F.lead("distance").over(w) - F.col("distance"), F.lit(0.0))) / 2
    return df.withColumn("_km", share / 1000).groupBy("track_id").pivot("origin", ["IGN_LIDAR_HD", "MAPTERHORN_MEASURED", "MAPTERHORN", "OTHER", "NONE"]).agg(F.coalesce(F.sum("_km"), F.lit(0.0)))


def along(points: DataFrame, step: float = 10.0, least: float = 1.0) -> DataFrame:
    """track_id, seq, lat_deg, lon_deg: points every `step` metres along polylines (track_id, seq, lat_deg,
    lon_deg), a new anchor after at least `least` metres."""

    def run(t):
        rows = kernels.along(t["lat_deg"], t["lon_deg"], step, least)
        return [{"seq": i, "lat_deg": float(a), "lon_deg": float(b)} for i, (a, b) in enumerate(rows)]

    return summarize(points.select("track_id", "seq", "lat_deg", "lon_deg"), ["lat_deg", "lon_deg"], "seq long, lat_deg double, lon_deg double", run)


def profile(points: DataFrame, tiles: DataFrame, sources: dict[str, int] = SOURCES, step: float = 10.0, least: float = 1.0, smooth_m: float | None = None, simplify_m: float | None = None, size: int = 256, z: float = 3.0) -> DataFrame:
    """track_id, seq, lat_deg, lon_deg, elevation along polylines, if asked for smoothed and simplified."""
    found = elevations(d := along(points, step, least), tiles, sources, size)
    d = d.join(found.drop("origin"), ["track_id", "seq"])
    if smooth_m is None and simplify_m is None:
        return d

    def run(t):
        lat, lon, h = np.radians(t["lat_deg"]), np.radians(t["lon_deg"]), t["elevation"]
        s = np.concatenate([[0.0], np.cumsum(kernels.haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]))])
        h = kernels.smooth_profile(s, h, smooth_m) if smooth_m else h
        keep = kernels.farthest_points(kernels.ecef(lat, lon, h, z), simplify_m) if simplify_m else range(len(h))
        return [{"seq": int(i), "lat_deg": float(t["lat_deg"][i]), "lon_deg": float(t["lon_deg"][i]), "elevation": float(h[i])} for i in keep]

    return summarize(d, ["lat_deg", "lon_deg", "elevation"], "seq long, lat_deg double, lon_deg double, elevation double", run)


SPAN = "first int, last int, start double, end double, length double, status string"
DECK = SPAN + "".join(f", {c} double" for c in decks.METRICS) + ", ranges array<struct<first: int, last: int>>"
TUNNEL = "first int, last int, start double, end double, length double, chord_grade double, height double, rise double, fall double, straightness double"


def bridge_decks(stations: DataFrame, options: DeckOptions = DeckOptions()) -> DataFrame:
    """Spans of every track's stations (track_id, seq, mnt, mns, mnh at equal steps), accepted or with the
    reason against them."""
    return summarize(stations, ["mnt", "mns", "mnh"], DECK, lambda t: decks.find(t["mnt"], t["mns"], t["mnh"], options))


def deck_profile(stations: DataFrame, options: DeckOptions = DeckOptions()) -> DataFrame:
    """Stations with `deck`: the ground's heights, with the road on accepted decks drawn in."""

    def run(t):
        survey = t["mnt"], t["mns"], t["mnh"]
        return {"deck": decks.profile(t["mnt"], decks.stretches(*survey, decks.find(*survey, options), options))}

    return add_columns(stations, ["mnt", "mns", "mnh"], ["deck"], run)


def tunnels(stations: DataFrame, options: TunnelOptions = TunnelOptions()) -> DataFrame:
    """Tunnels of every track's stations (track_id, seq, elevation, latitude, longitude at equal steps)."""
    return summarize(stations, ["elevation", "latitude", "longitude"], TUNNEL, lambda t: sequence.tunnels(t["elevation"], t["latitude"], t["longitude"], options))


def flatten_tunnels(df: DataFrame, options: TunnelOptions = TunnelOptions()) -> DataFrame:
    """Points whose heights inside tunnels follow the line between the portals, found in their own heights."""

    def run(t):
        s = np.arange(0, t["distance"][-1] + 1e-9, options.step_m) if len(t["distance"]) else np.zeros(0)
        at = lambda c: kernels.value_at(t["distance"], t[c], s)
        spans = sequence.tunnels(at("elevation"), at("latitude"), at("longitude"), options) if len(s) > 1 else []
        out = kernels.copy(t)
        out["elevation"] = sequence.flatten(t["distance"], t["elevation"], spans)
        return kernels.derive(out)

    return map_tracks(df, run)


def stations(df: DataFrame, step: float = 5.0) -> DataFrame:
    """track_id, seq, lat_deg, lon_deg every `step` metres along the tracks, from 0."""

    def run(t):
        s, n = t["distance"], len(t["distance"])
        at = np.arange(int(s[-1] // step) + 1) * step if n else np.zeros(0)
        lat, lon = (np.degrees(kernels.value_at(s, t[c], at)) for c in ("latitude", "longitude"))
        return [{"seq": i, "lat_deg": a, "lon_deg": b} for i, (a, b) in enumerate(zip(lat.tolist(), lon.tolist(), strict=True))]

    return summarize(df, ["distance", "latitude", "longitude"], "seq long, lat_deg double, lon_deg double", run)


#: The surface model that goes with the ground model of the same survey, and its usual zoom.
SURFACE, SURVEYED = {"ign_lidar_hd_mns": 15}, "IGN_LIDAR_HD"
#: Origins whose ground was measured, not modelled.
MEASURED = (SURVEYED, "MAPTERHORN_MEASURED")


def corrected(t: kernels.Track, at: dict, deck: DeckOptions | None, tunnel: TunnelOptions | None, measured: tuple[str, ...] | None = MEASURED) -> tuple[kernels.Track, list[dict]]:
    """A track with the road on bridge decks and through tunnels, and the spans of both with their status. `at` has
    the stations' ground, its origin, their surface and their coordinates in radians. Surfaces count only over
    ground of the same survey. Tunnels keep off decks; with `measured`, only over ground of those origins."""
    out, report, protect = kernels.copy(t), [], []
    ground, origin = at["elevation"], np.asarray(at["origin"], dtype=object)
    row = lambda kind, d, status: {"kind": kind, "status": status, **{c: d[c] for c in ("first", "last", "start", "end", "length")}}
    if len(t["distance"]) < 2:
        return out, report
    if deck:
        mns = np.where(origin == SURVEYED, at["surface"], np.nan)
        found = decks.find(ground, mns, mns - ground, deck)
        some = decks.stretches(ground, mns, mns - ground, found, deck)
        out["elevation"] = decks.write(t["distance"], t["elevation"], some, deck.step_m)
        protect = [r.written(deck.step_m) for r in some]
        report += [row("deck", d, d["status"]) for d in found]
    if tunnel:
        spans = sequence.tunnels(ground, at["latitude"], at["longitude"], tunnel)
        sound = sequence.sound_tunnels(spans, np.isin(origin, measured) if measured else np.ones(len(ground), dtype=bool), tunnel.step_m, protect)
        out["elevation"] = sequence.through(t["distance"], out["elevation"], ground, sound, tunnel.step_m, protect)
        report += [row("tunnel", d, "TUNNEL" if d in sound else "LEFT") for d in spans]
    return kernels.derive(out), report


def road_heights(df: DataFrame, tiles: DataFrame, sources: dict[str, int] = SOURCES, surface: dict[str, int] = SURFACE, deck: DeckOptions | None = DeckOptions(), tunnel: TunnelOptions | None = TunnelOptions(), measured: tuple[str, ...] | None = MEASURED, size: int = 256, report: bool = False) -> DataFrame:
    """Points, their heights already the terrain's, with bridge decks and tunnels drawn in; or, with `report`,
    track_id, kind, status and extent of every span considered. One join of each track with its stations."""
    steps = {o.step_m for o in (deck, tunnel) if o}
    if len(steps) != 1:
        raise ValueError("decks and tunnels must share a step")
    name = next(iter(surface))
    keys = ("track_id", "seq", "lat_deg", "lon_deg")
    found = elevations(stations(df, steps.pop()), tiles, sources, size, keys, surface if deck else None)
    ground = found.select("track_id", "seq", "elevation", "origin", (F.col(name) if deck else F.lit(float("nan"))).alias("surface"), F.radians("lat_deg").alias("latitude"), F.radians("lon_deg").alias("longitude"))
    out = T._parse_datatype_string(f"track_id string, kind string, {SPAN}") if report else POINTS
    schema = to_arrow_schema(out)

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows:
            return schema.empty_table()
        p, q = ordered(p), ordered(q)
        at = arrays(q, ["elevation", "surface", "latitude", "longitude"]) | {"origin": q.column("origin").to_pylist()}
        t, spans = corrected(arrays(p, FIELDS), at, deck, tunnel, measured)
        if report:
            key = p.column("track_id")[0].as_py()
            return pa.Table.from_pylist([{"track_id": key, **r} for r in spans], schema=schema)
        return pa.table([p.column("track_id"), p.column("seq"), *(pa.array(t[f], pa.float64()) for f in FIELDS)], schema=schema)

    return points(df).groupBy("track_id").cogroup(ground.groupBy("track_id")).applyInArrow(run, out)


def correction_report(spans: DataFrame) -> DataFrame:
    """Counts and lengths of spans by track and status."""
    return spans.groupBy("track_id", "status").agg(F.count("*").alias("n"), F.sum("length").alias("length_m"))
