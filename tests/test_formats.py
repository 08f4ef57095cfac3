import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import energetics, motion, resample, road, shape, terrain
from ridgeline.options import Cyclist, EnhanceOptions, GainOptions, RacingLineOptions
from ridgeline.plans.enhance import enhance
from ridgeline.schema import FIELDS, field_catalog, points
from ridgeline.sources import fit, gpx, text

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:n="urn:x"><metadata><name>A &amp; B</name></metadata>
<wpt lat="45.1" lon="6.2"><name>top</name></wpt>
<trk><name>t1</name><extensions><n:RoadWidth>4</n:RoadWidth></extensions><trkseg>
<trkpt lat="45.680697" lon="6.396115"><ele>350.1</ele><time>2024-11-03T14:25:22Z</time><extensions><power>45</power><n:T><n:hr>61</n:hr><n:hr>99</n:hr><n:cad>80</n:cad></n:T></extensions></trkpt>
<trkpt lat="45.681" lon="6.3962"><ele>x</ele><time>nope</time><extensions><highway> Primary </highway></extensions></trkpt></trkseg>
<trkseg><trkpt lat="45.682" lon="6.397"/></trkseg></trk>
<rte><name>r</name><rtept lat="45" lon="6"/><rtept lat="45.01" lon="6"/></rte></gpx>"""


@pytest.fixture(scope="module")
def doc(spark):
    return spark.createDataFrame([("a.gpx", GPX)], "file string, xml string")


def test_parse(doc):
    rows = gpx.from_xml(doc).orderBy("track_idx", "seg_idx", "pt_idx").collect()
    assert [r.kind for r in rows] == ["TRACK"] * 3 + ["ROUTE"] * 2
    assert (rows[0].doc_name, rows[0].heart_rate, rows[0].cadence, rows[0].power_w, rows[0].time_epoch_ms) == ("A & B", 61, 80, 45.0, 1730643922000)
    assert rows[1].elevation_m is None and rows[1].time_epoch_ms is None
    assert gpx.waypoints(doc).first().name == "top"
    assert gpx.start_time(gpx.from_xml(doc)).first().start_ms == 1730643922000


def test_paths(doc):
    d = gpx.from_xml(doc)
    p = gpx.paths(d, ("TRACK",))
    rows = p.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2] and rows[1].elevation == 0 and rows[0].roadWidth == 4
    assert p.columns[2:] == FIELDS
    assert gpx.paths(d, by_segment=True).select("track_id").distinct().count() == 3


def test_repair():
    mended, done = gpx.repair("\ufeff<gpx><!-- a & b --><trk><name>x & y &#xD83D;&#xDE00;\x01</name></trk></gpx>")
    assert done == ["bom", "control_chars", "surrogate_pairs", "bare_ampersands"]
    assert "<!-- a & b -->" in mended and "x &amp; y 😀" in mended
    assert gpx.parse("\ufeff<gpx><trk><name>x & y</name></trk></gpx>")["tracks"][0]["name"] == "x & y"
    for bad in ("not xml at all", "<kml/>", '<gpx><wpt lat="x" lon="1"/></gpx>'):
        with pytest.raises(ValueError):
            gpx.parse(bad)


def test_data_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.GPX").write_text(GPX)
    spark.dataSource.register(gpx.GpxDataSource)
    assert spark.read.format("gpx").load(str(tmp_path)).count() == 5
    assert gpx.read(spark, str(tmp_path)).count() == 5


def test_numbers():
    assert [text.plain_decimal(x) for x in (1e-7, 1e21, 45.83260000000001, -0.0, 1.0)] == ["0.0000001", "1000000000000000000000", "45.83260000000001", "0", "1"]
    assert [text.table_number(x, 2) for x in (1.0, 1.5, -0.0, float("nan"))] == ["1", "1.50", "0", ""]
    assert text.quoted('a,"b') == '"a,""b"'


@pytest.fixture(scope="module")
def ride(spark):
    rows = [("t", i, 0.79 + i * 2e-6, 0.1, 100.0 + i % 7, 1.7e12 + i * 1000.0) for i in range(300)]
    return points(spark.createDataFrame(rows, "track_id string, seq long, latitude double, longitude double, elevation double, time double"))


def test_texts(spark, ride):
    d = ride.where("seq < 1").withColumn("speed", F.lit(5.0))
    csv = text.to_csv(d, ["speed", "elevation", "distance"]).first().text
    assert csv == "speed (m/s),elevation (meters),distance (meters)\n5,100,0\n"
    json = text.to_json(d.withColumn("speed", F.lit(float("nan"))), ["speed"]).first().text
    assert json == '{"size":1,"meta":{"units":{"speed":"m/s"}},"fields":{"speed":[null]}}'
    back = gpx.parse(text.to_gpx(ride.limit(5), start_ms=0).first().text)
    assert len(back["tracks"][0]["segments"][0]) == 5


def test_fit(ride):
    assert fit.semicircles(45.680697) == 544991944 and fit.semicircles(6.396115) == 76308624
    assert fit.semicircles(180) == fit.semicircles(-180) == fit.semicircles(179.9999999999) == -(2**31)
    assert (fit.altitude(0), fit.altitude(-500)) == (2500, 0)
    data = fit.to_fit(ride, 1_700_000_000_000).first().fit
    assert data[8:12] == b".FIT" and fit.crc16(bytes(data[:-2])) == struct.unpack("<H", data[-2:])[0]
    seg = {c: np.zeros(2) for c in ("lat", "lon", "ele", "distance")} | {"time": np.array([1.0, 0.0])}
    with pytest.raises(ValueError):
        fit.encode("x", [seg], 0)
    snapped = fit.snap(np.array([0, 10, 10, 20.0]), [{"distance": 15}, {"distance": 4}])
    assert [s["index"] for s in snapped] == [0, 1]


def fit_messages(data):
    """(message, {field: bytes}) in the file's order."""
    at, known, out = 14, {}, []
    while at < len(data) - 2:
        head = data[at]
        if head & 0x40:
            (message,), n = struct.unpack_from("<H", data, at + 3), data[at + 5]
            known[head & 15] = message, [tuple(data[at + 6 + 3 * k : at + 8 + 3 * k]) for k in range(n)]
            at += 6 + 3 * n
            continue
        message, fields = known[head]
        at += 1
        out.append((message, {}))
        for number, size in fields:
            out[-1][1][number] = data[at : at + size]
            at += size
    return out


def test_fit_numbers_beyond_their_fields():
    n, day = 4, 86_400_000.0
    seg = {c: np.zeros(n) for c in ("lat", "lon", "ele", "distance")} | {"time": np.arange(n) * 20 * day, "gain": 70_000.0, "loss": -65_534.0}
    seg |= {"speed": np.array([65.534, 65.535, 5e6, np.inf]), "power": np.array([65_534, 65_535, -1, np.nan]), "hr": np.array([254, 255, 300, -1.0]), "temp": np.array([126, 127, -128, -129.0])}
    sent = fit_messages(fit.encode("x", [seg], 1_700_000_000_000))
    number = lambda fields, k: int.from_bytes(fields[k], "little")
    (lap,) = [f for m, f in sent if m == fit.LAP]
    assert [number(lap, k) for k in (7, 8, 21, 22)] == [0xFFFFFFFF, 0xFFFFFFFF, 0xFFFF, 65_534]
    assert number(lap, 253) - number(lap, 2) == 60 * 86_400
    records = [f for m, f in sent if m == fit.RECORD]
    assert [(k, number(f, k)) for f in records for k in (6, 73) if k in f] == [(6, 65_534), (73, 65_535), (73, 0xFFFFFFFF), (6, 0xFFFF)]
    assert [number(f, 7) for f in records] == [65_534, 0xFFFF, 0xFFFF, 0xFFFF]
    assert [f[3][0] for f in records] == [254, 255, 255, 255]
    assert [f[13][0] for f in records] == [126, 0x7F, 0x80, 0x7F]
    with pytest.raises(struct.error):
        fit.encode("x", [seg], 0)


def test_terrain(spark):
    assert np.isnan(terrain.terrarium_array(np.zeros((1, 1, 4)))[0, 0])
    h = terrain.bil32(np.array([[1.25, -9999.0]], dtype="<f4").tobytes(), 2)
    assert h[0, 0] == 1.25 and np.isnan(h[0, 1])
    tile = np.zeros((256, 256, 4), dtype=np.uint8)
    tile[..., 0], tile[..., 1] = 128, 100
    tiles = spark.createDataFrame([("mapterhorn", 12, x, y, "terrarium", bytearray(tile.tobytes())) for x in range(2116, 2118) for y in range(1470, 1474)], "layer string, z int, x int, y int, encoding string, data binary")
    pts = spark.createDataFrame([("a", 0, 45.2, 6.01), ("a", 1, 0.0, 0.0)], "track_id string, seq long, lat_deg double, lon_deg double")
    got = {r.seq: (r.elevation, r.origin) for r in terrain.elevations(pts, tiles, {"mapterhorn": 12}).collect()}
    assert got == {0: (100.0, "MAPTERHORN"), 1: (0.0, "NONE")}
    assert terrain.failures(pts, tiles, 12, "mapterhorn").count() >= 1
    key = spark.range(1).select(terrain.tile_key(F.lit("https://x/a/12/7/9.webp?k=1")).alias("k")).first().k
    assert tuple(key) == (12, 7, 9)
    n = spark.range(1).select(geo.normalize_pixel(F.lit(8), F.lit(8), F.lit(-10), F.lit(300), 4).alias("p")).first().p
    assert tuple(n) == (7, 9, 246, 44)


def tiles_of(spark, need, height, size=256):
    """Tiles (layer, z, x, y) with the heights that `height` gives for a tile's x and y."""
    rows = []
    for r in need.select("layer", "z", "x", "y").distinct().collect():
        h = height(r.x, r.y)
        v = np.where(np.isnan(h), 0, np.floor(np.nan_to_num(h) * 256 + 0.5) + (32768 << 8)).astype(np.int64)
        rgba = np.stack([v >> 16, v >> 8 & 255, v & 255, v * 0 + 255], axis=-1).astype(np.uint8)
        rows.append((r.layer, r.z, r.x, r.y, "terrarium", bytearray(rgba.tobytes())))
    return spark.createDataFrame(rows, "layer string, z int, x int, y int, encoding string, data binary")


def test_lookup_against_pixels(spark, monkeypatch):
    # Every pixel has its own height; one tile and some pixels are missing; points also lie on edges of the map.
    zoom, size = 3, 8
    last = (1 << zoom) - 1
    rng = np.random.default_rng(5)
    grid = np.floor(rng.uniform(-500, 4000, (size << zoom, size << zoom)) * 100 + 0.5) / 100
    grid[rng.random(grid.shape) < 0.02] = np.nan
    grid[size : 2 * size, 2 * size : 3 * size] = np.nan
    every = spark.range(1 << 2 * zoom).selectExpr("'a' AS layer", f"{zoom} AS z", "CAST(id % 8 AS INT) AS x", "CAST(floor(id / 8) AS INT) AS y").where("x <> 2 OR y <> 1")
    tiles = tiles_of(spark, every, lambda x, y: grid[y * size : y * size + size, x * size : x * size + size])
    lon = np.concatenate([rng.uniform(-180, 180, 300), [-180, 180, 0, 0, 5, 5], np.full(200, 10.0)])
    lat = np.concatenate([rng.uniform(-85, 85, 300), [0, 0, 85.051, -85.051, 89, -89], np.full(200, 12.0)])
    points = spark.createDataFrame([("t", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [("t", 900, None, 1.0)], "track_id string, seq long, lat_deg double, lon_deg double")
    rad = np.radians(lat)
    gx, gy = (lon + 180) / 360 * (size << zoom) - 0.5, (1 - np.log(np.tan(rad) + 1 / np.cos(rad)) / np.pi) / 2 * (size << zoom) - 0.5
    i, j = np.floor(gx).astype(int), np.floor(gy).astype(int)
    at = lambda x, y: grid[np.clip(y, 0, (size << zoom) - 1), np.clip(x, 0, (size << zoom) - 1)]
    u, v = gx - i, gy - j
    want = (1 - u) * (1 - v) * at(i, j) + u * (1 - v) * at(i + 1, j) + (1 - u) * v * at(i, j + 1) + u * v * at(i + 1, j + 1)
    # The second run deals the points of shared tiles out over copies of them.
    for group in (1 << 20, 50):
        monkeypatch.setattr(terrain, "GROUP", group)
        rows = terrain.lookup(points, tiles, zoom, "a", size).collect()
        got = {r.seq: r.h for r in rows}
        assert len(rows) == len(lat) + 1 and np.isnan(got[900]) and last == 7
        assert np.array([got[n] for n in range(len(lat))]) == pytest.approx(want, abs=0.02, nan_ok=True)
    assert terrain.failures(points, tiles, zoom, "a", size).collect() == [(zoom, 2, 1)]


def test_road_heights(spark):
    # Half a river valley crossed on a bridge, then a mountain that the road goes through.
    n = 1200
    line = spark.range(n).select(F.lit("a").alias("track_id"), F.col("id").alias("seq"), F.radians(F.lit(45.0)).alias("latitude"), F.radians(6.0 + F.col("id") * 2.5e-5).alias("longitude"), (F.col("id") * 1000.0).alias("time"), F.lit(100.0).alias("elevation"))
    from ridgeline.operators.derive import derive

    d = points(derive(points(line)))
    east = lambda x: (x - (6.0 + 180) / 360 * (256 << 15)) / (256 << 15) * 360 * 78_600.0
    column = lambda x: east(x * 256 + np.arange(256) + 0.5)
    valley = lambda s: 100 - np.clip(np.minimum((s - 300) * 0.2, (600 - s) * 0.2), 0, 20)
    hill = lambda s: np.clip(np.minimum((s - 1000) * 0.6, (1700 - s) * 0.6), 0, 120)
    at = d.select("track_id", "seq", F.degrees("latitude").alias("lat_deg"), F.degrees("longitude").alias("lon_deg"))
    rows = lambda h: np.repeat(h[None, :], 256, axis=0)
    mnt = tiles_of(spark, terrain.reached(terrain.placed(at, {"ign_lidar_hd": 15}, 256, ()), 256), lambda x, y: rows(valley(column(x)) + hill(column(x))))
    mns = tiles_of(spark, terrain.reached(terrain.placed(at, {"ign_lidar_hd_mns": 15}, 256, ()), 256), lambda x, y: rows(np.maximum(valley(column(x)), 100.0) + hill(column(x))))
    tiles = mnt.unionByName(mns)
    fixed = terrain.fix_elevation(d, tiles)
    before = fixed.agg(F.min("elevation"), F.max("elevation")).first()
    assert before[0] == pytest.approx(80, abs=0.5) and before[1] == pytest.approx(220, abs=3)
    out = terrain.road_heights(fixed, tiles)
    after = out.agg(F.min("elevation"), F.max("elevation"), F.count("*")).first()
    # Pins lie where the ground is no more than a metre below.
    assert 98.9 < after[0] < 100.5 and after[1] < 105 and after[2] == n
    report = {r.kind: r for r in terrain.road_heights(fixed, tiles, report=True).collect()}
    assert report["deck"].status == "DECK" and report["deck"].length == pytest.approx(300, abs=20)
    assert report["tunnel"].status == "TUNNEL" and report["tunnel"].start == pytest.approx(1000, abs=20)
    # Without a surface there are no decks, and tunnels need measured ground.
    other = terrain.road_heights(fixed, mnt.withColumn("layer", F.lit("mapterhorn")), {"mapterhorn": 15}, report=True).collect()
    assert [(r.kind, r.status) for r in other] == [("tunnel", "LEFT")]
    drawn = enhance(fixed, EnhanceOptions(fix_elevation=True, bridge_decks=True, tunnels=True, smooth=False, virtualize=False, one_hz=False, w_prime=False, simplify=False), tiles=tiles)
    assert drawn.agg(F.min("elevation"), F.max("elevation")).first() == pytest.approx((100, 102.5), abs=2.6)
    with pytest.raises(ValueError):
        enhance(fixed, EnhanceOptions(bridge_decks=True))


def test_profile_and_decks(spark):
    line = spark.createDataFrame([("a", 0, 45.2, 6.01), ("a", 1, 45.2, 6.012)], "track_id string, seq long, lat_deg double, lon_deg double")
    d = terrain.along(line, 10.0)
    gaps = d.count() - 1
    assert 15 <= gaps <= 17
    flat = tiles_of(spark, terrain.reached(terrain.placed(d, {"mapterhorn": 12}, 256, ()), 256), lambda x, y: np.full((256, 256), 7.5))
    p = terrain.profile(line, flat, {"mapterhorn": 12}, smooth_m=50.0, simplify_m=5.0).collect()
    assert [r.seq for r in p] == [0, gaps] and all(r.elevation == pytest.approx(7.5) for r in p)
    k = F.col("seq")
    st = spark.range(120).select(F.lit("a").alias("track_id"), F.col("id").alias("seq")).withColumn("mnt", F.when(k.between(40, 80), 90.0).otherwise(100.0)).withColumn("mns", F.lit(100.0)).withColumn("mnh", F.col("mns") - F.col("mnt"))
    assert terrain.deck_profile(st).agg(F.min("deck")).first()[0] == pytest.approx(100.0)
    report = terrain.correction_report(terrain.bridge_decks(st)).first()
    assert (report.status, report.n) == ("DECK", 1)


def test_pipeline(spark, ride):
    out = enhance(ride)
    rows = out.orderBy("seq").collect()
    assert rows[0].time == 0 and [r.seq for r in rows] == list(range(len(rows))) and out.columns[2:] == FIELDS
    assert enhance(ride.where("seq < 0")).count() == 0
    assert shape.headwind(ride).first().azimuth_deg == pytest.approx(180, abs=0.5)


def test_resampling_agrees_with_the_kernels(spark, ride):
    d = ride.withColumn("time", F.col("time") + F.col("seq") * 137.0)
    a = [(r.time, round(r.elevation, 6)) for r in resample.one_hz(d).orderBy("seq").collect()]
    b = [(r.time, round(r.elevation, 6)) for r in resample.per_second(d).orderBy("seq").collect()]
    assert a == b


def test_long_tracks_take_linear_time(spark):
    n = 100_000
    d = spark.range(n).select(F.lit("a").alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 5.0).alias("distance"), F.lit(30.0).alias("radius"), F.lit(14.0).alias("speedMaxIncline"), (F.col("id") * 1000.0).alias("time"), F.when(F.col("id") < 1000, 270.0).otherwise(250.0).alias("pComputedPower"))
    v = motion.braking_pass(d).agg(F.min("speedMax"), F.max("speedMax"), F.count("*")).first()
    assert v[0] == 2 and 13 < v[1] <= 14 and v[2] == n
    assert energetics.w_prime_balance(d).where(f"seq = {n - 1}").first().wPrimeBalance == pytest.approx(20_000 - 999 * 20)


def test_segments_in_order(spark):
    rows = [("a", 0, i, 45.0, 6 + i * 0.01) for i in range(3)] + [("a", 1, i, 45.0, 6.05 - i * 0.01) for i in range(2)] + [("a", 2, i, 45.0, 6.06 + i * 0.01) for i in range(2)]
    d = spark.createDataFrame(rows, "track_id string, seg_idx int, pt_idx int, lat double, lon double").withColumn("latitude", F.radians("lat")).withColumn("longitude", F.radians("lon"))
    out = road.ordered_segments(d)
    assert out.columns == d.columns
    assert [round(r.lon, 2) for r in out.orderBy("seg_idx", "pt_idx").collect()] == [6.0, 6.01, 6.02, 6.04, 6.05, 6.06, 6.07]


def test_options():
    for bad in (lambda: GainOptions.preset("x"), lambda: RacingLineOptions(corridor="x"), lambda: Cyclist(mass_kg=0)):
        with pytest.raises(ValueError):
            bad()


def test_catalog(spark):
    rows = field_catalog(spark).collect()
    assert len(rows) == 44 and sum(r.nan_default for r in rows) == 6 and sum(r.circular for r in rows) == 6
