import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import road, shape
from ridgeline.plans.trace import trace_points
from ridgeline.sources import maps, vp8l
from ridgeline.streaming import rides

SF = "/root/testdata/sf0.001"
# A lossless picture of four pixels with known values.
WEBP = "5249464632000000574542505650384c250000002f030000001f20202164badd860848089e5b2eb2018ae275579be63f805a7f35286d44ff0300"


def test_webp():
    assert vp8l.decode(bytes.fromhex(WEBP)).tolist() == [[[0, 0, 0, 255], [1, 2, 3, 255], [127, 128, 129, 255], [255, 254, 253, 255]]]
    for bad in (b"", b"RIFF0000WEBPVP8 ", bytes.fromhex(WEBP)[:30]):
        with pytest.raises(ValueError):
            vp8l.decode(bad)


def test_projection():
    assert maps.lon_x(0, 0) == 128 and maps.lat_y(0, 0) == pytest.approx(128)
    assert maps.lon_x(180, 3) == 256 * 8 - 1
    for lon, lat in ((6.1, 45.2), (-120.0, -60.0)):
        assert maps.x_lon(maps.lon_x(lon, 9), 9) == pytest.approx(lon)
        assert maps.y_lat(maps.lat_y(lat, 9), 9) == pytest.approx(lat)
    west, south, east, north = maps.tile_bounds(2, 1, 1)
    assert (west, east) == (-90, 0) and south == pytest.approx(0, abs=1e-9) and north > 60


def test_framing(spark):
    box = maps.box_of(trace_points(spark, SF))
    f = maps.of_max_size(box, 600)
    assert max(f.width, f.height) <= 600 and max((g := maps.of_zoom(box, f.zoom + 1)).width, g.height) > 600
    g = maps.of_size(box, 320, 200)
    assert (g.width, g.height) == (320, 200)
    x, y = g.pixel(*g.place(10, 20))
    assert (x, y) == (pytest.approx(10), pytest.approx(20))


def pixels(data: bytes) -> np.ndarray:
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT") + 4
    raw = zlib.decompress(data[at : at + struct.unpack(">I", data[at - 8 : at - 4])[0]])
    return np.frombuffer(raw, dtype=np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_pictures():
    f = maps.Frame(10, 1000.0, 2000.0, 300, 200)
    line = np.array([f.place(10, 10), f.place(290, 190)])
    image = pixels(maps.tile_map(f, lambda z, x, y: np.full((256, 256, 4), 40, np.uint8) if x == 3 else None, [line]))
    assert image[100, 10].tolist() == [40, 40, 40] and image[100, 299].tolist() == [230, 230, 230]
    assert image[10, 10].tolist() == [220, 30, 30]
    with pytest.raises(ValueError):
        maps.tile_map(f, lambda *_: None, [], "FAIL")
    flat = pixels(maps.terrain_map(f, lambda lon, lat: np.full(len(lon), 5.0)))
    none = pixels(maps.terrain_map(f, lambda lon, lat: np.full(len(lon), np.nan)))
    assert len(np.unique(flat.reshape(-1, 3), axis=0)) == 1 and (none == 128).all()
    slope = pixels(maps.terrain_map(f, lambda lon, lat: lat))
    assert slope[0, 0].tolist() == [245, 245, 245] and slope[-1, 0].tolist() == [70, 130, 80]


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", 350.0) for s in range(0, 20)] + [("b", "2024-01-01 00:00:00", 100.0), ("b", "2024-01-01 01:00:00", 100.0)]
    df = spark.createDataFrame(rows, "track_id string, ts string, power double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("track_id = 'a' and second(ts) < 10").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    df.where("not (track_id = 'a' and second(ts) < 10)").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(out, mode="append"):
        name = f"q{abs(hash(str(tmp_path)))}"
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return s, run


def test_stream_reserve(stream):
    s, run = stream
    rows = [r for r in run(rides.w_prime(s)) if r.track_id == "a"]
    assert len(rows) == 20 and min(r.w_prime for r in rows) == pytest.approx(20_000 - 19 * 100)


def test_stream_slew(stream):
    s, run = stream
    rows = sorted((r for r in run(rides.slew_limited(s)) if r.track_id == "a"), key=lambda r: r.ts)
    assert [r.power for r in rows[:9]] == [0, 50, 100, 150, 200, 250, 300, 350, 350]


def test_stream_windows(stream):
    s, run = stream
    rows = run(rides.per_second(s))
    assert len(rows) >= 20 and all(r.n == 1 for r in rows)


def test_stream_sessions(stream):
    s, run = stream
    rows = run(rides.sessions(s), "append")
    assert ("a", 20) in {(r.track_id, r.n) for r in rows}


def test_matching_and_deltas(spark):
    line = spark.createDataFrame([("a", i, float(i * 10), 0.0) for i in range(20)], "track_id string, seq long, x double, y double")
    moved = line.withColumn("y", F.lit(4.0))
    assert [r.along for r in road.match(moved, line).orderBy("seq").collect()] == pytest.approx([i * 10.0 for i in range(20)])
    d = spark.createDataFrame([([100, 5, -3],)], "v array<int>")
    assert road.delta_decode(d, "v", 0.1).first().v == pytest.approx([10.0, 10.5, 10.2])


def test_headwind_of_all(spark):
    p = trace_points(spark, SF)
    assert shape.headwind(p, by=None).count() == 1


def test_climb_candidates_reach_the_summit(spark):
    rows = [("long", i, 10.0 * i, 0.5 * i) for i in range(201)] + [("short", i, 10.0 * i, 0.5 * i) for i in range(41)]
    found = {(r.track_id, r.first): r for r in shape.climb_candidates(spark.createDataFrame(rows, "track_id string, seq long, distance double, elevation double")).collect()}
    assert found["long", 0]["last"] == 200 and found["long", 50]["last"] == 200 and found["short", 0]["last"] == 40
    assert found["long", 0].score == pytest.approx(2000 * 5**1.3)
