import pytest

from ridgeline.functions import sql
from ridgeline.operators.derive import track_stats
from ridgeline.plans.trace import trace_points
from ridgeline.sources import maps, requests

SF = "/root/testdata/sf0.001"


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT haversine_m(0D, 0D, 0D, radians(1D)) AS h, air_density(1500D, double('NaN')) AS rho, aero_power(10D, 1.225D) AS a, rolling_power(10D, 0D, 80D) AS r, bearing_power(10D) AS b, bearing_power(15D) AS b2, cornering_limit(30D) AS c, semicircles(45.680697D) AS s, tile_of(6.1D, 45.2D, 12) AS t, gravity_power(5D, 0.05D, 80D) AS g, terrarium_height(128, 0, 0) AS z").first()
    assert r.h == pytest.approx(111_194.9266, abs=1e-3) and r.rho == pytest.approx(1.0222742910)
    assert r.a == pytest.approx(-214.375) and r.r == pytest.approx(-31.38128) and (r.b, r.b2) == (pytest.approx(-1.78), pytest.approx(-3.3225))
    assert r.c == pytest.approx(14.36, abs=0.01) and r.s == 544991944 and tuple(r.t) == (int(maps.lon_x(6.1, 12) // 256), int(maps.lat_y(45.2, 12) // 256)) and r.g == pytest.approx(-195.8, abs=0.5) and r.z == 0


def test_sql_table_function(spark):
    sql.register(spark)
    spark.createDataFrame([("a", 0.0, 0.0), ("a", 2500.0, 5.0), ("b", 1000.0, 1.0)], "track_id string, time double, value double").createOrReplaceTempView("raw")
    rows = spark.sql("SELECT * FROM one_hz_points(TABLE(raw) PARTITION BY track_id ORDER BY time)").collect()
    assert sorted(map(tuple, rows)) == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 1.0)]
    sql.views(trace_points(spark, SF))
    assert spark.sql("SELECT count(*) AS n FROM points JOIN track_stats USING (track_id)").first().n > 0


def test_strict_settings():
    o = requests.enhance_options('{"smooth_window_m": 50, "racing_line": {"enabled": true}, "gain": {"threshold_m": 2}}')
    assert o.smooth_window_m == 50 and o.racing_line.enabled and o.gain.threshold_m == 2
    with pytest.raises(requests.Problem) as e:
        requests.enhance_options('{"smoth": 1, "one_hz": 3, "racing_line": {"x": 1}}')
    assert set(e.value.errors) == {"/smoth", "/one_hz", "/racing_line/x"} and '"pointer"' in e.value.body()
    for bad in ("[]", "{", '{"smooth_window_m": -1}'):
        with pytest.raises(requests.Problem):
            requests.enhance_options(bad)


def test_admission(spark):
    s = track_stats(trace_points(spark, SF))
    assert requests.admit(s).count() == s.count()
    with pytest.raises(requests.Problem):
        requests.admit(s, 10)


def test_patience():
    answers = iter([(429, b"", {"Retry-After": "3"}), (503, b"", {}), (200, b"x", {})])
    waited = []
    assert requests.patient(lambda: next(answers), sleep=waited.append) == b"x" and waited == [3.0, 2.0]
    assert requests.patient(lambda: (404, b"", {}), sleep=waited.append) is None
    assert requests.patient(lambda: (503, b"", {}), sleep=lambda _: None) is None
