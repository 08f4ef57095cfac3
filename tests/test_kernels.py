"""Values with a known answer, and properties that hold on any track."""

import itertools
import math

import numpy as np
import pytest

from ridgeline.functions import decks
from ridgeline.functions import kernels as k
from ridgeline.functions import sequence as q
from ridgeline.options import Bike, ClimbOptions, Cyclist, DeckOptions, GainOptions, PowerSpec, RacingLineOptions, Wind, for_road


def track(lat=None, lon=None, ele=None, time=None, **more):
    n = len(lat if lat is not None else ele)
    lat = np.zeros(n) if lat is None else np.radians(lat)
    lon = np.zeros(n) if lon is None else np.radians(lon)
    return k.derive(k.fresh(n, latitude=lat, longitude=lon, elevation=np.zeros(n) if ele is None else ele, time=np.arange(n) * 1000.0 if time is None else time, **more))


def meridian(d, ele=None):
    return track(lat=45 + np.asarray(d) / 111_194.92664, ele=ele if ele is not None else np.zeros(len(d)))


def wavy(n=400, seed=3):
    rng = np.random.default_rng(seed)
    d = np.cumsum(rng.uniform(3, 12, n))
    return track(lat=45 + d / 111_320, lon=6 + 0.002 * np.sin(d / 150), ele=500 + 40 * np.sin(d / 400) + rng.normal(0, 1, n).cumsum() * 0.3)


def test_haversine():
    assert k.haversine(0, 0, 0, math.radians(1)) == pytest.approx(math.pi * 6_371_000 / 180, rel=1e-9)
    paris, london = np.radians([48.8566, 2.3522]), np.radians([51.5074, -0.1278])
    assert 340_000 < k.haversine(*paris, *london) < 350_000


def test_derived():
    t = meridian([0, 100, 200], [0, 5, 10])
    assert t["grade"] == pytest.approx([0.05] * 3, abs=1e-3)
    assert t["dx"] == pytest.approx([50, 100, 50], abs=0.01)
    assert track(lat=[45, 45.001], time=[0, 10_000])["speed"][0] == pytest.approx(11.1, abs=0.1)
    assert k.derive(k.fresh(0))["distance"].size == 0
    assert track(lat=[45.0])["distance"].tolist() == [0.0]


def test_interpolation_takes_the_shorter_arc():
    t = k.fresh(2, longitude=np.radians([179.0, -179.0]), elevation=[10.0, 20.0])
    out = k.between(t, np.array([0, 0]), np.array([1, 1]), np.array([0.25, 0.75]))
    assert np.degrees(out["longitude"]) == pytest.approx([179.5, -179.5])
    assert k.between(t, np.array([0]), np.array([1]), np.array([0.5]))["elevation"][0] == 15


def test_one_hz():
    assert k.per_second(track(lat=[45.0], time=[1234.0]))["time"].tolist() == [1000.0, 2000.0]
    assert len(k.per_second(track(lat=[45, 45.001], time=[0.0, 5000.0]))["time"]) == 6
    once = k.per_second(track(lat=45 + np.arange(9) / 1e4, time=np.arange(9) * 1700.0 + 300))
    assert k.per_second(once)["time"].tolist() == once["time"].tolist()


def test_per_distance():
    t = meridian([0, 4, 9, 100, 101])
    out = k.per_distance(t, 5.0, 30.0)
    gaps = np.diff(out["distance"])
    assert out["distance"][0] == 0 and gaps.max() <= 30.001 and len(out["distance"]) == 6
    dense = k.per_distance(t, -1.0, 30.0)
    assert dense["distance"][-1] == pytest.approx(t["distance"][-1], abs=1e-6)


def test_smoothing_of_three_points():
    s, w = np.array([0.0, 100.0, 200.0]), 50.0
    e = np.array([100.0, 200.0, 150.0])
    s0, s1 = 1.0, -0.5
    assert k.smooth_profile(s, e, w) == pytest.approx([100 + s0 * w / 3, 200 + (s1 - s0) / 2 * w / 3, 150 - s1 * w / 3], abs=1e-9)
    assert k.smooth_profile(s[:2], e[:2], w).tolist() == [100.0, 200.0]


def test_hysteresis():
    gain = lambda h, t=3.0: k.gain(np.arange(len(h)) * 100.0, np.array(h), np.full(len(h), np.nan), GainOptions(t, 0.0))
    assert (gain([0, 3.0, 0])["gain"], gain([0, 3.0, 0])["loss"]) == (3, -3)
    assert gain([0, 2.99, 0])["gain"] == 0
    g = gain([0, -2.9, 100, 97.1])
    assert (g["gain"], g["loss"], g["legs"]) == (pytest.approx(102.9), pytest.approx(-2.9), 2)
    g = gain([0, 50, 10, 90, 30, 0])
    assert (g["gain"], g["loss"]) == (130, -130)
    h = wavy()["elevation"]
    c = k.cumulative_gain(h, 3.0)
    assert (np.diff(c) >= -1e-9).all() and c[-1] == pytest.approx(sum(h[b] - h[a] for a, b in k.legs(h, 3.0) if h[b] > h[a]))


def test_gain_falls_as_the_threshold_grows():
    t = wavy()
    found = [k.gain(t["distance"], t["elevation"], t["sourceElevation"], GainOptions(x, 0.0))["gain"] for x in (1, 2, 3, 5, 10, 20)]
    assert found == sorted(found, reverse=True)


def test_physics_steps():
    assert k.step_length(100, 80, 10, 1) == pytest.approx((10 + math.sqrt(102.5)) / 2)
    assert k.step_time(0, 80, 10, 100) == pytest.approx(10, abs=1e-4)
    assert k.air_density(0, 15) == pytest.approx(1.2250122660, abs=1e-9)
    assert k.air_density(1500, math.nan) == pytest.approx(1.0222742910, abs=1e-9)
    assert k.air_density(3000, 15) == pytest.approx(0.8476041319, abs=1e-9)


def test_w_prime():
    t = np.arange(11) * 1000.0
    assert k.w_prime(t, np.full(11, 350.0), 250, 20_000)[-1] == pytest.approx(19_000)
    assert k.w_prime_step(0, 0, 250, 20_000, 60) == pytest.approx(20_000 * (1 - math.exp(-0.75)))
    assert (k.w_prime(t, np.full(11, 5000.0), 250, 20_000) >= 0).all()


def test_speed_limits():
    t = k.max_speeds(wavy())
    assert t["speedMax"][-1] == 2.0 and (t["radius"][:-1] >= 5).all() and (t["radius"][:-1] <= 200).all()
    c = Cyclist()
    assert math.sqrt(9.80665 * 30 * c.tan_lean) == pytest.approx(14.36, abs=0.01)
    d = np.diff(t["distance"])
    assert (t["speedMax"][:-1] ** 2 <= t["speedMax"][1:] ** 2 + 2 * c.max_brake_g * 9.80665 * d + 1e-6).all()
    assert for_road(c, "wet").max_brake_g < c.max_brake_g and for_road(c, None) == c
    assert k.wrap_change(np.array([3 * math.pi / 2, -3 * math.pi / 2])) == pytest.approx([-math.pi / 2, math.pi / 2])


@pytest.mark.parametrize("spec", [PowerSpec(), PowerSpec("critical_power"), PowerSpec("durability"), PowerSpec(pacing=True, slew_w_per_s=50.0)])
def test_simulation(spec):
    t = k.max_speeds(wavy())
    r = k.virtualize(t, spec=spec, wind=Wind(2.0, 1.0))
    assert r["time"][0] == 0 and (np.diff(r["time"]) > 0).all()
    assert (r["virtSpeedCurrent"][1:] <= t["speedMax"][1:] + 1e-9).all() and (r["pBrake"] <= 0).all()
    assert r["elapsed"][-1] > 60


def test_pedals_up_in_turns():
    t = k.max_speeds(wavy())
    free, held = (k.virtualize(t, bike=Bike(max_pedal_lean_deg=x))["elapsed"][-1] for x in (None, 5.0))
    assert held >= free


def test_long_climbs_are_thinned_within_the_bound():
    d = np.arange(7000) * 2.0
    e = np.minimum(d, 6000) * 0.05
    o = ClimbOptions(max_points=3000)
    found = k.climbs(d, e, o)
    assert found and found[0]["last"] <= 6999 and k.ascent(e) == pytest.approx(300)
    seen = []
    best = k.best_climbs
    k.best_climbs = lambda x, y, *rest: seen.append(len(x)) or best(x, y, *rest)
    try:
        k.climbs(d[:6001], e[:6001], o)
        k.climbs(d[:3000], e[:3000], o)
    finally:
        k.best_climbs = best
    assert seen[0] <= 3000 and seen[1] == 3000


def test_climbs():
    d = np.arange(0, 10_001, 100.0)
    one = k.climbs(d, d * 0.05)
    assert len(one) == 1 and one[0]["grade"] == pytest.approx(0.05) and one[0]["start"] == 0 and one[0]["end"] == 10_000
    found = k.climbs(wavy()["distance"], wavy()["elevation"])
    for a, b in zip(found[:-1], found[1:], strict=True):
        assert a["last"] < b["first"]
    for c in found:
        assert c["parts"][0]["start"] == c["start"] and c["parts"][-1]["end"] == c["end"]


def test_simplify():
    line = np.stack([np.arange(100.0), np.zeros(100), np.zeros(100)], axis=1)
    assert k.farthest_points(line, 0.5).tolist() == [0, 99]
    line[50, 1] = 3
    assert 50 in k.farthest_points(line, 0.5)
    assert k.farthest_points(line[:1], 1).tolist() == [0]


def test_curvature_of_a_circle():
    a = np.linspace(0, 2 * math.pi, 300)
    r = 50.0
    t = track(lat=45 + r * np.sin(a) / 111_194.9, lon=6 + r * np.cos(a) / (111_194.9 * math.cos(math.radians(45))))
    kappa = k.curvature(t)["trajectoryCurvature"]
    assert np.median(kappa) == pytest.approx(1 / r, rel=0.03)
    assert np.isnan(k.curvature(k.take(t, slice(0, 5)))["trajectoryCurvature"]).all()


def test_corners_and_racing_line():
    a = np.linspace(0, math.pi, 80)
    x = np.concatenate([np.arange(-300, 0, 4.0), 40 * np.sin(a), np.arange(0, -300, -4.0)])
    y = np.concatenate([np.zeros(75), 40 - 40 * np.cos(a), np.full(75, 80.0)])
    t = track(lat=45 + y / 111_194.9, lon=6 + x / (111_194.9 * math.cos(math.radians(45))))
    o = RacingLineOptions(enabled=True, corridor="full-road")
    found = q.racing_line(t, o)
    assert [c["kind"] for c in found["corners"]] == ["HAIRPIN"]
    assert (found["offset"] >= found["lo"] - 1e-9).all() and (found["offset"] <= found["hi"] + 1e-9).all()
    assert np.abs(found["offset"]).max() > 0.5
    band, g = q.energy(found["frame"], o)
    value = lambda v: 0.5 * v @ q.apply(band, v) + g @ v
    assert value(found["offset"]) <= value(np.zeros(len(g))) + 1e-12
    zero = q.drive(t, RacingLineOptions(enabled=True, default_width_m=1.0))
    assert np.abs(zero["lateralOffset"]).max() == 0


def test_banded_solver():
    rng = np.random.default_rng(1)
    n = 30
    band = np.stack([rng.uniform(4, 6, n), rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)])
    full = np.diag(band[0]) + sum(np.diag(band[i, : n - i], i) + np.diag(band[i, : n - i], -i) for i in (1, 2))
    rhs, free = rng.normal(size=n), rng.random(n) < 0.8
    want = np.zeros(n)
    want[free] = np.linalg.solve(full[np.ix_(free, free)], rhs[free])
    assert q.banded_solve(band, rhs, free) == pytest.approx(want)
    assert q.apply(band, want) == pytest.approx(full @ want)


def flat(n, ground=10.0):
    return np.full(n, ground), np.full(n, ground)


def bridge(mnt, mns, a, b, under, top):
    mnt[a : b + 1] = under
    mns[a : b + 1] = top(np.arange(a, b + 1)) if callable(top) else top


def detect(mnt, mns, mnh=None, **options):
    return decks.find(mnt, mns, mns - mnt if mnh is None else mnh, DeckOptions(**options))


def canyon_bridge():
    mnt, mns = flat(200)
    bridge(mnt, mns, 55, 124, 10.0, 12.0)
    bridge(mnt, mns, 60, 119, 2.0, 12.0)
    return mnt, mns


def spans(found):
    return [(d["first"], d["last"], d["status"]) for d in found]


def test_decks():
    (d,) = detect(*canyon_bridge())
    assert (d["first"], d["last"], d["status"], d["start"], d["end"], d["length"]) == (55, 124, "DECK", 275, 620, 350)
    assert (d["slope_p95"], d["roughness"], d["smooth_fraction"], d["canyon"], d["drop"], d["top"]) == (0, 0, 1, 10, 8, 12)
    assert d["ranges"] == [{"first": 55, "last": 124}]
    assert detect(*flat(300)) == [] and detect(*flat(0)) == []
    for bad in ({"median_window_m": 20.0}, {"step_m": 4.0}, {"min_clean_stations": 1}):
        with pytest.raises(ValueError):
            DeckOptions(**bad)


def test_deck_slopes():
    def camber(grade):
        mnt, mns = flat(200)
        bridge(mnt, mns, 55, 124, 2.0, lambda i: 30 - grade / 350 * ((i - 89.5) * 5) ** 2)
        return mnt, mns

    mnt, mns = camber(0.059)
    piles = [74, 75, 94, 95, 114, 115]
    mnt[piles] = mns[piles] - 2
    (d,) = detect(mnt, mns)
    assert (d["first"], d["last"], d["status"]) == (55, 124, "DECK") and 0.045 < d["slope_p95"] < 0.059 and d["slope_max"] < 0.059
    assert spans(detect(*camber(0.12))) == [(55, 124, "STEEP")]

    def ramp(rise):
        mnt, mns = flat(200)
        bridge(mnt, mns, 55, 124, 2.0, lambda i: 30 + rise * (i - 55))
        return detect(mnt, mns)

    assert ramp(0.5)[0]["slope_p95"] == pytest.approx(0.1, abs=1e-12) and ramp(0.5)[0]["status"] == "DECK" and ramp(0.505)[0]["status"] == "STEEP"


def test_deck_rejections():
    mnt = 100 + 0.1 * np.arange(220)
    mns = mnt.copy()
    crowns = np.concatenate([np.arange(50, 90), np.arange(100, 140)])
    mns[crowns] += 15 + (crowns * 7919 % 13 - 6) * 0.5
    assert spans(detect(mnt, mns)) == [(50, 139, "ROUGH")]

    def roof(under):
        mnt, mns = flat(200, 50.0)
        bridge(mnt, mns, 50, 89, under, 60.0)
        return [d["status"] for d in detect(mnt, mns)]

    assert (roof(50.0), roof(47.0), roof(46.99)) == (["NO_CANYON"], ["NO_CANYON"], ["DECK"])
    for stations, n in ((2, 0), (3, 1)):
        mnt, mns = flat(100)
        bridge(mnt, mns, 50, 49 + stations, 0.0, 20.0)
        assert len(detect(mnt, mns)) == n
    for dip, status in ((106, "NO_CANYON"), (105, "ROUGH")):
        mnt, mns = flat(200)
        bridge(mnt, mns, 100, 104, 10.0, 20.0)
        mns[dip] = -10
        assert [d["status"] for d in detect(mnt, mns)] == [status]
    none = np.full(3, np.nan)
    assert spans(detect(none, none, np.full(3, 10.0))) == [(0, 2, "NO_DATA")]


def test_deck_spans():
    def two(missing):
        second = 70 + missing
        mnt, mns = flat(300)
        bridge(mnt, mns, 50, second + 19, 2.0, 12.0)
        mnt[70:second] = 10
        mnt[(69 + second) // 2] = 11.5
        return [(d["first"], d["last"]) for d in detect(mnt, mns, max_abutment_m=1000.0) if d["status"] == "DECK"]

    assert two(59) == [(50, 148)] and two(60) == [(50, 98), (100, 149)]
    mnt, mns = flat(300)
    bridge(mnt, mns, 50, 169, 2.0, 12.0)
    mnt[70:150] = 10
    assert spans(detect(mnt, mns, max_abutment_m=1000.0)) == [(50, 169, "DECK")]
    for field, last in ((20, 159), (21, 139)):
        mnt, mns = flat(800)
        bridge(mnt, mns, 100, 139, 2.0, 12.0)
        mns[140 : 140 + field] = mnt[140 : 140 + field] + 2
        assert [d["last"] for d in detect(mnt, mns) if d["status"] == "DECK"] == [last]


def test_deck_gaps():
    mnt, mns = canyon_bridge()
    mnh = mns - mnt
    mnh[56:58] = np.nan
    assert spans(detect(mnt, mns, mnh)) == [(55, 124, "DECK")]
    wide = mns.copy()
    wide[56:59] = np.nan
    assert spans(detect(mnt, wide)) == [(59, 124, "NO_DATA")]
    for hole in (62, 70, 117):
        holed = mns.copy()
        holed[hole] = np.nan
        (d,) = detect(mnt, holed)
        assert (d["status"], d["ranges"]) == ("DECK", [{"first": 55, "last": 124}])
    low = mns.copy()
    low[90] = mnt[90] - 1e6
    assert detect(mnt, low)[0]["ranges"] == [{"first": 55, "last": 124}]
    wide = mns.copy()
    wide[70:73] = np.nan
    assert detect(mnt, wide)[0]["ranges"] == [{"first": 55, "last": 69}, {"first": 73, "last": 124}]

    def blip(a, at, b):
        mnt, mns = flat(200)
        bridge(mnt, mns, a[0], b[1], 19.5, 20.0)
        for p, q in (a, b):
            mnt[p : q + 1] = 2
        mnt[at[0] : at[1] + 1] = 18
        (d,) = detect(mnt, mns)
        return [(r["first"], r["last"]) for r in d["ranges"]]

    assert blip((100, 107), (115, 117), (125, 132)) == [(100, 107), (125, 132)]
    assert blip((100, 102), (106, 106), (110, 112)) == [(100, 102), (106, 106), (110, 112)]
    assert blip((100, 102), (105, 105), (108, 110)) == [(100, 110)]
    (w,) = decks.surface_windows(canyon_bridge()[1] - canyon_bridge()[0])
    assert w == (50, 129)


def test_deck_profile():
    mnt, mns = canyon_bridge()
    survey = mnt, mns, mns - mnt
    (r,) = decks.stretches(*survey, detect(mnt, mns))
    assert (r.first, r.last, r.pinned) == (54, 125, (True, True)) and r.written(5.0) == (270, 625)
    z = decks.profile(mnt, [r])
    assert z[54] == 10 and z[125] == 10 and z[r.anchors[0] : r.anchors[-1] + 1] == pytest.approx(12) and (np.diff(z[54 : r.anchors[0] + 1]) > 0).all()
    raised = decks.least_above(np.array([0.0, 0, 10, 0, 0]), 1.0)
    assert raised.tolist() == [8, 9, 10, 9, 8]
    s = np.arange(0, 1000, 2.0)
    road = decks.write(s, np.full(len(s), 10.0), [r], 5.0)
    assert road[s < 270].max() == 10 and road[(s > 320) & (s < 590)] == pytest.approx(12) and road[s > 625].max() == 10


def test_tunnels():
    n = 320
    z = np.full(n, 500.0)
    i = np.arange(100, 221)
    z[100:221] += np.minimum(np.minimum((i - 100) * 5 * 0.5, (220 - i) * 5 * 0.5), 80)
    lat = np.radians(45 + np.arange(n) * 5 / 111_194.9)
    found = q.tunnels(z, lat, np.zeros(n))
    assert len(found) == 1 and abs(found[0]["first"] - 100) <= 2 and abs(found[0]["last"] - 220) <= 2
    s = np.arange(n) * 5.0
    assert q.flatten(s, z, found)[160] == pytest.approx(500, abs=3)
    assert q.flatten(s, z, found, [(700.0, 800.0)])[160] == z[160]


def test_segment_order():
    p = lambda x: np.radians([45.0, 6.0 + x])
    ends = np.array([[p(0), p(1)], [p(3), p(2)], [p(1.01), p(1.9)]])
    assert q.best_order(ends) == [(0, False), (2, False), (1, True)]
    assert q.best_order(ends[:1]) == [(0, False)]
    # The first piece need not come first, and stays forward.
    assert q.best_order(np.array([[p(1), p(2)], [p(0), p(0.99)]])) == [(1, False), (0, False)]
    with pytest.raises(ValueError):
        q.best_order(ends, most=21)


def test_segment_order_against_all():
    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 5):
        ends = np.radians(np.stack([rng.uniform(45, 46, (n, 2)), rng.uniform(6, 7, (n, 2))], axis=-1))
        turns = [t for t in itertools.product((False, True), repeat=n) if not t[0]]
        best = min(q.order_gap(ends, [(i, t[i]) for i in o]) for o in itertools.permutations(range(n)) for t in turns)
        assert q.order_gap(ends, q.best_order(ends, 0.0)) == pytest.approx(best, abs=0.01 * n)
    way = np.stack([np.full(19, 45.0), 6 + np.arange(19) * 0.1], axis=-1)
    chain = np.radians(np.stack([way[:-1], way[1:] - [0, 0.01]], axis=1))
    at = rng.permutation(18)
    at = np.concatenate([[0], at[at != 0]])
    assert q.best_order(chain[at], most=20) == [(int(i), False) for i in np.argsort(at)]
    assert q.best_order(chain[at]) == [(i, False) for i in range(18)]


def test_matching():
    rx, ry = np.arange(0, 500, 10.0), np.zeros(50)
    found = q.match(np.array([5.0, 105.0, 205.0]), np.array([3.0, -4.0, 100.0]), rx, ry)
    assert found[:2] == pytest.approx([5, 105]) and np.isnan(found[2])
