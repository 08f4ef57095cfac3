"""One track at a time in NumPy: folds and whole-sequence algorithms that have no Column form.

A track is a dictionary of arrays, one for each field; functions return new arrays and leave their input
alone. They run inside grouped functions, one call a track.
"""

from __future__ import annotations

import math

import numpy as np

from ridgeline.options import EARTH_RADIUS, G, MIN_SPEED, Bike, ClimbOptions, CurvatureOptions, Cyclist, GainOptions, PowerSpec, Wind
from ridgeline.schema import CIRCULAR, FIELDS, default

Track = dict[str, np.ndarray]


def size(t: Track) -> int:
    return len(t["latitude"])


def fresh(n: int, **given) -> Track:
    t = {f: np.full(n, default(f)) for f in FIELDS}
    t.update({k: np.asarray(v, dtype=float) for k, v in given.items()})
    return t


def copy(t: Track) -> Track:
    return {k: v.copy() for k, v in t.items()}


def take(t: Track, rows) -> Track:
    return {k: v[rows] for k, v in t.items()}


def unwrap(a):
    r = a - 2 * math.pi * np.floor(a / (2 * math.pi) + 0.5)
    return np.where(r <= -math.pi, r + 2 * math.pi, r)


def wrap_change(a):
    """Into [-pi, pi] by whole turns."""
    return np.where(np.abs(a) <= math.pi, a, a - np.sign(a) * 2 * math.pi * np.ceil((np.abs(a) - math.pi) / (2 * math.pi)))


def haversine(lat1, lon1, lat2, lon2):
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    a = np.clip(a, 0, 1)
    return EARTH_RADIUS * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def derive(t: Track) -> Track:
    """Distance from the coordinates, elapsed time, and centred bearing, dx, grade, dt and speed."""
    t = copy(t)
    n = size(t)
    if n == 0:
        return t
    lat, lon = t["latitude"], t["longitude"]
    step = haversine(lat[:-1], lon[:-1], lat[1:], lon[1:])
    t["distance"] = np.concatenate([[0.0], np.cumsum(step)])
    t["elapsed"] = (t["time"] - t["time"][0]) / 1000
    if n == 1:
        return t
    a, b = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    dlon = lon[b] - lon[a]
    dlon = np.where(dlon > math.pi, dlon - 2 * math.pi, np.where(dlon <= -math.pi, dlon + 2 * math.pi, dlon))
    t["bearing"] = np.arctan2(-(lat[b] - lat[a]), dlon * np.cos((lat[a] + lat[b]) / 2))
    dx, de, dt = (t["distance"][b] - t["distance"][a]) / 2, (t["elevation"][b] - t["elevation"][a]) / 2, (t["time"][b] - t["time"][a]) / 2000
    with np.errstate(divide="ignore", invalid="ignore"):
        t["grade"], t["speed"] = np.where(dx == 0, 0.0, de / dx), np.where(dt == 0, 0.0, dx / dt)
    t["dx"], t["dt"] = dx, dt
    return t


def between(t: Track, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> Track:
    """All fields between points a and b, at shares u of the way; angles take the shorter arc."""
    out = {}
    for k, v in t.items():
        out[k] = unwrap(v[a] + u * unwrap(v[b] - v[a])) if k in CIRCULAR else v[a] + u * (v[b] - v[a])
    return out


def join(parts: list[Track]) -> Track:
    return {k: np.concatenate([p[k] for p in parts]) for k in FIELDS}


# --- resampling --------------------------------------------------------------------------------


def per_distance(t: Track, least: float, most: float) -> Track:
    """Points nearer than `least` to the last kept one go; longer gaps than `most` are cut into equal
    pieces along the source line. The first point stays, the last may go."""
    n = size(t)
    if n == 0:
        return t
    d = t["distance"].tolist()
    a, u, last = [0], [0.0], 0
    for i in range(1, n):
        gap = d[i] - d[last]
        if gap < least:
            continue
        if gap > most:
            pieces = math.ceil(gap / most)
            at = last
            for j in range(1, pieces):
                target = d[last] + j * (gap / pieces)
                while at < i - 1 and d[at + 1] < target:
                    at += 1
                a.append(at)
                u.append((target - d[at]) / (d[at + 1] - d[at]))
        a.append(i)
        u.append(0.0)
        last = i
    a, u = np.array(a), np.array(u)
    exact, out = u == 0, between(t, a, np.minimum(a + 1, n - 1), u)
    for k in out:
        out[k] = np.where(exact, t[k][a], out[k])
    return derive(out)


def per_second(t: Track) -> Track:
    """One point at every whole second from the first to the last."""
    n = size(t)
    if n == 0:
        return t
    time = t["time"]
    plan: dict[int, tuple[int, float]] = {math.floor(time[0] / 1000): (0, 0.0)}
    for i in range(n):
        first = math.floor(time[i] / 1000)
        aligned = time[i] == first * 1000.0
        if i == n - 1:
            if not aligned:
                plan[first + 1] = (i, 0.0)
            break
        end = math.floor(time[i + 1] / 1000)
        if first != end:
            for e in range(first if aligned else first + 1, end + 1):
                plan[e] = (i, (e * 1000.0 - time[i]) / (time[i + 1] - time[i]))
    seconds = sorted(plan)
    a, u = np.array([plan[e][0] for e in seconds]), np.array([plan[e][1] for e in seconds])
    out = between(t, a, np.minimum(a + 1, n - 1), u)
    for k in out:
        out[k] = np.where(u == 0, t[k][a], out[k])
    out["time"] = np.array(seconds) * 1000.0
    return derive(out)


def along(lat_deg: np.ndarray, lon_deg: np.ndarray, step: float, least: float) -> np.ndarray:
    """(lat, lon) rows in degrees along a polyline: a new anchor after at least `least` metres, and points
    every `step` in between."""
    rows = [(float(lat_deg[0]), float(lon_deg[0]))] if len(lat_deg) else []
    at = 0
    for i in range(1, len(lat_deg)):
        gap = float(haversine(*np.radians([lat_deg[at], lon_deg[at], lat_deg[i], lon_deg[i]])))
        if gap < least and i < len(lat_deg) - 1:
            continue
        pieces = max(1, math.ceil(gap / step))
        rows += [(lat_deg[at] + (lat_deg[i] - lat_deg[at]) * j / pieces, lon_deg[at] + (lon_deg[i] - lon_deg[at]) * j / pieces) for j in range(1, pieces + 1)]
        at = i
    return np.array(rows, dtype=float).reshape(-1, 2)


def value_at(s: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """v at distances x: on the piece whose start is the last point strictly before x."""
    if len(s) < 2:
        return np.full(len(x), v[0] if len(v) else np.nan)
    i = np.clip(np.searchsorted(s, x, side="left") - 1, 0, len(s) - 2)
    gap = s[i + 1] - s[i]
    u = np.where(gap > 0, (x - s[i]) / np.where(gap > 0, gap, 1), 0.0)
    return v[i] + np.clip(u, 0, 1) * (v[i + 1] - v[i])


def farthest_points(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps of a polyline's rows; a point must be farther than the tolerance."""
    n = len(p)
    keep = np.zeros(n, dtype=bool)
    if n:
        keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        ab, q = p[b] - p[a], p[a + 1 : b] - p[a]
        length2 = float(ab @ ab)
        u = np.clip(q @ ab / length2, 0, 1) if length2 > 0 else np.zeros(len(q))
        far = np.sqrt(((q - u[:, None] * ab) ** 2).sum(axis=1))
        k = int(far.argmax())
        if far[k] > tolerance:
            m = a + 1 + k
            keep[m] = True
            stack += [(a, m), (m, b)]
    return np.flatnonzero(keep)


def ecef(lat: np.ndarray, lon: np.ndarray, ele: np.ndarray, z: float) -> np.ndarray:
    h = np.where(np.isnan(ele), 0, ele) * z
    n = 6_378_137.0 / np.sqrt(1 - 0.00669437999014 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - 0.00669437999014) + h) * np.sin(lat)], axis=1)


def simplify(t: Track, tolerance: float, z: float = 3.0) -> tuple[Track, np.ndarray]:
    rows = farthest_points(ecef(t["latitude"], t["longitude"], t["elevation"], z), tolerance)
    return derive(take(t, rows)), rows


# --- smoothing and curvature -------------------------------------------------------------------


def smooth_profile(s: np.ndarray, e: np.ndarray, half: float) -> np.ndarray:
    """The piecewise-linear profile under a triangular kernel of that half-width, integrated exactly and
    divided by the kernel's mass on the path."""
    n = len(s)
    if n < 3 or half <= 0:
        return e.copy()
    level = float(np.mean(e))
    s0 = s - s[0]
    e0 = e - level
    h = np.diff(s0)
    slope = np.where(h > 0, np.diff(e0) / np.where(h > 0, h, 1), 0.0)
    first = np.concatenate([[0], np.cumsum(h * (e0[:-1] + e0[1:]) / 2)])
    second = np.concatenate([[0], np.cumsum(s0[:-1] * e0[:-1] * h + (e0[:-1] + s0[:-1] * slope) * h**2 / 2 + slope * h**3 / 3)])

    def integrals(x):
        i = np.clip(np.searchsorted(s0, x, side="right") - 1, 0, n - 2)
        u = x - s0[i]
        return first[i] + e0[i] * u + slope[i] * u**2 / 2, second[i] + s0[i] * e0[i] * u + (e0[i] + s0[i] * slope[i]) * u**2 / 2 + slope[i] * u**3 / 3

    lo, hi = np.maximum(s0 - half, 0), np.minimum(s0 + half, s0[-1])
    (a1, a2), (c1, c2), (b1, b2) = integrals(lo), integrals(s0), integrals(hi)
    total = (1 - s0 / half) * (c1 - a1) + (c2 - a2) / half + (1 + s0 / half) * (b1 - c1) - (b2 - c2) / half
    l, r = s0 - lo, hi - s0
    mass = l - l**2 / (2 * half) + r - r**2 / (2 * half)
    return np.where(mass > 0, total / np.where(mass > 0, mass, 1) + level, e)


def smooth_elevation(t: Track, half: float = 150.0) -> Track:
    t = copy(t)
    smoothed = smooth_profile(t["distance"], t["elevation"], half)
    t["sourceElevation"] = np.where(np.isnan(t["sourceElevation"]), t["elevation"], t["sourceElevation"])
    t["elevation"] = smoothed
    return derive(t)


def _windows(s: np.ndarray, half: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.searchsorted(s, s - half, side="left"), np.searchsorted(s, s + half, side="right") - 1
    i = np.arange(len(s))
    # Rounding of s - half must not decide; the test is on the difference.
    lo = np.where((lo > 0) & (s - s[np.maximum(lo - 1, 0)] <= half), lo - 1, lo)
    hi = np.where((hi < len(s) - 1) & (s[np.minimum(hi + 1, len(s) - 1)] - s <= half), hi + 1, hi)
    return (np.minimum(lo, i), np.maximum(hi, i)) if most is None else (np.clip(lo, i - most, i), np.clip(hi, i, i + most))


def _gather(lo: np.ndarray, hi: np.ndarray):
    """Yields (rows, index matrix, mask) so that every row's window is one line of a bounded matrix."""
    n, at = len(lo), 0
    while at < n:
        width = int((hi[at:] - lo[at:]).max()) + 1
        rows = np.arange(at, min(n, at + max(1, 2_000_000 // width)))
        index = lo[rows, None] + np.arange(width)
        yield rows, np.minimum(index, n - 1), index <= hi[rows, None]
        at = rows[-1] + 1


def smooth_samples(v: np.ndarray, s: np.ndarray, half: float) -> np.ndarray:
    """Weighted mean of the samples within half, weights falling to 0; NaN is skipped and stays."""
    if half <= 0 or len(v) < 3:
        return v.copy()
    out = v.copy()
    for rows, index, mask in _gather(*_windows(s, half)):
        w = np.where(mask & ~np.isnan(v[index]), np.maximum(0, 1 - np.abs(s[index] - s[rows, None]) / half), 0)
        total = w.sum(axis=1)
        value = (w * np.where(np.isnan(v[index]), 0, v[index])).sum(axis=1)
        ok = (total > 0) & ~np.isnan(v[rows])
        out[rows[ok]] = value[ok] / total[ok]
    return out


class Frame:
    """A track in a plane: x east, y north, arc length, heading (left positive) and curvature."""

    def __init__(self, t: Track, smooth_m: float):
        lat, lon, s = t["latitude"], t["longitude"], t["distance"]
        self.lat0, self.lon0 = (lat.min() + lat.max()) / 2, (lon.min() + lon.max()) / 2
        if lon.max() - lon.min() > math.pi:
            self.lon0 = lon[0]
        self.k = math.cos(self.lat0)
        self.x = smooth_samples(EARTH_RADIUS * self.k * unwrap(lon - self.lon0), s, smooth_m)
        self.y = smooth_samples(EARTH_RADIUS * (lat - self.lat0), s, smooth_m)
        self.s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(self.x), np.diff(self.y)))])
        self.theta = self.headings()
        self.kappa = np.zeros(len(s))

    def headings(self) -> np.ndarray:
        n = len(self.x)
        a, b = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
        dx, dy = self.x[b] - self.x[a], self.y[b] - self.y[a]
        known = np.flatnonzero((dx != 0) | (dy != 0))
        if not len(known):
            return np.zeros(n)
        raw = np.arctan2(dy[known], dx[known])
        heading = np.concatenate([[raw[0]], raw[0] + np.cumsum(unwrap(np.diff(raw)))])
        at = np.searchsorted(known, np.arange(n), side="right") - 1
        return heading[np.maximum(at, 0)]

    def geographic(self, x, y):
        return self.lat0 + y / EARTH_RADIUS, unwrap(self.lon0 + x / (EARTH_RADIUS * self.k))


def planar(t: Track, smooth_m: float, least: int = 8) -> Frame | None:
    if size(t) < least or not all(np.isfinite(t[c]).all() for c in ("latitude", "longitude", "distance")):
        return None
    if abs(t["latitude"].min() + t["latitude"].max()) / 2 > math.radians(85):
        return None
    return Frame(t, smooth_m)


def fit_slopes(f: Frame, half: float, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Slope of heading over arc length around each point, and the spread of what is left; NaN where
    there are too few points or no extent."""
    n = len(f.s)
    slope, sigma = np.full(n, np.nan), np.full(n, np.nan)
    for rows, index, mask in _gather(*_windows(f.s, half, most)):
        ds, dt = np.where(mask, f.s[index] - f.s[rows, None], 0), np.where(mask, f.theta[index] - f.theta[rows, None], 0)
        m = mask.sum(axis=1).astype(float)
        s1, s2, t1, st = ds.sum(axis=1), (ds * ds).sum(axis=1), dt.sum(axis=1), (ds * dt).sum(axis=1)
        den = m * s2 - s1 * s1
        ok = (m >= 3) & (den >= 1e-6 * m * half * half)
        with np.errstate(divide="ignore", invalid="ignore"):
            b = (m * st - s1 * t1) / den
            c = (t1 - b * s1) / m
            rest = np.where(mask, dt - c[:, None] - b[:, None] * ds, 0)
            r = np.sqrt((rest * rest).sum(axis=1) / np.maximum(m - 2, 1))
        ok &= np.isfinite(b) & np.isfinite(r)
        slope[rows[ok]], sigma[rows[ok]] = b[ok], r[ok]
    return slope, sigma


def measure_curvature(f: Frame, o: CurvatureOptions) -> np.ndarray:
    fits = [fit_slopes(f, w) for w in o.windows_m]
    spread = np.sort(fits[-1][1][~np.isnan(fits[-1][1])])
    limit = 2 * max(o.heading_noise_rad, float(spread[len(spread) // 2]) if len(spread) else 0.0)
    raw, widest = np.full(len(f.s), np.nan), np.full(len(f.s), np.nan)
    for slope, sigma in reversed(fits):
        have = ~np.isnan(sigma)
        widest = np.where(np.isnan(widest) & have, slope, widest)
        raw = np.where(np.isnan(raw) & have & (sigma <= limit), slope, raw)
    f.kappa = smooth_samples(np.where(np.isnan(raw), widest, raw), f.s, o.curvature_smooth_m)
    return f.kappa


def curvature(t: Track, o: CurvatureOptions = CurvatureOptions()) -> Track:
    t = copy(t)
    f = planar(t, o.geometry_smooth_m) if o.enabled else None
    if f is not None:
        t["trajectoryCurvature"] = measure_curvature(f, o).copy()
    return t


# --- speeds and simulation ---------------------------------------------------------------------


def radii(t: Track, k: int = 10) -> np.ndarray:
    n, i = size(t), np.arange(size(t))
    lo, hi = np.maximum(0, i - k), np.minimum(n - 1, i + k)
    turn = np.concatenate([[0.0], np.cumsum(wrap_change(np.diff(t["bearing"])))])
    change, way = np.abs(turn[hi] - turn[lo]), t["distance"][hi] - t["distance"][lo]
    with np.errstate(divide="ignore", invalid="ignore"):
        window = np.where(change < 0.001, 200.0, np.clip(way / change, 5, 200))
        measured = np.clip(1 / np.maximum(np.abs(t["trajectoryCurvature"]), 1 / 200), 5, 200)
    return np.where(np.isnan(t["trajectoryCurvature"]), window, measured)


def max_speeds(t: Track, c: Cyclist = Cyclist()) -> Track:
    """Cornering limits, then what braking before them allows, from the end backwards."""
    t = copy(t)
    n = size(t)
    if n == 0:
        return t
    r = radii(t)
    corner = np.where(r >= 200, c.max_speed, np.minimum(c.max_speed, np.sqrt(G * r * c.tan_lean)))
    t["radius"][: n - 1], t["speedMaxIncline"][: n - 1] = r[: n - 1], corner[: n - 1]
    t["speedMax"] = braking_limits(t["distance"], corner, r, c)
    return derive(t)


def braking_limits(distance: np.ndarray, corner: np.ndarray, radius: np.ndarray, c: Cyclist) -> np.ndarray:
    """The speed at each point that lets a rider brake to all later limits; 2 m/s at the end."""
    limit = [2.0] * len(distance)
    rows = list(zip(corner.tolist(), np.diff(distance).tolist(), radius.tolist(), strict=False))
    for i in range(len(rows) - 1, -1, -1):
        limit[i] = braking(rows[i][0], limit[i + 1], rows[i][1], rows[i][2], c)
    return np.array(limit)


def braking(corner: float, after: float, way: float, radius: float, c: Cyclist) -> float:
    """The speed from which the next point's speed can be reached, sharing grip between turning and braking."""
    a = c.max_brake_g * G
    if radius >= 200 or not math.isfinite(radius) or radius <= 0:
        return min(corner, math.sqrt(after * after + 2 * a * way))
    hold = G * c.tan_lean

    def slack(v: float) -> float:
        used = min(1.0, max(0.0, v * v / radius / hold))
        return after * after + 2 * a * math.sqrt(1 - used * used) * way - v * v

    if slack(corner) >= 0:
        return corner
    low, high = min(after, corner), corner
    for _ in range(24):
        mid = (low + high) / 2
        low, high = (mid, high) if slack(mid) >= 0 else (low, mid)
    return low


def step_length(p: float, m: float, v: float, dt: float) -> float:
    return (v + max(math.sqrt(max(0.0, v * v + 2 * dt * p / m)), MIN_SPEED)) * dt / 2


def step_time(p: float, m: float, v: float, dx: float) -> float:
    """The first time at which a constant power has carried dx: bracketed by tenths of a second, then halved.
    The halvings take most of a ride's time, so step_length is written out in them."""
    dt = 0.1
    while step_length(p, m, v, dt) <= dx:
        dt += 0.1
    low, high, tol = dt - 0.1, dt, max(dx / 1e7, 1e-12)
    sqrt, vv = math.sqrt, v * v
    while high - low >= tol:
        mid = (low + high) / 2
        after = vv + 2 * mid * p / m
        after = sqrt(after) if after > 0 else 0.0
        if (v + (after if after > MIN_SPEED else MIN_SPEED)) * mid / 2 < dx:
            if mid == low:
                break
            low = mid
        else:
            if mid == high:
                break
            high = mid
    return (low + high) / 2


def w_prime_step(balance: float, power: float, cp: float, full: float, dt: float) -> float:
    b = balance - (power - cp) * dt if power >= cp else full - (full - balance) * math.exp(-(cp - power) * dt / full)
    return min(full, max(0.0, b))


def w_prime(time_ms: np.ndarray, power: np.ndarray, cp: float, full: float) -> np.ndarray:
    out, b = np.empty(len(power)), full
    for i in range(len(power)):
        if i:
            dt = (time_ms[i] - time_ms[i - 1]) / 1000
            if math.isfinite(dt) and dt > 0 and math.isfinite(power[i]):
                b = w_prime_step(b, float(power[i]), cp, full, float(dt))
        out[i] = b
    return out


class Rider:
    """The power model's state: base model, then pacing, then the slew limit. `ask` gives the intended
    power at a point, `told` hears what reached the cranks."""

    def __init__(self, spec: PowerSpec, c: Cyclist):
        self.spec, self.c = spec, c
        self.elapsed = self.last = 0.0
        self.reserve, self.work = c.w_prime_j, 0.0
        self.distance = self.debt = self.paced = self.target = 0.0
        self.multiplier = 1.0
        self.slewed = 0.0

    def ask(self, elapsed: float, distance: float, given: float, grade: float, headwind: float, time_ms: float) -> tuple[float, float, float]:
        """(base power, base with harmonics, power after the wrappers)."""
        c, spec = self.c, self.spec
        dt = elapsed - self.elapsed
        moved = dt > 0 and math.isfinite(dt)
        base = c.power_w
        if spec.model == "from_data":
            base = given
        elif spec.model == "critical_power":
            if moved:
                self.reserve = w_prime_step(self.reserve, self.last, c.critical_power_w, c.w_prime_j, dt)
            if base > c.critical_power_w:
                base = c.critical_power_w + (base - c.critical_power_w) * min(1.0, max(0.0, self.reserve / c.w_prime_j / 0.5))
        elif spec.model == "durability":
            if moved:
                self.work += max(0.0, self.last - c.critical_power_w) * dt
            base *= 1 - min(0.20, 0.10 / 15.0 * self.work / 1000 / c.mass_kg)
        self.last = base
        power = base
        for freq, phase, amp in spec.harmonics:
            power += amp * power * math.cos(freq * time_ms / 10_000 - phase)
        shaken = power
        if spec.pacing:
            want = min(1.3, max(0.5, 1 + 3.0 * grade + 0.02 * headwind))
            dx = distance - self.distance
            if want <= self.multiplier:
                self.multiplier = want
            elif math.isfinite(dx) and dx > 0:
                self.multiplier += (want - self.multiplier) * (1 - math.exp(-dx / 300))
            if moved:
                self.debt += (self.paced - self.target) * dt
            correct = 1.0 if power <= 0 else min(1.3, max(0.5, 1 - self.debt / (power * 600)))
            self.target = power
            power = self.paced = power * min(1.3, max(0.5, self.multiplier * correct))
            self.hear(power)
        if spec.slew_w_per_s:
            if moved:
                budget = spec.slew_w_per_s * dt
                power = power if abs(power - self.slewed) <= budget else self.slewed + math.copysign(budget, power - self.slewed)
            else:
                power = self.slewed
            self.slewed = power
            self.hear(power)
        self.distance = distance if math.isfinite(distance) else self.distance
        self.elapsed = elapsed if math.isfinite(elapsed) else self.elapsed
        return base, shaken, power

    def hear(self, power: float) -> None:
        if self.spec.model == "critical_power" and math.isfinite(power):
            self.last = power

    def told(self, power: float) -> None:
        if self.spec.slew_w_per_s and math.isfinite(power):
            self.slewed = power
        self.hear(power)


def air_density(ele: float, temp: float) -> float:
    h, c = (0.0 if math.isnan(ele) else ele), (15.0 if math.isnan(temp) else temp)
    return 101_325.0 * (1 - 0.0065 * h / 288.15) ** (G / (287.05 * 0.0065)) / (287.05 * (c + 273.15))


def virtualize(t: Track, c: Cyclist = Cyclist(), bike: Bike = Bike(), wind: Wind = Wind(), spec: PowerSpec = PowerSpec(), rho: str = "default") -> Track:
    """Rides the track from its start: forces at one point give the time to the next, held to its speed limit."""
    t = copy(t)
    n = size(t)
    if n == 0:
        return t
    mass = c.mass_kg + (bike.front_inertia + bike.rear_inertia) / bike.wheel_radius_m**2
    rider = Rider(spec, c)
    d, grade, bearing, limit = (t[k].tolist() for k in ("distance", "grade", "bearing", "speedMax"))
    radius, given, ele, temp = (t[k].tolist() for k in ("radius", "pInputPower", "elevation", "temperature"))
    names = ("pAero", "pGravity", "pRollingResistance", "pWheelBearings", "pCyclistProvidedOptimalPower", "pCyclistProvidedOptimalPowerWithHarmonics", "pCyclistPowerNeeded", "pCyclistProvidedMuscular", "pCyclistProvidedWheel", "aeroCoef")
    out = {k: t[k].tolist() for k in names}
    time, elapsed, dx_, dt_, speed = ([0.0] * n for _ in range(5))
    speed[0] = MIN_SPEED
    blowing = wind.speed != 0
    tan_pedal = math.inf if bike.max_pedal_lean_deg is None else math.tan(math.radians(bike.max_pedal_lean_deg))
    toward = math.pi / 2 - wind.direction_rad

    def resist(i: int) -> float:
        v, g = speed[i], math.atan(grade[i])
        k = out["aeroCoef"][i] = c.drag_coefficient * c.frontal_area_m2 * (1.225 if rho == "default" else air_density(ele[i], temp[i])) / 2
        out["pWheelBearings"][i] = -v * (91 + 8.7 * v) / 1000
        out["pRollingResistance"][i] = -math.cos(g) * c.mass_kg * G * v * bike.crr
        if blowing:
            alpha = toward - bearing[i]
            l1 = v + wind.speed * math.cos(alpha)
            l3 = v * v + wind.speed**2 + 2 * v * wind.speed * math.cos(alpha)
            share = l1 * l1 / l3 if l3 else 0.0
            out["pAero"][i] = -k * (share + 1.2 * (1 - share)) * math.sqrt(max(l3, 0)) * l1 * v
        else:
            out["pAero"][i] = -k * v * v * v
        out["pGravity"][i] = -c.mass_kg * G * v * math.sin(g)
        return out["pWheelBearings"][i] + out["pRollingResistance"][i] + out["pAero"][i] + out["pGravity"][i]

    v = MIN_SPEED
    for i in range(1, n):
        dx = d[i] - d[i - 1]
        if dx <= 0:
            time[i], elapsed[i], speed[i] = time[i - 1], elapsed[i - 1], v
            continue
        j = i - 1
        drag = resist(j)
        base, shaken, power = rider.ask(elapsed[j], d[j], given[j], grade[j], wind.speed * math.cos(toward - bearing[j]) if blowing else 0.0, time[j])
        clear = not (math.isfinite(radius[j]) and radius[j] > 0) or speed[j] ** 2 / (G * radius[j]) <= tan_pedal
        muscular = power if clear else 0.0
        rider.told(muscular)
        out["pCyclistProvidedOptimalPower"][j], out["pCyclistProvidedOptimalPowerWithHarmonics"][j] = base, shaken
        out["pCyclistPowerNeeded"][j], out["pCyclistProvidedMuscular"][j], out["pCyclistProvidedWheel"][j] = -drag, muscular, muscular * bike.efficiency
        dt = step_time(drag + muscular * bike.efficiency, mass, v, dx)
        v2 = 2 * dx / dt - v
        if v2 > limit[i]:
            v2 = limit[i]
            dt = 2 * dx / (v2 + v)
        time[i], elapsed[i], dx_[i], dt_[i], speed[i] = time[i - 1] + 1000 * dt, elapsed[i - 1] + dt, dx, dt, v2
        v = v2
    total, wheel, brake, computed = (np.zeros(n) for _ in range(4))
    for i in range(1, n):
        if dt_[i] <= 0:
            continue
        drag = resist(i - 1)
        total[i] = 0.5 * mass * (speed[i] ** 2 - speed[i - 1] ** 2) / dt_[i]
        wheel[i] = total[i] - drag
        brake[i], computed[i] = min(0.0, wheel[i]), max(0.0, wheel[i]) / bike.efficiency
    t.update({k: np.array(x) for k, x in out.items()})
    t.update(time=np.array(time), elapsed=np.array(elapsed), dx=np.array(dx_), dt=np.array(dt_), speed=np.array(speed), virtSpeedCurrent=np.array(speed), pComputedTotalPower=total, pComputedWheelPower=wheel, pBrake=brake, pComputedPower=computed)
    if blowing:
        t.update(windSpeed=np.full(n, wind.speed), windDirection=np.full(n, wind.direction_rad), windBearing=np.full(n, toward), windAlpha=toward - t["bearing"])
    return derive(t)


# --- ascent and climbs -------------------------------------------------------------------------


def legs(h: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The counted legs (first and last index) of a height profile between turns of at least the threshold."""
    out: list[tuple[int, int]] = []
    if len(h) < 2:
        return out
    way, hi, lo = 0, 0, 0
    start = end = 0
    for i in range(1, len(h)):
        e = h[i]
        if way == 0:
            if e > h[hi]:
                hi = i
            if e < h[lo]:
                lo = i
            if h[hi] - h[lo] >= threshold:
                if hi > lo:
                    if h[lo] < h[0]:
                        out.append((0, lo))
                    way, start, end = 1, lo, hi
                else:
                    if h[hi] > h[0]:
                        out.append((0, hi))
                    way, start, end = -1, hi, lo
        elif (e - h[end]) * way > 0:
            end = i
        elif (h[end] - e) * way >= threshold:
            out.append((start, end))
            way, start, end = -way, end, i
    if way and (h[end] - h[start]) * way > 0:
        out.append((start, end))
    return out


def gain(s: np.ndarray, ele: np.ndarray, source: np.ndarray, o: GainOptions) -> dict:
    """Ascent and descent of the turns that count, of the profile as first measured, smoothed at its own scale."""
    h = np.where(np.isnan(source), ele, source)
    if len(h) < 2:
        return {"gain": 0.0, "loss": 0.0, "raw_gain": 0.0, "raw_loss": 0.0, "legs": 0}
    step = np.diff(h)
    raw = {"raw_gain": float(step[step > 0].sum()), "raw_loss": float(step[step <= 0].sum())}
    h = smooth_profile(s, h, o.window_m)
    if o.threshold_m <= 0:
        step = np.diff(h)
        return {"gain": float(step[step > 0].sum()), "loss": float(step[step <= 0].sum()), "legs": 0, **raw}
    found = legs(h, o.threshold_m)
    change = [float(h[b] - h[a]) for a, b in found]
    return {"gain": sum(x for x in change if x > 0), "loss": sum(x for x in change if x < 0), "legs": len(found), **raw}


def cumulative_gain(h: np.ndarray, threshold: float) -> np.ndarray:
    """Ascent counted up to each point: within a counted climb it follows the highest point so far."""
    out, before, at = np.zeros(len(h)), 0.0, 0
    for a, b in legs(h, threshold):
        if h[b] <= h[a]:
            continue
        out[at : a + 1] = before
        out[a : b + 1] = before + np.clip(np.maximum.accumulate(h[a : b + 1]) - h[a], 0, h[b] - h[a])
        before += h[b] - h[a]
        at = b + 1
    out[at:] = before
    return out


def ascent(e: np.ndarray) -> float:
    step = np.diff(e)
    return float(step[step > 0].sum())


def best_climbs(d: np.ndarray, e: np.ndarray, o: ClimbOptions, whole: float | None = None) -> tuple[list[tuple[float, int, int]], np.ndarray, np.ndarray]:
    """The best climb from every start that has one (score, first, last), and the ascent and the way climbed so far.
    whole: the path's ascent, where these are not all of its points."""
    step, way = np.diff(e), np.diff(d)
    up = np.where(step > 0, step, 0.0)
    need = max(o.least_elevation_m, min(o.most_least_elevation_m, (float(up.sum()) if whole is None else whole) / o.elevation_ratio))
    ups, climbing = np.concatenate([[0], np.cumsum(up)]), np.concatenate([[0], np.cumsum(np.where(step > 0, way, 0.0))])
    best: list[tuple[float, int, int]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(len(d) - 1):
            length, net = d[i + 1 :] - d[i], e[i + 1 :] - e[i]
            grade = 100 * net / length
            steep = 100 * (ups[i + 1 :] - ups[i]) / (climbing[i + 1 :] - climbing[i])
            ok = (length > 10) & (grade >= o.min_grade_percent) & (net >= need) & (steep / grade <= o.max_grade_ratio)
            if ok.any():
                score = np.where(ok, length * np.power(np.where(ok, grade, 1), o.booster), -1.0)
                j = len(score) - 1 - int(score[::-1].argmax())
                best.append((float(score[j]), i, i + 1 + j))
    return best, ups, climbing


def climbs(s: np.ndarray, ele: np.ndarray, o: ClimbOptions = ClimbOptions()) -> list[dict]:
    """The best climb from every start, the best of those that do not overlap, and the parts of each."""
    n = len(s)
    # The gaps are shared out, so that the last point, which always stays, is within the bound.
    stride = max(1, math.ceil((n - 1) / (o.max_points - 1)))
    rows = np.unique(np.append(np.arange(0, n, stride), n - 1)) if n else np.zeros(0, dtype=int)
    d, e = s[rows], ele[rows]
    if len(d) < 2:
        return []
    best, ups, climbing = best_climbs(d, e, o, ascent(ele))
    taken: list[tuple[float, int, int]] = []
    for c in sorted(best, key=lambda x: -x[0]):
        if all(c[2] < k[1] or c[1] > k[2] for k in taken):
            taken.append(c)
    out = []
    for score, a, b in sorted(taken, key=lambda x: x[1]):
        net = float(e[b] - e[a])
        cut = farthest_points(np.stack([d[a : b + 1], e[a : b + 1]], axis=1), min(50.0, max(10.0, net / 50))) + a
        parts = [{"start": float(d[p]), "end": float(d[q]), "elevation": float(e[q] - e[p]), "grade": float((e[q] - e[p]) / (d[q] - d[p])) if d[q] > d[p] else 0.0} for p, q in zip(cut[:-1], cut[1:], strict=True)]
        positive = float(ups[b] - ups[a])
        out.append({"first": int(rows[a]), "last": int(rows[b]), "start": float(d[a]), "end": float(d[b]), "length": float(d[b] - d[a]), "elevation": net, "positive": positive, "negative": net - positive, "grade": net / float(d[b] - d[a]), "climbing_grade": positive / float(climbing[b] - climbing[a]), "score": score, "parts": parts})
    return out
