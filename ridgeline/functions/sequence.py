"""Whole-track algorithms on roads: corners, corridor, racing line, tunnels, segment order."""

from __future__ import annotations

import math

import numpy as np

from ridgeline.functions import kernels as k
from ridgeline.options import RacingLineOptions, TunnelOptions

# --- corners -----------------------------------------------------------------------------------


def corners(f: k.Frame, width: np.ndarray, o: RacingLineOptions) -> list[dict]:
    """Spans of one turn each: opened above one curvature, closed below another or when the turn changes side."""
    enter, leave = 1 / o.enter_radius_m, 1 / o.exit_radius_m
    spans: list[list[int]] = []
    first, side = -1, 0
    for i, kappa in enumerate(f.kappa.tolist()):
        sign = (kappa > 0) - (kappa < 0)
        if side and (abs(kappa) < leave or sign != side or math.isnan(kappa)):
            spans.append([first, i - 1, side])
            side = 0
        if not side and sign and abs(kappa) > enter:
            first, side = i, sign
    if side:
        spans.append([first, len(f.kappa) - 1, side])
    merged: list[list[int]] = []
    for s in spans:
        if merged and merged[-1][2] == s[2] and f.s[s[0]] - f.s[merged[-1][1]] < max(15.0, 3 * float(width[s[0]])):
            merged[-1][1] = s[1]
        else:
            merged.append(list(s))
    out = []
    for a, b, sign in merged:
        turn, length = float(f.theta[b] - f.theta[a]), float(f.s[b] - f.s[a])
        if length < o.min_length_m or abs(turn) < math.radians(o.min_turn_deg):
            continue
        radius = np.sort(1 / np.maximum(np.abs(f.kappa[a : b + 1]), 1e-12))
        low = float(radius[int((len(radius) - 1) * 0.2)])
        kind = "HAIRPIN" if abs(turn) >= math.radians(o.hairpin_deg) else "GENTLE" if low >= o.gentle_radius_m else "CORNER"
        out.append({"first": a, "last": b, "start": float(f.s[a]), "end": float(f.s[b]), "length": length, "turn_deg": math.degrees(turn), "side": sign, "radius": low, "kind": kind})
    return out


def road_width(t: k.Track, s: np.ndarray, o: RacingLineOptions) -> np.ndarray:
    return k.smooth_samples(np.where(np.isnan(t["roadWidth"]), o.default_width_m, t["roadWidth"]), s, o.width_smooth_m)


def nearest_elsewhere(f: k.Frame, gap: float, reach: float = 12.0) -> np.ndarray:
    """Distance of each point to the nearest point of another stretch (more than `gap` along), up to `reach`."""
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(f.x / reach).astype(int), np.floor(f.y / reach).astype(int)
    for i, c in enumerate(zip(cx.tolist(), cy.tolist(), strict=True)):
        cells.setdefault(c, []).append(i)
    held = {c: np.array(v) for c, v in cells.items()}
    out = np.full(len(f.x), np.inf)
    for (a, b), rows in held.items():
        near = np.concatenate([held[n] for n in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if n in held])
        for part in np.array_split(rows, max(1, len(rows) * len(near) // 1_000_000)):
            dist = np.hypot(f.x[part, None] - f.x[near], f.y[part, None] - f.y[near])
            dist[np.abs(f.s[part, None] - f.s[near]) <= gap] = np.inf
            out[part] = dist.min(axis=1)
    return out


def corridor(f: k.Frame, width: np.ndarray, o: RacingLineOptions) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest offset (left positive) of each point."""
    half = np.clip(width / 2 - o.edge_margin_m, 0, 6)
    lo, hi = (-half, np.zeros(len(half))) if o.corridor == "lane" else (np.zeros(len(half)), half.copy()) if o.corridor == "lane-left" else (-half, half.copy())
    bend = o.regularity / np.maximum(np.abs(f.kappa), 1e-12)
    lo, hi = np.maximum(lo, -bend), np.minimum(hi, bend)
    clear = np.maximum(0, nearest_elsewhere(f, o.proximity_gap_m) / 2 - o.edge_margin_m)
    lo, hi = np.maximum(lo, -clear), np.minimum(hi, clear)
    # Ends, and the middles of long straights, stay on the source line.
    pins = {0, len(half) - 1}
    straight = np.abs(f.kappa) < 1 / o.straight_radius_m
    edges = np.flatnonzero(np.diff(np.concatenate([[0], straight.astype(int), [0]])))
    for a, b in zip(edges[::2], edges[1::2] - 1, strict=True):
        if f.s[b] - f.s[a] >= o.straight_run_m:
            pins.add(int(np.searchsorted(f.s, (f.s[a] + f.s[b]) / 2)))
    for p in pins:
        mid = min(max(0.0, lo[p]), hi[p]) if lo[p] <= hi[p] else (lo[p] + hi[p]) / 2
        lo[p] = hi[p] = mid
    crossed = lo > hi
    mid = (lo + hi) / 2
    return np.where(crossed, mid, lo), np.where(crossed, mid, hi)


# --- racing line -------------------------------------------------------------------------------


def energy(f: k.Frame, o: RacingLineOptions) -> tuple[np.ndarray, np.ndarray]:
    """Banded matrix (rows: diagonal, first and second above) and linear term of the line's energy: squared
    curvature of the offset line in bends, change of offset, and distance from the middle."""
    n = len(f.s)
    h = np.maximum(np.diff(f.s), 1e-6)
    band, g = np.zeros((3, n)), np.zeros(n)
    rough, centre = 1 / o.steering_length_m**2, 1 / o.centering_length_m**4
    span = np.concatenate([[h[0] / 2], (h[:-1] + h[1:]) / 2, [h[-1] / 2]])
    band[0] += centre * span
    stiff = rough / h
    band[0, :-1] += stiff
    band[0, 1:] += stiff
    band[1, :-1] -= stiff
    # Second difference d = p n[i-1] - q n[i] + r n[i+1]; curvature of the offset line is kappa + kappa^2 n + d.
    a, b = h[:-1], h[1:]
    p, r = 2 / (a * (a + b)), 2 / (b * (a + b))
    q = p + r
    kap = f.kappa[1:-1]
    w = span[1:-1] * np.where(np.abs(kap) > 1 / o.objective_radius_m, 1.0, 0.05)
    c = kap * kap - q
    band[0, :-2] += w * p * p
    band[0, 1:-1] += w * c * c
    band[0, 2:] += w * r * r
    band[1, :-2] += w * p * c
    band[1, 1:-1] += w * c * r
    band[2, :-2] += w * p * r
    g[:-2] += w * kap * p
    g[1:-1] += w * kap * c
    g[2:] += w * kap * r
    return band, g


def apply(band: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = band[0] * x
    y[:-1] += band[1, :-1] * x[1:]
    y[1:] += band[1, :-1] * x[:-1]
    y[:-2] += band[2, :-2] * x[2:]
    y[2:] += band[2, :-2] * x[:-2]
    return y


def banded_solve(band: np.ndarray, rhs: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Solves for the free unknowns by factoring the pentadiagonal matrix; held ones stay 0."""
    n = len(rhs)
    d0, d1, d2 = band[0].tolist(), band[1].tolist(), band[2].tolist()
    on = free.tolist()
    d, l1, l2, x = [1.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    b = np.where(free, rhs, 0.0).tolist()
    for i in range(n):
        if not on[i]:
            continue
        v, z = d0[i], b[i]
        if i >= 2 and on[i - 2]:
            l2[i] = d2[i - 2] / d[i - 2]
            v -= l2[i] * l2[i] * d[i - 2]
            z -= l2[i] * x[i - 2]
        if i >= 1 and on[i - 1]:
            c = d1[i - 1]
            if i >= 2 and on[i - 2]:
                c -= l2[i] * d[i - 2] * l1[i - 1]
            l1[i] = c / d[i - 1]
            v -= l1[i] * l1[i] * d[i - 1]
            z -= l1[i] * x[i - 1]
        d[i], x[i] = max(v, 1e-300), z
    for i in range(n - 1, -1, -1):
        if not on[i]:
            continue
        v = x[i] / d[i]
        if i + 1 < n and on[i + 1]:
            v -= l1[i + 1] * x[i + 1]
        if i + 2 < n and on[i + 2]:
            v -= l2[i + 2] * x[i + 2]
        x[i] = v
    return np.array(x)


def box_minimum(band: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray, o: RacingLineOptions) -> tuple[np.ndarray, int]:
    """The least energy within the box: Newton steps on the unknowns that no bound holds, cut back until the
    energy falls."""
    x = np.clip(np.zeros(len(g)), lo, hi)
    scale = max(1e-30, float(np.abs(g).max()))
    rounds = 0
    for rounds in range(1, o.max_iterations + 1):
        grad = apply(band, x) + g
        held = ((x <= lo + o.bound_epsilon_m) & (grad > 0)) | ((x >= hi - o.bound_epsilon_m) & (grad < 0)) | (lo >= hi)
        if np.abs(np.where(held, 0, grad)).max(initial=0) <= o.tolerance * scale:
            break
        step = banded_solve(band, -grad, ~held)
        size, moved = 1.0, False
        while size > 1e-10:
            y = np.clip(x + size * step, lo, hi)
            change = y - x
            # The difference itself, not that of two totals.
            if float(change @ grad + 0.5 * change @ apply(band, change)) <= 1e-4 * float(change @ grad):
                moved = bool(np.abs(change).max(initial=0) > 0)
                x = y
                break
            size /= 2
        if not moved:
            break
    return x, rounds


def racing_line(t: k.Track, o: RacingLineOptions) -> dict | None:
    """Frame, corridor, offsets and corners of a track, or None where it is too short or not finite."""
    f = k.planar(t, o.curvature.geometry_smooth_m)
    if f is None:
        return None
    k.measure_curvature(f, o.curvature)
    width = road_width(t, f.s, o)
    lo, hi = corridor(f, width, o)
    x, rounds = box_minimum(*energy(f, o), lo, hi, o)
    px, py = f.x - x * np.sin(f.theta), f.y + x * np.cos(f.theta)
    return {"frame": f, "lo": lo, "hi": hi, "offset": x, "x": px, "y": py, "rounds": rounds, "corners": corners(f, width, o)}


def drive(t: k.Track, o: RacingLineOptions) -> k.Track:
    """The track moved onto its racing line, its source coordinates kept, curvature measured anew."""
    found = racing_line(t, o)
    if found is None:
        return k.copy(t)
    out = k.copy(t)
    out["sourceLatitude"] = np.where(np.isnan(t["sourceLatitude"]), t["latitude"], t["sourceLatitude"])
    out["sourceLongitude"] = np.where(np.isnan(t["sourceLongitude"]), t["longitude"], t["sourceLongitude"])
    out["latitude"], out["longitude"] = found["frame"].geographic(found["x"], found["y"])
    out["lateralOffset"] = found["offset"]
    return k.curvature(k.derive(out), o.curvature)


# --- runs of stations --------------------------------------------------------------------------


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each stretch of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def padded(x: np.ndarray, half: int) -> np.ndarray:
    """Windows of 2 * half + 1 around each value, ends repeated."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), 2 * half + 1) if len(x) else np.zeros((0, 2 * half + 1))


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        w = padded(x, half)
        ok = (~np.isnan(w)).any(axis=1)
        out = np.full(len(x), np.nan)
        out[ok] = np.nanmedian(w[ok], axis=1) if ok.any() else out[ok]
    return out


def centred_slope(x: np.ndarray, half: int, step: float) -> np.ndarray:
    i = np.arange(len(x))
    return (x[np.minimum(i + half, len(x) - 1)] - x[np.maximum(i - half, 0)]) / (2 * half * step)


# --- tunnels -----------------------------------------------------------------------------------


def tunnels(z: np.ndarray, lat: np.ndarray, lon: np.ndarray, o: TunnelOptions = TunnelOptions()) -> list[dict]:
    """Mountains that the terrain model puts on the road between a steep face up and a steep face down."""
    n, m, w = len(z), max(1, round(o.foot_m / o.step_m)), max(1, round(o.steep_m / o.step_m))
    if n < 2 * w + 2:
        return []
    i = np.arange(n)
    rise = lambda a, b: (z[np.clip(b, 0, n - 1)] - z[np.clip(a, 0, n - 1)]) / np.maximum(1, np.abs(b - a)) / o.step_m
    back, outer, ahead = rise(i - m, i), rise(i - 2 * m, i - m), rise(i, i + m)
    valid = (i >= 2 * m) & (i < n - 2 * m)
    into = np.where(valid & (np.abs(back) <= o.max_road_grade) & (np.abs(outer) <= o.max_road_grade) & (ahead >= o.min_portal_grade), ahead - back, -np.inf)
    after, beyond, before = rise(i, i + m), rise(i + m, i + 2 * m), rise(i - m, i)
    out_of = np.where(valid & (np.abs(after) <= o.max_road_grade) & (np.abs(beyond) <= o.max_road_grade) & (before <= -o.min_portal_grade), after - before, -np.inf)
    best = lambda s: [int(j) for j in np.flatnonzero(np.isfinite(s)) if s[j] >= s[max(0, j - m) : j + m + 1].max()]
    entries, exits = best(into), best(out_of)
    found, follow = [], 0
    for a in entries:
        if a < follow:
            continue
        pick = None
        for b in exits:
            if b <= a:
                continue
            if (b - a) * o.step_m > o.max_length_m:
                break
            span = _tunnel(a, b, z, lat, lon, entries, exits, o, w)
            if span and (pick is None or span["height"] > pick["height"] + 1e-9):
                pick = span
        if pick:
            found.append(pick)
            follow = pick["last"]
    return found


def _tunnel(a: int, b: int, z, lat, lon, entries, exits, o: TunnelOptions, w: int) -> dict | None:
    length = (b - a) * o.step_m
    straight = float(k.haversine(lat[a], lon[a], lat[b], lon[b])) / length
    part = z[a : b + 1]
    near = z[[a, b]]
    chord = float(z[b] - z[a]) / length
    line = z[a] + np.arange(b - a + 1) * o.step_m * chord
    over = part - line
    reach = max(1, int(o.face_reach_m / o.step_m))
    height = float(over.max())
    side = lambda x: (x[-1] - x[0]) / max(1, len(x) - 1) / o.step_m
    look = max(1, int(o.side_search_m / o.step_m))
    ups = max((side(z[j : j + w + 1]) for j in range(a, min(a + look, len(z) - w))), default=-math.inf)
    downs = min((side(z[j - w : j + 1]) for j in range(max(b - look, w), b + 1)), default=math.inf)
    ok = length >= o.min_length_m and straight >= o.min_straightness and abs(chord) <= o.max_chord_grade and not (np.abs(near) < 1e-6).any()
    ok = ok and over.min() >= -o.max_below_chord_m and height >= o.min_height_m and over[: reach + 1].max() >= o.min_height_m and over[-reach - 1 :].max() >= o.min_height_m
    short = min(w, b - a)
    ups = max(ups, side(z[a : a + short + 1])) if short < w else ups
    downs = min(downs, side(z[b - short : b + 1])) if short < w else downs
    ok = ok and ups >= o.min_side_grade and downs <= -o.min_side_grade
    if not ok:
        return None
    for e in exits:
        if a < e < b:
            later = [x for x in entries if e <= x < b]
            if later and float(over[e - a : later[0] - a + 1].max()) < o.min_valley_height_m:
                return None
    return {"first": a, "last": b, "start": a * o.step_m, "end": b * o.step_m, "length": length, "chord_grade": chord, "height": height, "rise": float(ups), "fall": float(downs), "straightness": straight}


def flatten(s: np.ndarray, z: np.ndarray, spans: list[dict], protect: list[tuple[float, float]] = ()) -> np.ndarray:
    """Heights inside each span, unless it touches a protected range, become the line between its ends."""
    out = z.copy()
    for t in spans:
        if any(t["start"] <= b and a <= t["end"] for a, b in protect):
            continue
        inside = (s >= t["start"]) & (s <= t["end"])
        ends = k.value_at(s, z, np.array([t["start"], t["end"]]))
        out[inside] = ends[0] + (s[inside] - t["start"]) / max(t["end"] - t["start"], 1e-9) * (ends[1] - ends[0])
    return out


def within(x: np.ndarray, ranges: list[tuple[float, float]]) -> np.ndarray:
    out = np.zeros(np.shape(x), dtype=bool)
    for a, b in ranges:
        out |= (x >= a) & (x <= b)
    return out


def through(s: np.ndarray, z: np.ndarray, ground: np.ndarray, spans: list[dict], step: float, protect: list[tuple[float, float]] = (), refresh: float = 30.0) -> np.ndarray:
    """Heights z at distances s with each tunnel on the line between the ground at its portals. Points within
    `refresh` metres outside a portal get the stations' ground, so that none keeps a trace of the slope above it.
    Protected ranges stay, and a portal in one of them keeps the height there."""
    out, free = z.copy(), ~within(s, protect)
    inside = within(s, [(t["start"], t["end"]) for t in spans])
    around = within(s, [(t["start"] - refresh, t["end"] + refresh) for t in spans]) & ~inside & free
    out[around] = np.interp(s[around] / step, np.arange(len(ground)), ground)
    for t in spans:
        portals = np.array([t["start"], t["end"]])
        a, b = np.where(within(portals, protect), k.value_at(s, z, portals), ground[[t["first"], t["last"]]])
        here = free & (s >= portals[0]) & (s <= portals[1])
        out[here] = a + (b - a) * (s[here] - portals[0]) / (portals[1] - portals[0])
    return out


def sound_tunnels(spans: list[dict], measured: np.ndarray, step: float, protect: list[tuple[float, float]] = (), margin: float = 100.0) -> list[dict]:
    """Without tunnels around a whole protected range (a bridge's pylons look like a mountain), and without
    those that have a station near them whose ground was not measured."""
    m = int(margin / step)
    around = lambda t: measured[max(0, t["first"] - m) : t["last"] + m + 1]
    return [t for t in spans if around(t).all() and not any(t["start"] < a and b < t["end"] for a, b in protect)]


# --- order of segments -------------------------------------------------------------------------


#: The most pieces whose order can be planned: sets double with each piece.
MOST_PIECES = 20


def order_gap(ends: np.ndarray, order: list[tuple[int, bool]]) -> float:
    """Metres between the pieces in that order (piece, reversed). ends: lat/lon of first and last points."""
    total = 0.0
    for (p, pr), (q, qr) in zip(order[:-1], order[1:], strict=True):
        a, b = ends[p, 0 if pr else 1], ends[q, 1 if qr else 0]
        total += float(k.haversine(a[0], a[1], b[0], b[1]))
    return total


def best_order(ends: np.ndarray, least_gain: float = 200.0, most: int = 16) -> list[tuple[int, bool]]:
    """The order and directions of a track's pieces with the shortest gaps, the first piece forward wherever it
    comes; the file's order where there are more than `most` pieces (20 can be planned) or no more than
    `least_gain` metres are saved."""
    if not 1 <= most <= MOST_PIECES:
        raise ValueError(f"most must be from 1 to {MOST_PIECES}")
    n = len(ends)
    file = [(i, False) for i in range(n)]
    if not 2 <= n <= most:
        return file
    into, out_of = ends.reshape(-1, 2), ends[:, ::-1].reshape(-1, 2)
    gap = k.haversine(out_of[:, None, 0], out_of[:, None, 1], into[None, :, 0], into[None, :, 1])
    chosen = shortest_chain(gap)
    if not chosen or order_gap(ends, file) - order_gap(ends, chosen) <= least_gain:
        return file
    return chosen


def shortest_chain(gap: np.ndarray) -> list[tuple[int, bool]]:
    """The cheapest chain through all pieces; gap[a, b] leads from node a to node b, node 2 * i + r being piece i,
    reversed if r. Exact, over sets of pieces, all sets of a size at once: two sizes' costs are held, and one byte
    for each set and last node. Among chains within a millimetre the lowest nodes win."""
    nodes = len(gap)
    n, sets = nodes // 2, np.arange(1 << (nodes // 2))
    size = np.zeros(len(sets), dtype=np.int8)
    for i in range(n):
        size += (sets >> i & 1).astype(np.int8)
    place, came = np.empty(len(sets), dtype=np.int32), np.full((len(sets), nodes), -1, dtype=np.int8)
    free = [v for v in range(nodes) if v != 1]
    before = None
    for m in range(1, n + 1):
        layer = np.flatnonzero(size == m)
        place[layer] = np.arange(len(layer))
        cost = np.full((nodes, len(layer)), np.inf)
        for v in free:
            bit = 1 << (v >> 1)
            here = np.flatnonzero(layer & bit)
            if m == 1:
                cost[v, here] = 0
                continue
            earlier = place[layer[here] ^ bit]
            best, who = np.full(len(here), np.inf), np.full(len(here), -1, dtype=np.int8)
            for u in free:
                c = before[u, earlier] + gap[u, v]
                better = c < best - 1e-3
                best[better], who[better] = c[better], u
            cost[v, here] = best
            came[layer[here], v] = who
        before = cost
    at = -1
    for v in free:
        if before[v, 0] < (before[at, 0] if at >= 0 else np.inf) - 1e-3:
            at = v
    chain, held = [], len(sets) - 1
    while at >= 0:
        chain.append((at >> 1, bool(at & 1)))
        held, at = held ^ 1 << (at >> 1), int(came[held, at])
    return chain[::-1]


# --- matching ----------------------------------------------------------------------------------


def match(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, back: float = 60.0, ahead: float = 300.0, most: float = 40.0) -> np.ndarray:
    """For each point, how far along the reference line its nearest place lies, searching a window around the
    last match; NaN where nothing is near."""
    s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(rx), np.diff(ry)))])
    out, at = np.full(len(x), np.nan), 0.0
    for i in range(len(x)):
        lo, hi = max(0, int(np.searchsorted(s, at - back)) - 1), min(len(s) - 1, int(np.searchsorted(s, at + ahead)))
        if hi <= lo:
            continue
        ax, ay, bx, by = rx[lo:hi], ry[lo:hi], rx[lo + 1 : hi + 1], ry[lo + 1 : hi + 1]
        l2 = np.maximum((bx - ax) ** 2 + (by - ay) ** 2, 1e-12)
        u = np.clip(((x[i] - ax) * (bx - ax) + (y[i] - ay) * (by - ay)) / l2, 0, 1)
        d = np.hypot(x[i] - ax - u * (bx - ax), y[i] - ay - u * (by - ay))
        j = int(d.argmin())
        if d[j] <= most:
            out[i] = at = float(s[lo + j] + u[j] * (s[lo + j + 1] - s[lo + j]))
    return out
