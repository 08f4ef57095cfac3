"""Bridge decks in a laser survey: where a road runs on a structure above lower ground, and its height there.

Stations lie at equal steps along a track. Each has the heights of the ground (mnt) and of the surface (mns) and
the surface's height above ground (mnh), NaN where the survey has none. Every test is written so that a missing
value that it reads rejects the span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ridgeline.functions import kernels as k
from ridgeline.functions.sequence import centred_slope, padded, rolling_median, runs
from ridgeline.options import DeckOptions

Span = tuple[int, int]
METRICS = ("canyon", "drop", "top", "slope_p95", "slope_max", "raw_slope_p95", "clean_fraction", "roughness", "smooth_fraction")


@dataclass
class Survey:
    """What the rules read at each station. What the ground model has above the surface counts as tall; `clean`
    stations have no rough one around them."""

    mnt: np.ndarray
    mns: np.ndarray
    height: np.ndarray
    smooth: np.ndarray
    rough: np.ndarray
    clean: np.ndarray
    slope: np.ndarray


def survey(mnt: np.ndarray, mns: np.ndarray, mnh: np.ndarray, o: DeckOptions) -> Survey:
    around = o.stations(o.roughness_window_m) // 2
    smooth = rolling_median(mns, o.island)
    rough = np.sqrt(padded((mns - smooth) ** 2, around).mean(axis=1))
    return Survey(
        mnt,
        mns,
        np.where(mnt > mns + o.ground_tolerance_m, np.inf, mnh) if o.ground_above_is_tall else mnh,
        smooth,
        rough,
        padded(rough, around).max(axis=1, initial=-np.inf) < o.max_roughness_m,
        np.abs(centred_slope(smooth, o.stations(o.slope_half_window_m), o.step_m)),
    )


def joined(spans: list[Span], missing: int) -> list[Span]:
    """Spans united where fewer than `missing` stations lie between them; with 0, where they share one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] - 1 < missing:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def raised(height: np.ndarray, o: DeckOptions) -> np.ndarray:
    """Stations that stand above the ground, with the short islands of missing values between two of them."""
    up = height > o.deck_height_m
    for a, b in runs(np.isnan(height)):
        if b - a < o.island and a > 0 and b < len(up) - 1 and up[a - 1] and up[b + 1]:
            up[a : b + 1] = True
    return up


def abutments(up: np.ndarray, o: DeckOptions):
    """A function that carries a span on to the ends of the raised stretches it begins and ends in, each side
    only if that is no more than an abutment away."""
    first, last = np.arange(len(up)), np.arange(len(up))
    for a, b in runs(up):
        first[a : b + 1], last[a : b + 1] = a, b
    most = o.stations(o.max_abutment_m)

    def carry(span: Span) -> Span:
        a, b = int(first[span[0]]), int(last[span[1]])
        return (a if span[0] - a <= most else span[0], b if b - span[1] <= most else span[1])

    return carry


def bridged_slopes(s: Survey, a: int, b: int, o: DeckOptions) -> np.ndarray:
    """Slopes inside the span of the surface drawn straight from clean station to clean station, but for gaps in
    which some station reaches the ground."""
    h, lo, hi = o.stations(o.slope_half_window_m), max(0, a - o.island), min(len(s.mns), b + 1 + o.island)
    clean = a + np.flatnonzero(s.clean[a : b + 1])
    between = np.arange(clean[0], clean[-1] + 1)
    gap = np.searchsorted(clean, between, side="right")
    grounded = gap[(s.height[between] <= o.clean_gap_ground_m) & ~s.clean[between]]
    drawn = s.mns.copy()[lo:hi]
    draw = between[~np.isin(gap, grounded)]
    drawn[draw - lo] = np.interp(draw, clean, s.mns[clean])
    return np.abs(centred_slope(rolling_median(drawn, o.island), h, o.step_m))[a + h - lo : b - h + 1 - lo]


def p95(x: np.ndarray) -> float:
    return float(np.percentile(x, 95)) if len(x) else math.nan


def judge(s: Survey, span: Span, o: DeckOptions) -> dict:
    """The span's figures and its status: DECK, or the reason against it."""
    (a, b), n, h = span, len(s.mnt), o.stations(o.slope_half_window_m)
    inside, inner = slice(a, b + 1), slice(a + h, max(a + h, b - h + 1))
    short = b - a <= o.stations(o.short_span_m)
    raw = s.slope[inner] if not short else np.zeros(0)
    fraction = float(s.clean[inner].mean()) if len(raw) else math.nan
    enough = o.slope_on_clean and fraction >= o.min_clean_fraction and s.clean[inside].sum() >= o.min_clean_stations
    slopes = bridged_slopes(s, a, b, o) if enough else raw
    rough = s.rough[inside][s.height[inside] > o.tall_m]
    over, top = s.smooth[inside] - s.mnt[inside], s.smooth[inside]
    best = lambda x: float(np.fmax.reduce(x))
    bank = np.minimum(s.mnt[max(a - 1, 0)], s.mnt[min(b + 1, n - 1)])
    found = {
        "canyon": best(over),
        "drop": float(bank - s.mnt[inside].min()),
        "top": best(top),
        "slope_p95": p95(slopes),
        "slope_max": float(slopes.max()) if len(slopes) else math.nan,
        "raw_slope_p95": p95(raw),
        "clean_fraction": fraction,
        "roughness": float(np.median(rough)) if len(rough) else math.nan,
    }
    blind = (a > 0 and math.isnan(s.height[a - 1])) or (b < n - 1 and math.isnan(s.height[b + 1]))
    decides = found["roughness" if short else "slope_p95"]
    if blind or math.isnan(found["drop"]):
        status = "NO_DATA"
    elif not found["drop"] > o.min_canyon_drop_m:
        status = "NO_CANYON"
    elif math.isnan(decides):
        status = "NO_DATA"
    elif short:
        status = "DECK" if decides < o.max_short_roughness_m else "SHORT_ROUGH"
    else:
        status = "DECK" if decides <= o.max_slope_p95 and (b - a) * o.step_m >= o.min_length_m else "STEEP"
    return found | {"first": a, "last": b, "status": status}


def find(mnt: np.ndarray, mns: np.ndarray, mnh: np.ndarray, o: DeckOptions = DeckOptions()) -> list[dict]:
    """All spans considered, by first station: decks with the `ranges` of stations whose road is the deck, others
    with the reason against them. Rough and unreadable runs are listed as merged groups, unmeasured.

    Tall runs that are smooth enough are merged over gaps, carried on to their abutments and judged. A steep
    span of several runs is judged again as its parts."""
    if not len(mnt):
        return []
    s = survey(mnt, mns, mnh, o)
    share, kept, others = {}, [], {"ROUGH": [], "NO_DATA": []}
    for a, b in runs(s.height > o.tall_m):
        if b - a + 1 < o.stations(o.min_tall_run_m):
            continue
        rough = s.rough[a : b + 1]
        smooth = rough < o.max_roughness_m
        if smooth.mean() >= o.min_smooth_fraction:
            kept.append((a, b))
            share[a, b] = float(smooth.mean())
        else:
            others["NO_DATA" if (smooth | np.isnan(rough)).mean() >= o.min_smooth_fraction else "ROUGH"].append((a, b))
    gap, up = o.stations(o.merge_gap_m), raised(s.height, o)
    carry = abutments(up, o)
    parts = joined([carry(r) for r in kept], 0)
    found = []
    for span in joined([carry(r) for r in joined(kept, gap)], 0):
        whole = judge(s, span, o)
        inside = [p for p in parts if span[0] <= p[0] and p[1] <= span[1]]
        split = o.split_steep and whole["status"] == "STEEP" and len(inside) > 1
        found += [judge(s, p, o) for p in inside] if split else [whole]
    for d in found:
        d["smooth_fraction"] = min((x for (a, b), x in share.items() if d["first"] <= a and b <= d["last"]), default=math.nan)
    for status, some in others.items():
        found += [dict.fromkeys(METRICS, math.nan) | {"first": a, "last": b, "status": status} for a, b in joined(some, gap)]
    ranges = deck_ranges(s, [(d["first"], d["last"]) for d in found if d["status"] == "DECK"], o)
    for d in found:
        a, b = d["first"], d["last"]
        d |= {"start": a * o.step_m, "end": b * o.step_m, "length": (b - a + 1) * o.step_m}
        d["ranges"] = [{"first": p, "last": q} for p, q in (ranges[a, b] if d["status"] == "DECK" else [])]
    return sorted(found, key=lambda d: (d["first"], d["last"]))


def deck_ranges(s: Survey, spans: list[Span], o: DeckOptions) -> dict[Span, list[Span]]:
    """Stretches of each accepted span that stand above the ground, short holes closed; in all but small spans
    only those of some length."""
    up = s.height > o.deck_height_m
    for a, b in spans:
        for p, q in runs(~up[a : b + 1]):
            if p > 0 and q < b - a and q - p < o.island and not np.isnan(s.smooth[a + p : a + q + 1]).any():
                up[a + p : a + q + 1] = True
    p, q = np.array(runs(up), dtype=int).reshape(-1, 2).T
    out, long = {}, q - p + 1 >= o.stations(o.deck_min_run_m)
    for a, b in spans:
        i = np.flatnonzero((p <= b) & (q >= a) & (long | (b - a <= o.stations(o.small_span_m))))
        out[a, b] = [(max(int(x), a), min(int(y), b)) for x, y in zip(p[i], q[i], strict=True)]
    return out


def surface_windows(mnh: np.ndarray, o: DeckOptions = DeckOptions()) -> list[Span]:
    """The stations whose surface and ground `find` can read, given the heights above ground alone."""
    tall = [r for r in runs(mnh > o.tall_m) if r[1] - r[0] + 1 >= o.stations(o.min_tall_run_m)]
    first, last = np.arange(len(mnh)), np.arange(len(mnh))
    for a, b in runs(raised(mnh, o)):
        first[a : b + 1], last[a : b + 1] = a, b
    pad = o.island + o.stations(o.roughness_window_m) // 2
    return joined([(max(0, int(first[a]) - pad), min(len(mnh) - 1, int(last[b]) + pad)) for a, b in joined(tall, o.stations(o.merge_gap_m))], 1)


# --- the road on decks -------------------------------------------------------------------------


@dataclass
class Stretch:
    """Stations first to last whose road is drawn anew: `z` holds the deck from its first to its last anchor, that
    height on to an end of the track, and NaN on ramps and pins, which the road around decides."""

    first: int
    last: int
    pinned: tuple[bool, bool]
    anchors: np.ndarray
    z: np.ndarray

    def drawn(self, before: float, after: float) -> np.ndarray:
        z = self.z.copy()
        if self.pinned[0]:
            z[0] = before
        if self.pinned[1]:
            z[-1] = after
        known = np.flatnonzero(~np.isnan(z))
        return np.interp(np.arange(len(z)), known, z[known])

    def written(self, step: float) -> tuple[float, float]:
        """The distances that are drawn anew, without end beyond an end of the track."""
        return (self.first * step if self.pinned[0] else -math.inf, self.last * step if self.pinned[1] else math.inf)


def least_above(z: np.ndarray, rise: float) -> np.ndarray:
    """The lowest line nowhere below z with steps of at most `rise`."""
    i = np.arange(len(z)) * rise
    return np.maximum(np.maximum.accumulate(z + i) - i, np.maximum.accumulate((z - i)[::-1])[::-1] + i)


def stretches(mnt: np.ndarray, mns: np.ndarray, mnh: np.ndarray, found: list[dict], o: DeckOptions = DeckOptions()) -> list[Stretch]:
    """The road on accepted decks: the surface at their clean stations, straight between them, smoothed, and raised
    where it would be steeper than a deck may be. Neighbouring spans over one canyon are one stretch. Regions with
    fewer than two anchors keep the ground."""
    s, n = survey(mnt, mns, mnh, o), len(mnt)
    regions: list[tuple[int, int, np.ndarray]] = []
    for d in found:
        if d["status"] != "DECK":
            continue
        at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in d["ranges"]] or [np.zeros(0, dtype=int)])
        at = at[s.clean[at] & np.isfinite(mns[at])]
        if regions and _one_canyon(regions[-1], (d["first"], d["last"], at), s, o):
            a, _, before = regions[-1]
            regions[-1] = (a, d["last"], np.concatenate([before, at]))
        else:
            regions.append((d["first"], d["last"], at))
    return [_stretch(a, b, at, mns, n, o) for a, b, at in regions if len(at) > 1]


def _one_canyon(one: tuple, other: tuple, s: Survey, o: DeckOptions) -> bool:
    (_, end, p), (start, _, q) = one, other
    if start - end - 1 >= o.stations(o.merge_gap_m) or not len(p) or not len(q):
        return False
    between = np.arange(end + 1, start)
    line = np.interp(between, [p[-1], q[0]], s.mns[[p[-1], q[0]]])
    return bool((line - s.mnt[between] > o.min_canyon_drop_m).all())


def _stretch(a: int, b: int, at: np.ndarray, mns: np.ndarray, n: int, o: DeckOptions) -> Stretch:
    u, v, half = int(at[0]), int(at[-1]), o.island
    line = np.interp(np.arange(u, v + 1), at, mns[at])
    alone = np.pad(line, half, constant_values=np.nan)
    deck = least_above(rolling_median(alone, half)[half : half + len(line)], o.max_slope_p95 * o.step_m)
    first, last = max(0, a - 1), min(n - 1, b + 1)
    z = np.full(last - first + 1, np.nan)
    z[u - first : v - first + 1] = deck
    if first == a:
        z[: u - first] = deck[0]
    if last == b:
        z[v - first + 1 :] = deck[-1]
    return Stretch(first, last, (first < a, last > b), at, z)


def profile(ground: np.ndarray, some: list[Stretch]) -> np.ndarray:
    """Heights of the stations with the stretches drawn in."""
    out = ground.copy()
    for r in some:
        out[r.first : r.last + 1] = r.drawn(ground[r.first], ground[r.last])
    return out


def write(distance: np.ndarray, elevation: np.ndarray, some: list[Stretch], step: float) -> np.ndarray:
    """Heights of a track's points with the stretches drawn in, pinned to the track's own heights."""
    out = elevation.copy()
    for r in some:
        z = r.drawn(*k.value_at(distance, elevation, np.array([r.first, r.last]) * step))
        lo, hi = r.written(step)
        inside = (distance >= lo) & (distance <= hi)
        out[inside] = np.interp(distance[inside] / step - r.first, np.arange(len(z)), z)
    return out
