"""The whole pipeline: densify, terrain, smoothing, curvature or racing line, speed limits, the simulated ride,
1 Hz, anaerobic reserve, ascent, simplification.

Everything after the terrain lookup works on one track at a time, in a fixed order, so it is one grouped call
a track: one shuffle on `track_id`, no table between stages. The terrain lookup is a join and stays outside.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ridgeline.functions import kernels as k
from ridgeline.functions import sequence
from ridgeline.operators import terrain
from ridgeline.operators.derive import track_stats
from ridgeline.operators.tracks import map_tracks
from ridgeline.options import Bike, Cyclist, DeckOptions, EnhanceOptions, PowerSpec, TunnelOptions, Wind
from ridgeline.schema import points

DENSIFY_M, REFINE_MIN_M, REFINE_MAX_M = 30.0, 1.0, 2.0


def flat_tunnels(t: k.Track, o: TunnelOptions) -> k.Track:
    import numpy as np

    s = np.arange(0, t["distance"][-1] + 1e-9, o.step_m)
    at = lambda c: k.value_at(t["distance"], t[c], s)
    spans = sequence.tunnels(at("elevation"), at("latitude"), at("longitude"), o) if len(s) > 1 else []
    out = k.copy(t)
    out["elevation"] = sequence.flatten(t["distance"], t["elevation"], spans)
    return k.derive(out)


def ride(t: k.Track, o: EnhanceOptions, c: Cyclist, bike: Bike, wind: Wind, spec: PowerSpec, rho: str) -> k.Track:
    """All stages after the terrain lookup on one track."""
    if not k.size(t):
        return t
    t = k.derive(t)
    if not o.fix_elevation:
        t = k.per_distance(t, -1.0, DENSIFY_M)
    if not o.on_terrain:
        t = k.per_distance(t, REFINE_MIN_M, REFINE_MAX_M)
        if o.tunnels:
            t = flat_tunnels(t, TunnelOptions())
    if o.smooth and o.smooth_window_m > 0:
        t = k.smooth_elevation(t, o.smooth_window_m)
    if o.racing_line.enabled:
        t = sequence.drive(t, o.racing_line)
    else:
        t = k.curvature(t, o.curvature)
    if o.max_speeds or o.virtualize:
        t = k.max_speeds(t, c)
    if o.virtualize:
        t = k.virtualize(t, c, bike, wind, spec, rho)
    if o.one_hz:
        t = k.per_second(t)
    if o.w_prime:
        t = k.copy(t)
        t["wPrimeBalance"] = k.w_prime(t["time"], t["pComputedPower"], c.critical_power_w, c.w_prime_j)
    if o.simplify:
        tolerance = min(o.simplify_tolerance_m, o.racing_line.simplify_cap_m) if o.racing_line.enabled else o.simplify_tolerance_m
        t = k.simplify(t, tolerance, o.simplify_z)[0]
    return t


def enhance(df: DataFrame, options: EnhanceOptions = EnhanceOptions(), cyclist: Cyclist = Cyclist(), bike: Bike = Bike(), wind: Wind = Wind(), spec: PowerSpec = PowerSpec(), rho: str = "estimate", tiles: DataFrame | None = None) -> DataFrame:
    """Points in, points out. `tiles` (see terrain.heights) are needed to replace heights by the terrain's; with
    them bridge decks and tunnels are drawn from ground and surface models, after the points are refined.
    Without, tunnels are found in the track's own heights, and decks can't be."""
    d = points(df)
    if options.fix_elevation:
        if tiles is None:
            raise ValueError("fix_elevation needs a table of tiles")
        d = map_tracks(d, lambda t: k.per_distance(k.derive(t), -1.0, DENSIFY_M))
        d = terrain.fix_elevation(d, tiles)
    elif options.bridge_decks:
        raise ValueError("bridge_decks needs fix_elevation")
    if options.on_terrain:
        d = map_tracks(d, lambda t: k.per_distance(k.derive(t), REFINE_MIN_M, REFINE_MAX_M))
        d = terrain.road_heights(d, tiles, deck=DeckOptions() if options.bridge_decks else None, tunnel=TunnelOptions() if options.tunnels else None)
    return map_tracks(d, lambda t: ride(t, options, cyclist, bike, wind, spec, rho))


def durations(df: DataFrame) -> DataFrame:
    return track_stats(df)


def scenarios(df: DataFrame, cyclists: dict[str, Cyclist], options: EnhanceOptions = EnhanceOptions()) -> DataFrame:
    """scenario and statistics of every track under each of several riders."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [track_stats(enhance(df, replace(options, simplify=False), c)).withColumn("scenario", F.lit(name)) for name, c in cyclists.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
