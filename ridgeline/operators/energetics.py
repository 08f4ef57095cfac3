"""Anaerobic reserve and counted ascent: folds over a track's ordered points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import kernels
from ridgeline.operators.tracks import add_columns, by_track, summarize
from ridgeline.options import GAIN_PRESETS, Cyclist, GainOptions


def w_prime_balance(df: DataFrame, power: str = "pComputedPower", cyclist: Cyclist = Cyclist()) -> DataFrame:
    """wPrimeBalance at every point, spent above critical power, won back below it: one call a track, linear in
    its points."""
    return add_columns(df, ["time", power], ["wPrimeBalance"], lambda t: {"wPrimeBalance": kernels.w_prime(t["time"], t[power], cyclist.critical_power_w, cyclist.w_prime_j)})


def hysteresis_gain(df: DataFrame, threshold: float, height: str = "elevation") -> DataFrame:
    """gain, loss and legs of every track between turns of at least the threshold, unsmoothed: a fold of nine
    fields over the ordered heights."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(height).alias("e")))), lambda x: x["e"])
    tracks = by_track(df).agg(rows.alias("h"))
    names = ("h0", "hi", "lo", "ref", "ext", "gain", "loss")

    def state(way, hi_last, legs, **v):
        return F.struct(F.coalesce(way, F.lit(0)).cast("int").alias("way"), hi_last.alias("hi_last"), legs.cast("int").alias("legs"), *[v[n].cast("double").alias(n) for n in names])

    def step(a, e):
        up, down = e > a["hi"], e < a["lo"]
        hi, lo = F.greatest(a["hi"], e), F.least(a["lo"], e)
        hi_last = F.when(up, True).when(down, False).otherwise(a["hi_last"])
        opens = (a["way"] == 0) & (hi - lo >= threshold)
        rising = opens & hi_last
        falling = opens & ~hi_last
        way = a["way"]
        further = ((way > 0) & (e > a["ext"])) | ((way < 0) & (e < a["ext"]))
        turns = (way != 0) & ~further & ((a["ext"] - e) * way >= threshold)
        leg = a["ext"] - a["ref"]
        first_down, first_up = rising & (lo < a["h0"]), falling & (hi > a["h0"])
        return state(
            F.when(rising, 1).when(falling, -1).when(turns, -way).otherwise(way),
            hi_last,
            a["legs"] + F.when(first_down | first_up | turns, 1).otherwise(0),
            h0=a["h0"],
            hi=F.when(way == 0, hi).otherwise(a["hi"]),
            lo=F.when(way == 0, lo).otherwise(a["lo"]),
            ref=F.when(rising, lo).when(falling, hi).when(turns, a["ext"]).otherwise(a["ref"]),
            ext=F.when(rising, hi).when(falling, lo).when(further | turns, e).otherwise(a["ext"]),
            gain=a["gain"] + F.when(first_up, hi - a["h0"]).when(turns & (way > 0), leg).otherwise(0.0),
            loss=a["loss"] + F.when(first_down, lo - a["h0"]).when(turns & (way < 0), leg).otherwise(0.0),
        )

    def done(a):
        leg = a["ext"] - a["ref"]
        counts = (a["way"] != 0) & (leg * a["way"] > 0)
        return F.struct((a["gain"] + F.when(counts & (a["way"] > 0), leg).otherwise(0.0)).alias("gain"), (a["loss"] + F.when(counts & (a["way"] < 0), leg).otherwise(0.0)).alias("loss"), (a["legs"] + F.when(counts, 1).otherwise(0)).alias("legs"))

    h0 = F.element_at("h", 1)
    zero = state(F.lit(0), F.lit(False), F.lit(0), h0=h0, hi=h0, lo=h0, ref=h0, ext=h0, gain=F.lit(0.0), loss=F.lit(0.0))
    return tracks.select("track_id", F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), zero, step, done).alias("g")).select("track_id", "g.gain", "g.loss", "g.legs")


GAIN = "gain double, loss double, raw_gain double, raw_loss double, legs int"


def elevation_gain(df: DataFrame, options: GainOptions = GainOptions()) -> DataFrame:
    """Ascent of every track, of the heights as first measured, smoothed at the preset's own scale."""
    return summarize(df, ["distance", "elevation", "sourceElevation"], GAIN, lambda t: kernels.gain(t["distance"], t["elevation"], t["sourceElevation"], options))


def gain_sweep(df: DataFrame, presets: dict[str, tuple[float, float]] = GAIN_PRESETS) -> DataFrame:
    """Ascent by track and preset, read once."""

    def sweep(t):
        return [{"preset": name, **kernels.gain(t["distance"], t["elevation"], t["sourceElevation"], GainOptions(*o))} for name, o in presets.items()]

    return summarize(df, ["distance", "elevation", "sourceElevation"], f"preset string, {GAIN}", sweep)


def gain_grid(df: DataFrame, windows: tuple[float, ...] = (0, 15, 30, 50, 150), thresholds: tuple[float, ...] = (0, 2, 3, 5, 10)) -> DataFrame:
    """A row for each track and smoothing, a column for each threshold."""
    found = gain_sweep(df, {f"{w:g}|{t:g}": (t, w) for w in windows for t in thresholds})
    parts = F.split("preset", r"\|")
    return found.select("track_id", parts[0].cast("double").alias("window_m"), parts[1].alias("threshold"), "gain").groupBy("track_id", "window_m").pivot("threshold", [f"{t:g}" for t in thresholds]).agg(F.first("gain"))


def cumulative_gain(df: DataFrame, options: GainOptions = GainOptions()) -> DataFrame:
    """cumulativeGain of every point."""

    def run(t):
        h = kernels.np.where(kernels.np.isnan(t["sourceElevation"]), t["elevation"], t["sourceElevation"])
        return {"cumulativeGain": kernels.cumulative_gain(kernels.smooth_profile(t["distance"], h, options.window_m), options.threshold_m)}

    return add_columns(df, ["distance", "elevation", "sourceElevation"], ["cumulativeGain"], run)
