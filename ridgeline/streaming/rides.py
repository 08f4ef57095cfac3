"""Rides as streams: windows with watermarks, sessions, and state carried from point to point.

Input is a stream of points with an event time `ts`, `track_id` and what the operator reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.functions.kernels import w_prime_step
from ridgeline.options import Cyclist, PowerSpec


def per_second(points: DataFrame, late: str = "10 seconds", columns: tuple[str, ...] = ("power",)) -> DataFrame:
    """Means by track and second; later points than the watermark allows are left out."""
    w = points.withWatermark("ts", late).groupBy("track_id", F.window("ts", "1 second"))
    return w.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).select("track_id", F.col("window.start").alias("second"), "n", *columns)


def sliding(points: DataFrame, column: str, length: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Mean and greatest of a column by track over sliding windows."""
    w = points.withWatermark("ts", late).groupBy("track_id", F.window("ts", length, slide))
    return w.agg(F.avg(column).alias("mean"), F.max(column).alias("max")).select("track_id", F.col("window.start").alias("from"), F.col("window.end").alias("until"), "mean", "max")


def sessions(points: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """A row for each ride: points of a track without a pause of `gap`."""
    w = points.withWatermark("ts", late).groupBy("track_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("track_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("until"), "n")


def w_prime(points: DataFrame, cyclist: Cyclist = Cyclist()) -> DataFrame:
    """track_id, ts, w_prime at every point, the balance kept as state between batches."""
    cp, full = cyclist.critical_power_w, cyclist.w_prime_j

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, b = state.get if state.exists else (None, full)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, p in zip(rows["ts"], rows["power"], strict=True):
            now = ts.value / 1e9
            if last is not None and now > last and pd.notna(p):
                b = w_prime_step(b, float(p), cp, full, now - last)
            last = now if last is None else max(last, now)
            out.append((key[0], ts, b))
        state.update((last, b))
        yield pd.DataFrame(out, columns=["track_id", "ts", "w_prime"])

    kind = points.schema["track_id"].dataType.simpleString()
    return points.select("track_id", "ts", "power").groupBy("track_id").applyInPandasWithState(run, f"track_id {kind}, ts timestamp, w_prime double", "last double, balance double", "append", GroupStateTimeout.NoTimeout)


def slew_limited(points: DataFrame, spec: PowerSpec = PowerSpec(slew_w_per_s=50.0)) -> DataFrame:
    """track_id, ts, power with each change held to the limit, from 0 W at the start."""
    most = spec.slew_w_per_s or 50.0

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, p in zip(rows["ts"], rows["power"], strict=True):
            now = ts.value / 1e9
            budget = most * (now - last) if last is not None and now > last else 0.0
            if pd.notna(p):
                held += max(-budget, min(budget, float(p) - held))
            last = now
            out.append((key[0], ts, held))
        state.update((last, held))
        yield pd.DataFrame(out, columns=["track_id", "ts", "power"])

    kind = points.schema["track_id"].dataType.simpleString()
    return points.select("track_id", "ts", "power").groupBy("track_id").applyInPandasWithState(run, f"track_id {kind}, ts timestamp, power double", "last double, held double", "append", GroupStateTimeout.NoTimeout)
