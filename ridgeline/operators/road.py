"""Corners, racing lines, the order of a track's segments, and matching against a reference line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import kernels, sequence
from ridgeline.operators.tracks import map_tracks, summarize
from ridgeline.options import RacingLineOptions
from ridgeline.schema import FIELDS

CORNER = "first int, last int, start double, end double, length double, turn_deg double, side int, radius double, kind string"
LINE = "i int, s double, kappa double, lo double, hi double, offset double"


def corners(df: DataFrame, options: RacingLineOptions = RacingLineOptions()) -> DataFrame:
    def run(t):
        f = kernels.planar(t, options.curvature.geometry_smooth_m)
        if f is None:
            return []
        kernels.measure_curvature(f, options.curvature)
        return sequence.corners(f, sequence.road_width(t, f.s, options), options)

    return summarize(df, FIELDS, CORNER, run)


def racing_report(df: DataFrame, options: RacingLineOptions = RacingLineOptions()) -> DataFrame:
    """Arc length, curvature, corridor and offset at each point of every track that has a line."""

    def run(t):
        r = sequence.racing_line(t, options)
        if r is None:
            return []
        f = r["frame"]
        return [{"i": i, "s": float(f.s[i]), "kappa": float(f.kappa[i]), "lo": float(r["lo"][i]), "hi": float(r["hi"][i]), "offset": float(r["offset"][i])} for i in range(len(f.s))]

    return summarize(df, FIELDS, LINE, run)


def racing_line(df: DataFrame, options: RacingLineOptions = RacingLineOptions()) -> DataFrame:
    return map_tracks(df, lambda t: sequence.drive(t, options))


def nearest_elsewhere(df: DataFrame, gap: float, reach: float = 12.0) -> DataFrame:
    """track_id, seq, clearance: distance of planar points (x, y, s) to the nearest of another stretch of the
    same track, by an equi-join on grid cells (each point also sent to the eight around it)."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    d = df.select("track_id", "seq", "x", "y", "s", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = d.select("track_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"), "cx", "cy", around.alias("n")).select("track_id", "x2", "y2", "s2", (F.col("cx") + F.col("n.i")).alias("cx"), (F.col("cy") + F.col("n.j")).alias("cy"))
    pairs = d.join(other, ["track_id", "cx", "cy"]).where(F.abs(F.col("s") - F.col("s2")) > gap)
    return pairs.groupBy("track_id", "seq").agg(F.min(F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))).alias("clearance"))


def segment_gap(df: DataFrame) -> DataFrame:
    """track_id, gap_m: metres between the ends of consecutive segments (seg_idx, pt_idx; radians)."""
    from ridgeline.functions.geo import haversine

    w = Window.partitionBy("track_id").orderBy("seg_idx")
    first, last = F.min_by(F.struct("latitude", "longitude"), "pt_idx"), F.max_by(F.struct("latitude", "longitude"), "pt_idx")
    ends = df.groupBy("track_id", "seg_idx").agg(first.alias("a"), last.alias("b")).withColumn("p", F.lag("b").over(w))
    return ends.groupBy("track_id").agg(F.coalesce(F.sum(haversine(F.col("p.latitude"), F.col("p.longitude"), F.col("a.latitude"), F.col("a.longitude"))), F.lit(0.0)).alias("gap_m"))


def order_segments(df: DataFrame, least_gain: float = 200.0, most: int = 16) -> DataFrame:
    """track_id, place, seg_idx, reversed: the order of segments that leaves the shortest gaps, where that saves
    more than `least_gain` metres; the file's for tracks of more than `most` segments (at most 20). Only each
    segment's ends reach the grouped call."""
    ends = df.groupBy("track_id", "seg_idx").agg(F.min_by(F.struct("latitude", "longitude"), "pt_idx").alias("a"), F.max_by(F.struct("latitude", "longitude"), "pt_idx").alias("b"))
    flat = ends.select("track_id", "seg_idx", "a.latitude", "a.longitude", F.col("b.latitude").alias("lat2"), F.col("b.longitude").alias("lon2"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seg_idx")
        order = sequence.best_order(p[["latitude", "longitude", "lat2", "lon2"]].to_numpy().reshape(-1, 2, 2), least_gain, most)
        ids = p["seg_idx"].to_numpy()
        return pd.DataFrame({"track_id": [p["track_id"].iloc[0]] * len(order), "place": range(len(order)), "seg_idx": [int(ids[i]) for i, _ in order], "reversed": [r for _, r in order]})

    return flat.groupBy("track_id").applyInPandas(run, f"track_id {df.schema['track_id'].dataType.simpleString()}, place int, seg_idx int, reversed boolean")


def ordered_segments(df: DataFrame, least_gain: float = 200.0, most: int = 16) -> DataFrame:
    """The points (track_id, seg_idx, pt_idx and any others) with their segments in that order: seg_idx is the
    place, and the points of a reversed segment are numbered from its end."""
    order = order_segments(df, least_gain, most)
    last = F.max("pt_idx").over(Window.partitionBy("track_id", "seg_idx"))
    first = F.min("pt_idx").over(Window.partitionBy("track_id", "seg_idx"))
    turned = df.withColumn("_back", first + last - F.col("pt_idx")).join(order, ["track_id", "seg_idx"])
    made = {"seg_idx": F.col("place"), "pt_idx": F.when(F.col("reversed"), F.col("_back")).otherwise(F.col("pt_idx"))}
    return turned.select(*[made[c].cast(df.schema[c].dataType).alias(c) if c in made else F.col(c) for c in df.columns])


def match(df: DataFrame, reference: DataFrame, back: float = 60.0, ahead: float = 300.0, most: float = 40.0) -> DataFrame:
    """track_id, seq, along: where each planar point (x, y) lies along its track's reference line."""
    key = df.schema["track_id"].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("seq"), b.sort_values("seq")
        along = sequence.match(a["x"].to_numpy(), a["y"].to_numpy(), b["x"].to_numpy(), b["y"].to_numpy(), back, ahead, most) if len(b) > 1 else np.full(len(a), np.nan)
        return pd.DataFrame({"track_id": a["track_id"], "seq": a["seq"], "along": along})

    return df.select("track_id", "seq", "x", "y").groupBy("track_id").cogroup(reference.select("track_id", "seq", "x", "y").groupBy("track_id")).applyInPandas(run, f"track_id {key}, seq long, along double")


def delta_decode(df: DataFrame, column: str, scale: float) -> DataFrame:
    """An array of differences as running totals, scaled; null from a missing difference on."""

    @F.pandas_udf("array<double>")
    def totals(arrays: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            t = np.cumsum(np.array([np.nan if i is None else i for i in x], dtype=float)) * scale
            return [None if np.isnan(i) else i for i in t.tolist()]

        return arrays.map(one, na_action="ignore")

    return df.withColumn(column, totals(F.transform(column, lambda x: x.cast("long"))))
