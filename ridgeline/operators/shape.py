"""Smoothing, curvature, simplification, wind and climbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo, kernels
from ridgeline.operators.windows import in_order
from ridgeline.operators.tracks import add_columns, map_tracks, summarize
from ridgeline.options import ClimbOptions, CurvatureOptions


def smooth_elevation(df: DataFrame, half: float = 150.0) -> DataFrame:
    """Heights under a triangular kernel integrated exactly along the track; the first smoothing keeps the
    source heights, and motion data is derived anew."""
    return map_tracks(df, lambda t: kernels.smooth_elevation(t, half))


def smooth_profile(df: DataFrame, half: float, column: str = "elevation", to: str = "smoothed") -> DataFrame:
    """The same kernel on one column, the others untouched."""
    return add_columns(df, ["distance", column], [to], lambda t: {to: kernels.smooth_profile(t["distance"], t[column], half)})


def smooth_samples(df: DataFrame, half: float, column: str = "elevation", to: str = "smoothed") -> DataFrame:
    """Mean of the samples within `half` metres with weights falling to 0, in the JVM: points meet in buckets
    of that width, each sent to its own bucket and the two beside it."""
    b = F.floor(F.col("distance") / half).cast("long")
    d = df.select("track_id", "seq", F.col("distance").alias("s"), F.col(column).alias("v"), b.alias("b"))
    near = d.select("track_id", F.col("s").alias("s2"), F.col("v").alias("v2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    w = 1 - F.abs(F.col("s2") - F.col("s")) / half
    pairs = d.join(near, ["track_id", "b"]).where((F.abs(F.col("s2") - F.col("s")) < half) & ~F.isnan("v2"))
    means = pairs.groupBy("track_id", "seq").agg((F.sum(w * F.col("v2")) / F.sum(w)).alias(to))
    out = df.join(means, ["track_id", "seq"], "left")
    return out.withColumn(to, F.when(F.isnan(column), F.col(column)).otherwise(F.coalesce(to, column)))


def rolling_median(df: DataFrame, column: str, half: int, to: str) -> DataFrame:
    """Median of the known values within `half` rows; at the ends the window is the part that exists."""
    known = F.when(~F.isnan(column), F.col(column))
    return df.withColumn(to, F.percentile(known, F.lit(0.5)).over(in_order().rowsBetween(-half, half)))


def rolling(df: DataFrame, column: str, half: int) -> DataFrame:
    """mean and max within `half` rows; a NaN in the window spreads."""
    w = in_order().rowsBetween(-half, half)
    bad = F.max(F.isnan(column)).over(w)
    return df.withColumn("mean", F.when(bad, float("nan")).otherwise(F.avg(column).over(w))).withColumn("max", F.when(bad, float("nan")).otherwise(F.max(column).over(w)))


def roughness(df: DataFrame, column: str, base: str, half: int) -> DataFrame:
    """Root of the mean square of column - base within `half` rows."""
    return df.withColumn("roughness", F.sqrt(F.avg(F.pow(F.col(column) - F.col(base), 2)).over(in_order().rowsBetween(-half, half))))


def centred_slope(df: DataFrame, column: str, half: int, step: float) -> DataFrame:
    """Rise over 2 * half stations; at the ends the nearest value stands in, the length stays."""
    ends = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = F.coalesce(F.lead(column, half).over(in_order()), F.last(column).over(ends))
    b = F.coalesce(F.lag(column, half).over(in_order()), F.first(column).over(ends))
    return df.withColumn("slope", (a - b) / (2 * half * step))


def headings(df: DataFrame) -> DataFrame:
    """heading of every point (left positive), unwound along the track: a running sum of wrapped changes."""
    x, y = F.col("longitude") * F.cos(F.avg("latitude").over(Window.partitionBy("track_id"))), F.col("latitude")
    d = df.withColumn("_x", x).withColumn("_y", y)
    near = lambda f, c: F.coalesce(f(c).over(in_order()), F.col(c))
    d = d.withColumn("_raw", F.atan2(near(F.lead, "_y") - near(F.lag, "_y"), near(F.lead, "_x") - near(F.lag, "_x")))
    d = d.withColumn("_turn", F.coalesce(geo.unwrap(F.col("_raw") - F.lag("_raw").over(in_order())), F.col("_raw")))
    return d.withColumn("heading", F.sum("_turn").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_x", "_y", "_raw", "_turn")


def heading_regression(df: DataFrame, half: float) -> DataFrame:
    """kappa: slope of heading over distance within `half` metres each way, by the windowed regression
    aggregate (its frame needs SQL text, which takes fractions)."""
    made = F.expr(f"regr_slope(heading, distance) OVER (PARTITION BY track_id ORDER BY distance RANGE BETWEEN {float(half)}D PRECEDING AND {float(half)}D FOLLOWING)")
    return df.withColumn("kappa", made)


def curvature(df: DataFrame, options: CurvatureOptions = CurvatureOptions()) -> DataFrame:
    """trajectoryCurvature by regressions over several widths, the widest that fits winning. Tracks that are
    too short, near a pole or not finite keep what they have."""
    return map_tracks(df, lambda t: kernels.curvature(t, options))


def simplify(df: DataFrame, tolerance: float = 10.0, z: float = 3.0) -> DataFrame:
    """Douglas-Peucker in space with exaggerated heights; all columns of the points that stay."""
    return map_tracks(df, lambda t: kernels.simplify(t, tolerance, z)[0])


def simplify_indices(df: DataFrame, tolerance: float = 10.0, z: float = 3.0) -> DataFrame:
    """track_id and seq of the points that stay, for a semi join."""
    return summarize(df, ["latitude", "longitude", "elevation"], "seq long", lambda t: [{"seq": int(i)} for i in kernels.farthest_points(kernels.ecef(t["latitude"], t["longitude"], t["elevation"], z), tolerance)])


def headwind(df: DataFrame, by: str | None = "track_id") -> DataFrame:
    """The wind (compass degrees it blows to) that most opposes each track, or all together (by=None): means of
    unit vectors from the start to each later point, of tracks of more than three points; NaN if none."""
    first = lambda c: F.first(c).over(in_order())
    d = df.select("track_id", "seq", (geo.unwrap(F.col("longitude") - first("longitude")) * F.cos(first("latitude"))).alias("dx"), (F.col("latitude") - first("latitude")).alias("dy"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    unit = lambda c: F.sum(F.when(length >= 1e-12, F.col(c) / length))
    means = d.groupBy("track_id").agg(F.count("*").alias("n"), (unit("dx") / (F.count("*") - 1)).alias("x"), (unit("dy") / (F.count("*") - 1)).alias("y")).where("n > 3")
    sums = means.groupBy(*([by] if by else [])).agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("x"), F.sum(F.coalesce("y", F.lit(0.0))).alias("y"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    degrees = F.degrees(F.atan2(-F.col("x"), -F.col("y")))
    return sums.select(*([by] if by else []), F.when(size >= 1e-12, F.pmod(degrees, F.lit(360.0))).otherwise(float("nan")).alias("azimuth_deg"))


CLIMB = "first long, last long, start double, end double, length double, elevation double, positive double, negative double, grade double, climbing_grade double, score double, parts array<struct<start:double,end:double,elevation:double,grade:double>>"


def climbs(df: DataFrame, options: ClimbOptions = ClimbOptions()) -> DataFrame:
    """The climbs of every track, in order."""
    return summarize(df, ["distance", "elevation"], CLIMB, lambda t: kernels.climbs(t["distance"], t["elevation"], options))


def climb_candidates(df: DataFrame, options: ClimbOptions = ClimbOptions()) -> DataFrame:
    """The best climb from every start, over all later points of its track (on a tie the last); one call a
    track, whose time grows with the square of its points and whose memory does not."""

    def best(t):
        seq = t["_seq"]
        return [{"first": int(seq[i]), "score": score, "last": int(seq[j])} for score, i, j in kernels.best_climbs(t["distance"], t["elevation"], options)[0]]

    found = summarize(df.withColumn("_seq", F.col("seq")), ["distance", "elevation", "_seq"], "first long, score double, last long", best)
    return found.withColumn("track_id", F.col("track_id").cast(df.schema["track_id"].dataType))
