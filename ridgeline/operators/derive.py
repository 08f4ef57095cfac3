"""Derived motion data of every point and statistics of every track: windows only, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.windows import in_order, so_far


def segments(df: DataFrame) -> DataFrame:
    """With `segment`, metres from the point before (0 at a track's start)."""
    lag = lambda c: F.lag(c).over(in_order())
    step = geo.haversine(lag("latitude"), lag("longitude"), F.col("latitude"), F.col("longitude"))
    return df.withColumn("segment", F.coalesce(step, F.lit(0.0)))


def derive(df: DataFrame) -> DataFrame:
    """Replaces distance, elapsed, bearing, dx, grade, dt and speed. Each is taken over the neighbours on
    both sides; at an end only the one there is, halved like the others."""
    d = segments(df).withColumn("distance", F.sum("segment").over(so_far())).withColumn("elapsed", (F.col("time") - F.first("time").over(so_far())) / 1000)
    before = lambda c: F.coalesce(F.lag(c).over(in_order()), F.col(c))
    after = lambda c: F.coalesce(F.lead(c).over(in_order()), F.col(c))
    names = ("distance", "elevation", "time", "latitude", "longitude")
    d = d.select("*", *[before(c).alias(f"_b_{c}") for c in names], *[after(c).alias(f"_a_{c}") for c in names], F.count("*").over(Window.partitionBy("track_id")).alias("_n"))
    alone = F.col("_n") <= 1
    dx = (F.col("_a_distance") - F.col("_b_distance")) / 2
    de = (F.col("_a_elevation") - F.col("_b_elevation")) / 2
    dt = (F.col("_a_time") - F.col("_b_time")) / 2000
    kept = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    made = {
        "bearing": geo.bearing(F.col("_b_latitude"), F.col("_b_longitude"), F.col("_a_latitude"), F.col("_a_longitude")),
        "grade": F.when(dx == 0, 0.0).otherwise(de / F.when(dx != 0, dx)),
        "dx": dx,
        "dt": dt,
        "speed": F.when(dt == 0, 0.0).otherwise(dx / F.when(dt != 0, dt)),
    }
    d = d.withColumns({c: F.when(alone, kept(c)).otherwise(x) for c, x in made.items()})
    extra = [c for c in ("distance", "elapsed", *made) if c not in df.columns]
    return d.select(*df.columns, *extra)


def without_time(df: DataFrame) -> DataFrame:
    return derive(df.withColumn("time", F.lit(0.0)))


def sub_path(df: DataFrame, first: int, until: int) -> DataFrame:
    """Points first (included) to until (not included) of every track, numbered anew."""
    return df.where((F.col("seq") >= first) & (F.col("seq") < until)).withColumn("seq", F.col("seq") - first)


def report_elevation(stats: DataFrame) -> DataFrame:
    """reported_gain and reported_loss: the filtered figures where there are any, otherwise the raw ones."""
    pick = lambda a, b: F.coalesce(F.when(~F.isnan(a), F.col(a)), F.col(b))
    return stats.withColumn("reported_gain", pick("gain_filtered", "gain")).withColumn("reported_loss", pick("loss_filtered", "loss"))


def track_stats(df: DataFrame) -> DataFrame:
    """One row a track: points, distance, raw gain and loss, heights, duration and bounds."""
    rise = F.col("elevation") - F.lag("elevation").over(in_order())
    d = segments(df).withColumn("_rise", rise)
    ends = lambda f, c: f(c, "seq")
    return d.groupBy("track_id").agg(
        F.count("*").alias("n_points"),
        F.sum("segment").alias("distance"),
        F.coalesce(F.sum(F.when(F.col("_rise") > 0, F.col("_rise"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(~(F.col("_rise") > 0), F.col("_rise"))), F.lit(0.0)).alias("loss"),
        F.min("elevation").alias("min_elevation"),
        F.max("elevation").alias("max_elevation"),
        F.when(F.count("*") >= 2, ends(F.max_by, "time") - ends(F.min_by, "time")).otherwise(0.0).alias("duration_ms"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
    )


def totals(stats: DataFrame) -> DataFrame:
    """Sums by track and over all of them (track_id null)."""
    return stats.rollup("track_id").agg(F.sum("n_points").alias("n_points"), F.sum("distance").alias("distance"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))


def bounds(df: DataFrame) -> DataFrame:
    """The box around all points, NaN left out."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.agg(*[f(ok(c)).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))])
