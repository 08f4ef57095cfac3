"""Resampling: rows made by explode and windows where a row's fate depends on its neighbours only,
one call a track where it depends on the last row kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo, kernels
from ridgeline.operators.windows import in_order
from ridgeline.operators.derive import derive
from ridgeline.operators.tracks import map_tracks, renumbered
from ridgeline.schema import CIRCULAR


def _numbers(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in ("track_id", "seq") and t == "double"]


def _with_next(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *[F.lead(c).over(in_order()).alias(f"_n_{c}") for c in names], F.lead("seq").over(in_order()).alias("_n_seq"))


def _mix(names: list[str], share) -> list:
    return [F.when(share == 0, F.col(c)).otherwise(geo.interpolate(F.col(c), F.col(f"_n_{c}"), share, c in CIRCULAR)).alias(c) for c in names]


def one_hz(df: DataFrame, rederive: bool = True) -> DataFrame:
    """A point at every whole second of each track. Of two pieces that meet in a second the later one's
    point stays."""
    names = _numbers(df)
    d = _with_next(df, names).withColumn("_first", F.lag("seq").over(in_order()).isNull())
    e1 = F.floor(F.col("time") / 1000).cast("long")
    e2 = F.floor(F.col("_n_time") / 1000).cast("long")
    aligned = F.col("time") == e1 * 1000.0
    first = F.when(aligned, e1).otherwise(e1 + 1)
    empty = F.array().cast("array<bigint>")
    inner = F.when(e2.isNotNull() & (e1 != e2) & (first <= e2), F.sequence(first, F.greatest(e2, first))).otherwise(empty)
    last = F.when(F.col("_n_seq").isNull() & ~aligned, F.array(e1 + 1)).otherwise(empty)
    start = F.when(F.col("_first") & ~(aligned & e2.isNotNull() & (e1 != e2)), F.array(e1)).otherwise(empty)
    d = d.withColumn("_at", F.explode(F.concat(start, inner, last)))
    within = F.col("_n_time").isNotNull() & (F.col("_at") * 1000.0 >= F.col("time"))
    share = F.when(within & (F.col("_n_time") > F.col("time")), (F.col("_at") * 1000.0 - F.col("time")) / (F.col("_n_time") - F.col("time"))).otherwise(0.0)
    d = d.select("track_id", "seq", "_at", *_mix(names, share))
    latest = Window.partitionBy("track_id", "_at").orderBy(F.desc("seq"))
    d = d.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1")
    d = d.withColumn("time", F.col("_at") * 1000.0).withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy("_at")).cast("long") - 1).drop("_at", "_rank")
    return derive(d) if rederive else d


def densify(df: DataFrame, most: float, rederive: bool = True) -> DataFrame:
    """Cuts gaps longer than `most` metres into equal pieces; no point goes."""
    names = _numbers(df)
    d = _with_next(df, names)
    gap = F.col("_n_distance") - F.col("distance")
    pieces = F.when(gap > most, F.ceil(gap / most)).otherwise(1).cast("long")
    d = d.withColumn("_pieces", F.coalesce(pieces, F.lit(1).cast("long"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    d = d.select("track_id", "seq", "_j", *_mix(names, F.col("_j") / F.col("_pieces")))
    order = Window.partitionBy("track_id").orderBy("seq", "_j")
    d = d.withColumn("seq", F.row_number().over(order).cast("long") - 1).drop("_j")
    return derive(d) if rederive else d


def per_distance(df: DataFrame, least: float, most: float) -> DataFrame:
    """Thins and densifies in one pass; whether a point stays depends on the last that did."""
    return map_tracks(df, lambda t: kernels.per_distance(t, least, most))


def per_second(df: DataFrame) -> DataFrame:
    """one_hz for complete point tables, one call a track."""
    return map_tracks(df, kernels.per_second)


def stations(df: DataFrame, step: float, columns: tuple[str, ...] = ("latitude", "longitude", "elevation")) -> DataFrame:
    """track_id, k, s and the columns at every `step` metres, each taken from the piece whose start is the
    last point strictly before it. Each piece makes its own stations, so no join is needed."""
    d = df.select("track_id", "seq", "distance", *[c for c in columns if c != "distance"])
    names = ["distance", *[c for c in columns if c != "distance"]]
    d = _with_next(d, names).withColumn("_first", F.lag("seq").over(in_order()).isNull())
    a, b = F.col("distance"), F.col("_n_distance")
    lo = F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(F.floor(a / step).cast("long") + 1)
    hi = F.floor(b / step).cast("long")
    d = d.where(b.isNotNull()).where(hi >= lo).withColumn("k", F.explode(F.sequence(lo, F.greatest(hi, lo))))
    share = F.when(b > a, (F.col("k") * step - a) / (b - a)).otherwise(0.0)
    return d.select("track_id", "k", (F.col("k") * F.lit(float(step))).alias("s"), *[x for x in _mix(names, share)][1:])


def values_at(df: DataFrame, wanted: DataFrame, column: str = "elevation") -> DataFrame:
    """`wanted` (track_id, s) with the column's value there: an as-of join by one sort of both sides together."""
    points = df.select("track_id", F.col("distance").alias("s"), F.col(column).alias("v"), F.lit(1).alias("_side"), F.col("seq").alias("_seq"))
    asked = wanted.select("track_id", "s", F.lit(None).cast("double").alias("v"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_seq"))
    order = Window.partitionBy("track_id").orderBy("s", "_side", "_seq")
    # What follows is looked up from the end: a frame that grows takes linear time, one that shrinks does not.
    back = Window.partitionBy("track_id").orderBy(F.desc("s"), F.desc("_side"), F.desc("_seq"))
    known = F.when(F.col("_side") == 1, F.struct("s", "v"))
    u = points.unionByName(asked).withColumn("_a", F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    u = u.where("_side = 0")
    gap = F.col("_b.s") - F.col("_a.s")
    value = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).when(gap > 0, F.col("_a.v") + (F.col("s") - F.col("_a.s")) / gap * (F.col("_b.v") - F.col("_a.v"))).otherwise(F.col("_b.v"))
    return u.select("track_id", "s", value.alias(column))


def nearest(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (track_id, s, and more) snapped to the nearest point by distance, the earlier of two equally
    near, and of points at one distance the first: seq and distance of that point."""
    extra = [c for c in wanted.columns if c not in ("track_id", "s")]
    firsts = df.groupBy("track_id", "distance").agg(F.min("seq").alias("seq"))
    points = firsts.select("track_id", F.col("distance").alias("s"), F.struct("distance", "seq").alias("_p"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra])
    asked = wanted.select("track_id", "s", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"), *extra)
    order = Window.partitionBy("track_id").orderBy("s")
    back = Window.partitionBy("track_id").orderBy(F.desc("s"))
    u = points.withColumn("_w", F.lit(False)).unionByName(asked.withColumn("_w", F.lit(True)))
    u = u.withColumn("_a", F.last("_p", True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last("_p", True).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    u = u.where("_w")
    later = F.col("_a").isNull() | (F.col("_b.distance") - F.col("s") < F.col("s") - F.col("_a.distance"))
    pick = F.when(F.col("_b").isNotNull() & later, F.col("_b")).otherwise(F.col("_a"))
    return u.select("track_id", "s", *extra, pick["seq"].alias("seq"), pick["distance"].alias("distance"))


def decimate(df: DataFrame, stride: int) -> DataFrame:
    """Every stride-th point and the last."""
    last = F.lead("seq").over(in_order()).isNull()
    return df.withColumn("_last", last).where((F.col("seq") % stride == 0) | F.col("_last")).drop("_last")


def densified_bound(stats: DataFrame) -> DataFrame:
    """How many points the pipeline may make of each track, for admission and partition counts."""
    return stats.withColumn("point_bound", (F.col("n_points") + F.ceil(F.col("distance") / 30) + F.ceil(F.col("distance") / 2)).cast("long"))


def fill_linear(df: DataFrame, column: str, x: str = "seq") -> DataFrame:
    """NaN or null between known values is replaced along a line over x; ends take the nearest known value."""
    known = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.struct(F.col(x).cast("double").alias("x"), F.col(column).alias("v")))
    back = Window.partitionBy("track_id").orderBy(F.desc("seq"))
    d = df.withColumn("_a", F.last(known, True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("_b.x") - F.col("_a.x")
    line = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (gap == 0), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col(x) - F.col("_a.x")) / F.when(gap != 0, gap) * (F.col("_b.v") - F.col("_a.v")))
    return d.withColumn(column, line).drop("_a", "_b")


__all__ = ["decimate", "densified_bound", "densify", "fill_linear", "nearest", "one_hz", "per_distance", "per_second", "renumbered", "stations", "values_at"]
