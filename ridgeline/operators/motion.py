"""Forces, speed limits and the simulated ride."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import geo, kernels, physics
from ridgeline.operators.windows import in_order
from ridgeline.operators.tracks import add_columns, map_tracks
from ridgeline.options import Bike, Cyclist, PowerSpec, Wind


def forces(df: DataFrame, cyclist: Cyclist = Cyclist(), bike: Bike = Bike(), wind: Wind = Wind(), rho: str = "default") -> DataFrame:
    """Fills the aerodynamic coefficient, the four resisting powers and, if the wind blows, its columns."""
    density = F.lit(physics.RHO) if rho == "default" else physics.air_density(F.col("elevation"), F.col("temperature"))
    v, g = F.col("speed"), F.col("grade")
    d = df.withColumn("aeroCoef", physics.aero_coefficient(density, cyclist))
    k = F.col("aeroCoef")
    if wind.speed:
        d = d.withColumn("windSpeed", F.lit(wind.speed)).withColumn("windDirection", F.lit(wind.direction_rad)).withColumn("windBearing", F.lit(geo.PI / 2 - wind.direction_rad)).withColumn("windAlpha", physics.wind_alpha(F.col("bearing"), wind))
        aero = physics.aero_power_wind(k, v, F.col("windAlpha"), F.lit(wind.speed))
    else:
        aero = physics.aero_power(k, v)
    return d.withColumns({"pAero": aero, "pGravity": physics.gravity_power(v, g, cyclist.mass_kg), "pRollingResistance": physics.rolling_power(v, g, cyclist.mass_kg, bike.crr), "pWheelBearings": physics.bearing_power(v)})


def inverse_power(df: DataFrame, cyclist: Cyclist = Cyclist(), bike: Bike = Bike()) -> DataFrame:
    """The power that a recorded ride took, from its change of kinetic energy and the forces one point before."""
    m = physics.equivalent_mass(cyclist, bike)
    d = df if "pAero" in df.columns else forces(df, cyclist, bike)
    drag = F.lag(F.col("pAero") + F.col("pGravity") + F.col("pRollingResistance") + F.col("pWheelBearings")).over(in_order())
    idle = F.lag("seq").over(in_order()).isNull() | ~(F.col("dt") > 0)
    total = physics.kinetic_power(m, F.lag("speed").over(in_order()), F.col("speed"), F.when(F.col("dt") > 0, F.col("dt")))
    z = lambda x: F.when(idle, 0.0).otherwise(x)
    d = d.withColumn("pComputedTotalPower", z(total)).withColumn("pComputedWheelPower", z(total - drag))
    wheel = F.col("pComputedWheelPower")
    return d.withColumn("pBrake", F.least(F.lit(0.0), wheel)).withColumn("pComputedPower", F.greatest(F.lit(0.0), wheel) / bike.efficiency)


def windowed_radius(df: DataFrame, k: int = 10) -> DataFrame:
    """radius of the turn within k points each way, 5 to 200 m; a measured curvature has precedence."""
    turn = geo.normalize_angle(F.col("bearing") - F.lag("bearing").over(in_order()))
    span = in_order().rowsBetween(-k + 1, k)
    change = F.abs(F.coalesce(F.sum("_turn").over(span), F.lit(0.0)))
    way = F.last("distance").over(in_order().rowsBetween(0, k)) - F.first("distance").over(in_order().rowsBetween(-k, 0))
    window = F.when(change < 0.001, 200.0).otherwise(geo.clamp(way / F.when(change > 0, change), 5, 200))
    # The change into the window's first point belongs to the window before it.
    d = df.withColumn("_turn", F.coalesce(turn, F.lit(0.0)))
    if "trajectoryCurvature" in df.columns:
        measured = geo.clamp(1 / F.greatest(F.abs("trajectoryCurvature"), F.lit(1 / 200)), 5, 200)
        window = F.when(~F.isnan("trajectoryCurvature"), measured).otherwise(window)
    return d.withColumn("radius", window).drop("_turn")


def braking_pass(df: DataFrame, cyclist: Cyclist = Cyclist()) -> DataFrame:
    """speedMax from each track's end backwards, one call a track: what lets a rider brake to every later limit
    while grip is shared with the turn. Reads radius, speedMaxIncline and distance; the last is 2 m/s."""
    return add_columns(df, ["distance", "radius", "speedMaxIncline"], ["speedMax"], lambda t: {"speedMax": kernels.braking_limits(t["distance"], t["speedMaxIncline"], t["radius"], cyclist)})


def max_speeds(df: DataFrame, cyclist: Cyclist = Cyclist()) -> DataFrame:
    """Radius, cornering limit and braking limit of every point, one call a track (for long tracks)."""
    return map_tracks(df, lambda t: kernels.max_speeds(t, cyclist))


def virtualize(df: DataFrame, cyclist: Cyclist = Cyclist(), bike: Bike = Bike(), wind: Wind = Wind(), spec: PowerSpec = PowerSpec(), rho: str = "default") -> DataFrame:
    """The ride simulated forward, one call a track."""
    return map_tracks(df, lambda t: kernels.virtualize(t, cyclist, bike, wind, spec, rho))
