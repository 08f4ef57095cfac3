"""The forces on a rider as Column expressions, in watts (what slows down is negative)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geo import d
from ridgeline.options import G, MIN_SPEED, Bike, Cyclist, Wind

# International standard atmosphere.
P0, T0, LAPSE, R_AIR = 101_325.0, 288.15, 0.0065, 287.05
RHO = 1.225
LATERAL = 1.2


def air_density(elevation: Column, temperature_c: Column) -> Column:
    """kg/m3 at a height and temperature; NaN or null: sea level and 15 degrees."""
    h = F.coalesce(F.nanvl(elevation, d(0)), d(0))
    t = F.coalesce(F.nanvl(temperature_c, d(15)), d(15)) + 273.15
    return P0 * F.pow(1 - LAPSE * h / T0, d(G / (R_AIR * LAPSE))) / (R_AIR * t)


def aero_coefficient(rho, cyclist: Cyclist = Cyclist()) -> Column:
    return cyclist.drag_coefficient * cyclist.frontal_area_m2 * d(rho) / 2


def aero_power(k: Column, v: Column) -> Column:
    return -k * v * v * v


def wind_alpha(bearing: Column, wind: Wind) -> Column:
    """Angle between the ride and the wind's own bearing (east 0, north -pi/2)."""
    return (math.pi / 2 - wind.direction_rad) - bearing


def aero_power_wind(k: Column, v: Column, alpha: Column, wind: Column) -> Column:
    along = v + wind * F.cos(alpha)
    total = v * v + wind * wind + 2 * v * wind * F.cos(alpha)
    share = F.when(total == 0, d(0)).otherwise(along * along / total)
    return -k * (share + LATERAL * (1 - share)) * F.sqrt(F.greatest(total, d(0))) * along * v


def gravity_power(v: Column, grade: Column, mass: float) -> Column:
    return -mass * G * v * F.sin(F.atan(grade))


def rolling_power(v: Column, grade: Column, mass: float, crr: float) -> Column:
    return -F.cos(F.atan(grade)) * mass * G * v * crr


def bearing_power(v: Column) -> Column:
    return -v * (91 + 8.7 * v) / 1000


def resistive_power(v: Column, grade: Column, k: Column, cyclist: Cyclist = Cyclist(), bike: Bike = Bike()) -> Column:
    return bearing_power(v) + rolling_power(v, grade, cyclist.mass_kg, bike.crr) + aero_power(k, v) + gravity_power(v, grade, cyclist.mass_kg)


def muscular_power(power: Column, v: Column, radius: Column, max_pedal_lean: float | None) -> Column:
    """The rider's power, 0 where the bike leans too far to pedal."""
    if max_pedal_lean is None:
        return power
    return F.when(v * v / (G * radius) > F.tan(F.radians(d(max_pedal_lean))), d(0)).otherwise(power)


def equivalent_mass(cyclist: Cyclist = Cyclist(), bike: Bike = Bike()) -> float:
    return cyclist.mass_kg + (bike.front_inertia + bike.rear_inertia) / bike.wheel_radius_m**2


def step_length(power: Column, mass, v: Column, dt: Column) -> Column:
    """How far a constant power carries in dt."""
    v2 = F.greatest(F.sqrt(F.greatest(d(0), v * v + 2 * dt * power / mass)), d(MIN_SPEED))
    return (v + v2) * dt / 2


def kinetic_power(mass, v1: Column, v2: Column, dt: Column) -> Column:
    return 0.5 * mass * (v2 * v2 - v1 * v1) / dt


def cornering_limit(radius: Column, cyclist: Cyclist = Cyclist(), saturated: float = 200.0) -> Column:
    top = d(cyclist.max_speed)
    return F.when(radius >= saturated, top).otherwise(F.least(top, F.sqrt(G * radius * cyclist.tan_lean)))


def optimal_power(needed: Column, optimal: Column, tolerance: float = 0.05, most: float = 3.0) -> Column:
    """The optimal power, raised up to `most` times where much less is needed and cut down to nothing where
    twice as much is."""
    low, high = optimal * (1 - tolerance), optimal * (1 + tolerance)
    cut = F.least(F.greatest((needed - high) / high, d(0)), d(1))
    return F.when(needed < low, optimal * most - needed / low * optimal * (most - 1)).when(needed > high, optimal * (1 - cut)).otherwise(optimal)
