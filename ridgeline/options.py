"""Settings of all operators, immutable and checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

G = 9.80665
EARTH_RADIUS = 6_371_000.0
MIN_SPEED = 2 / 3.6


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Cyclist:
    mass_kg: float = 80.0
    power_w: float = 280.0
    max_brake_g: float = 0.4
    max_lean_deg: float = 35.0
    max_speed_kmh: float = 100.0
    drag_coefficient: float = 0.7
    frontal_area_m2: float = 0.5
    critical_power_w: float = 250.0
    w_prime_j: float = 20_000.0

    def __post_init__(self):
        for n in ("mass_kg", "power_w", "max_brake_g", "max_speed_kmh", "critical_power_w", "w_prime_j"):
            _need(math.isfinite(getattr(self, n)) and getattr(self, n) > 0, f"{n} must be positive")
        _need(0 < self.max_lean_deg < 90, "max_lean_deg must be between 0 and 90")

    @property
    def tan_lean(self) -> float:
        return math.tan(math.radians(self.max_lean_deg))

    @property
    def max_speed(self) -> float:
        return self.max_speed_kmh / 3.6


@dataclass(frozen=True)
class Bike:
    crr: float = 0.004
    front_inertia: float = 0.05
    rear_inertia: float = 0.07
    wheel_radius_m: float = 0.35
    efficiency: float = 0.976
    max_pedal_lean_deg: float | None = 20.0

    def __post_init__(self):
        _need(self.wheel_radius_m > 0, "wheel_radius_m must be positive")
        _need(0 < self.efficiency <= 1, "efficiency must be in (0, 1]")


#: Friction of dry and wet asphalt, and the braking at which a rider would pitch over.
MU_DRY, MU_WET, PITCH_OVER_G = 0.90, 0.36, 0.63


def for_road(cyclist: Cyclist, condition: str | None) -> Cyclist:
    """The rider with a road condition's lean and braking limits, which replace the rider's own: on a wet
    road, the default rider's share of the grip that is left. None changes nothing."""
    if condition is None:
        return cyclist
    _need(condition.lower() in ("dry", "wet"), f"unknown road condition {condition!r}")
    usual = Cyclist()
    if condition.lower() == "dry":
        return replace(cyclist, max_brake_g=usual.max_brake_g, max_lean_deg=usual.max_lean_deg)
    return replace(cyclist, max_brake_g=usual.max_brake_g / PITCH_OVER_G * MU_WET, max_lean_deg=math.degrees(math.atan(usual.tan_lean / MU_DRY * MU_WET)))


@dataclass(frozen=True)
class Wind:
    speed: float = 0.0
    direction_rad: float = 0.0


@dataclass(frozen=True)
class PowerSpec:
    """The rider's power model: constant, from_data, critical_power or durability; pacing and a slew limit
    wrap it, in this order."""

    model: str = "constant"
    pacing: bool = False
    slew_w_per_s: float | None = None
    harmonics: tuple[tuple[float, float, float], ...] = ()

    def __post_init__(self):
        _need(self.model in ("constant", "from_data", "critical_power", "durability"), f"unknown power model {self.model!r}")
        _need(self.slew_w_per_s is None or self.slew_w_per_s > 0, "slew_w_per_s must be positive")


#: Smallest counted change of height and smoothing half-width, in metres.
GAIN_PRESETS = {"raw": (0.0, 0.0), "barometric": (2.0, 15.0), "dem": (3.0, 30.0), "gps": (10.0, 50.0)}


@dataclass(frozen=True)
class GainOptions:
    threshold_m: float = 3.0
    window_m: float = 30.0

    def __post_init__(self):
        _need(self.threshold_m >= 0 and self.window_m >= 0, "threshold_m and window_m must be >= 0")

    @classmethod
    def preset(cls, name: str) -> GainOptions:
        _need(name.lower() in GAIN_PRESETS, f"unknown elevation gain preset {name!r}: expected one of {', '.join(GAIN_PRESETS)}")
        return cls(*GAIN_PRESETS[name.lower()])


@dataclass(frozen=True)
class CurvatureOptions:
    enabled: bool = True
    geometry_smooth_m: float = 3.0
    windows_m: tuple[float, ...] = (3.0, 6.0, 12.0, 25.0)
    heading_noise_rad: float = 0.05
    curvature_smooth_m: float = 3.0

    def __post_init__(self):
        _need(len(self.windows_m) > 0 and all(w > 0 for w in self.windows_m), "windows_m must hold positive numbers")


@dataclass(frozen=True)
class ClimbOptions:
    least_elevation_m: float = 10.0
    most_least_elevation_m: float = 35.0
    elevation_ratio: float = 100.0
    min_grade_percent: float = 3.0
    max_grade_ratio: float = 1.3
    booster: float = 1.3
    max_points: int = 3000


@dataclass(frozen=True)
class RacingLineOptions:
    enabled: bool = False
    default_width_m: float = 6.0
    edge_margin_m: float = 0.5
    corridor: str = "lane"
    enter_radius_m: float = 120.0
    exit_radius_m: float = 250.0
    min_length_m: float = 8.0
    min_turn_deg: float = 8.0
    hairpin_deg: float = 150.0
    gentle_radius_m: float = 100.0
    regularity: float = 0.85
    proximity_gap_m: float = 60.0
    straight_run_m: float = 150.0
    straight_radius_m: float = 500.0
    width_smooth_m: float = 20.0
    objective_radius_m: float = 200.0
    steering_length_m: float = 20.0
    centering_length_m: float = 60.0
    max_iterations: int = 200
    tolerance: float = 1e-8
    bound_epsilon_m: float = 1e-6
    simplify_cap_m: float = 2.0
    curvature: CurvatureOptions = field(default_factory=CurvatureOptions)

    def __post_init__(self):
        _need(self.corridor in ("lane", "lane-left", "full-road"), f"unknown corridor {self.corridor!r}")
        _need(self.exit_radius_m >= self.enter_radius_m, "exit_radius_m must be >= enter_radius_m")
        _need(self.edge_margin_m >= 0 and self.width_smooth_m >= 0, "margins must be >= 0")


@dataclass(frozen=True)
class DeckOptions:
    step_m: float = 5.0
    tall_m: float = 5.0
    min_tall_run_m: float = 15.0
    median_window_m: float = 25.0
    roughness_window_m: float = 35.0
    max_roughness_m: float = 0.8
    min_smooth_fraction: float = 0.6
    merge_gap_m: float = 300.0
    deck_height_m: float = 1.0
    slope_half_window_m: float = 10.0
    max_slope_p95: float = 0.10
    min_length_m: float = 30.0
    short_span_m: float = 25.0
    max_short_roughness_m: float = 0.4
    min_canyon_drop_m: float = 3.0
    deck_min_run_m: float = 40.0
    small_span_m: float = 60.0
    max_abutment_m: float = 100.0
    slope_on_clean: bool = True
    min_clean_fraction: float = 0.25
    min_clean_stations: int = 5
    ground_above_is_tall: bool = True
    ground_tolerance_m: float = 0.5
    clean_gap_ground_m: float = 1.0
    split_steep: bool = True

    def __post_init__(self):
        _need(self.step_m > 0, "step_m must be positive")
        for n in ("median_window_m", "roughness_window_m"):
            _need(self.stations(getattr(self, n)) % 2 == 1, f"{n} must be an odd number of steps")
        for n in ("min_tall_run_m", "slope_half_window_m", "deck_min_run_m"):
            _need(self.stations(getattr(self, n)) >= 1, f"{n} must be a step at least")
        for n in ("merge_gap_m", "short_span_m", "small_span_m", "max_abutment_m"):
            _need(self.stations(getattr(self, n)) >= 0, f"{n} must be >= 0")
        _need(self.min_clean_stations >= 2, "min_clean_stations must be >= 2")

    def stations(self, metres: float) -> int:
        n = round(metres / self.step_m)
        _need(abs(n * self.step_m - metres) < 1e-9, f"{metres} m is not a whole number of steps")
        return n

    @property
    def island(self) -> int:
        """Half of the median's window: how many missing stations in a row it can bridge."""
        return self.stations(self.median_window_m) // 2


@dataclass(frozen=True)
class TunnelOptions:
    step_m: float = 5.0
    foot_m: float = 20.0
    steep_m: float = 50.0
    max_road_grade: float = 0.20
    min_portal_grade: float = 0.25
    min_side_grade: float = 0.30
    side_search_m: float = 50.0
    max_chord_grade: float = 0.12
    min_height_m: float = 15.0
    face_reach_m: float = 100.0
    max_below_chord_m: float = 3.0
    min_valley_height_m: float = 15.0
    min_length_m: float = 50.0
    max_length_m: float = 3000.0
    min_straightness: float = 0.8


@dataclass(frozen=True)
class EnhanceOptions:
    fix_elevation: bool = False
    bridge_decks: bool = False
    tunnels: bool = False
    smooth: bool = True
    smooth_window_m: float = 150.0
    curvature: CurvatureOptions = field(default_factory=CurvatureOptions)
    racing_line: RacingLineOptions = field(default_factory=RacingLineOptions)
    max_speeds: bool = True
    virtualize: bool = True
    one_hz: bool = True
    w_prime: bool = True
    gain: GainOptions | None = field(default_factory=GainOptions)
    simplify: bool = True
    simplify_tolerance_m: float = 10.0
    simplify_z: float = 3.0

    def __post_init__(self):
        _need(self.smooth_window_m >= 0, "smooth_window_m must be >= 0")
        _need(self.simplify_tolerance_m >= 0, "simplify_tolerance_m must be >= 0")

    @property
    def on_terrain(self) -> bool:
        """Whether decks or tunnels are drawn from the terrain's own models."""
        return self.fix_elevation and (self.bridge_decks or self.tunnels)
