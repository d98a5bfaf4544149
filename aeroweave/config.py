"""Thresholds of all operators. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111320.0

SOURCES = ("adsb", "remote_id", "radar", "spectrum")

# Standard deviations of a source's position, altitude and velocity (m, m, m/s).
ACCURACY = {
    "adsb": (10.0, 15.0, 1.0),
    "remote_id": (30.0, 30.0, 2.0),
    "radar": (50.0, 80.0, 3.0),
    "spectrum": (200.0, 500.0, 10.0),
}

# A source's reliability as evidence, and its position error scale (m).
RELIABILITY = {"adsb": 0.92, "remote_id": 0.85, "radar": 0.72, "spectrum": 0.50}
POSITION_SIGMA = {"adsb": 10.0, "remote_id": 30.0, "radar": 50.0, "spectrum": 200.0}
DEFAULT_RELIABILITY, DEFAULT_SIGMA = 0.6, 50.0

# Kinematic limits by category: speed up to, speed from, climb, descent, turn rate, altitude.
LIMITS = {
    "ga": (150.0, 30.0, 15.0, 20.0, 15.0, 6000.0),
    "uav_consumer": (25.0, 0.0, 8.0, 6.0, 60.0, 500.0),
    "uav_industrial": (40.0, 0.0, 10.0, 8.0, 45.0, 1000.0),
    "unknown": (300.0, 0.0, 50.0, 50.0, 180.0, 10000.0),
}

# Drone control bands (MHz, closed ranges).
UAV_BANDS_MHZ = ((2400.0, 2483.0), (5725.0, 5850.0), (900.0, 930.0), (1427.0, 1518.0), (5030.0, 5091.0))

# Parts of model names.
CONSUMER_NAMES = ("mini", "air", "fpv", "tello", "spark")
INDUSTRIAL_NAMES = ("m300", "m350", "m30", "t40", "t50", "industry", "enterprise")


@dataclass(frozen=True)
class Origin:
    lat: float = 30.45
    lon: float = 114.0
    alt: float = 0.0


@dataclass(frozen=True)
class Zone:
    name: str
    lon: float
    lat: float
    radius_m: float
    alt_min_m: float
    alt_max_m: float


@dataclass(frozen=True)
class Association:
    min_rows: int = 5
    coarse_slack_s: float = 180.0
    coarse_m: float = 300.0
    coarse_close_m: float = 200.0
    max_gap_s: float = 60.0
    max_fine_m: float = 500.0
    max_distance_m: float = 800.0
    max_speed_diff: float = 50.0
    max_heading_diff: float = 90.0
    max_altitude_diff: float = 500.0
    confirmed: float = 0.85
    suspected: float = 0.60


@dataclass(frozen=True)
class Maintenance:
    min_rows: int = 3
    min_gap_s: float = 0.5
    max_gap_s: float = 30.0
    gate_m: float = 150.0
    max_speed_ratio: float = 0.4
    max_heading_diff: float = 45.0
    confirmed: float = 0.7


@dataclass(frozen=True)
class Conflict:
    frame_s: float = 2.0
    warning_m: float = 500.0
    critical_m: float = 200.0
    warning_s: float = 60.0
    critical_s: float = 20.0
    radius_m: float = 2000.0
    speed_factor: float = 2.0


@dataclass(frozen=True)
class Network:
    cell_m: float = 500.0
    separation_m: float = 100.0
    safety: float = 0.6
    window_s: float = 60.0


@dataclass(frozen=True)
class Occupancy:
    cell_m: float = 200.0
    extent_m: float = 8000.0
    range_m: float = 5000.0
    ring_m: float = 2500.0
    ring_sigma_m: float = 1500.0
    confidence: float = 0.62
    window_s: float = 5.0
    clip: float = 4.0
    false_alarm_s: float = 10.0

    @property
    def cells(self) -> int:
        return int(2 * self.extent_m / self.cell_m)
