"""Scalar geometry as Column expressions: frames, distances, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M, METERS_PER_DEGREE, Origin


def enu(lat: Column, lon: Column, alt: Column, origin: Origin | None = None, at: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column, Column]:
    """Local east, north, up (m) of a position, about fixed coordinates or those of columns."""
    lat0, lon0, alt0 = at or tuple(map(F.lit, ((origin or Origin()).lat, (origin or Origin()).lon, (origin or Origin()).alt)))
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_RADIUS_M, alt - alt0


def wgs84(e: Column, n: Column, u: Column, origin: Origin = Origin()) -> tuple[Column, Column, Column]:
    """Latitude, longitude, altitude of a local position."""
    lat = F.lit(origin.lat) + F.degrees(n / EARTH_RADIUS_M)
    lon = F.lit(origin.lon) + F.degrees(e / (F.lit(EARTH_RADIUS_M) * F.cos(F.radians(F.lit(origin.lat)))))
    return lat, lon, u + F.lit(origin.alt)


def flat_enu(lat: Column, lon: Column, origin: Origin = Origin()) -> tuple[Column, Column]:
    """East and north with a constant number of meters a degree, as the occupancy grid takes them."""
    return (lon - origin.lon) * METERS_PER_DEGREE * F.cos(F.radians(F.lit(origin.lat))), (lat - origin.lat) * METERS_PER_DEGREE


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def polar_to_enu(distance: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """From range (m), azimuth from north and elevation (degrees)."""
    flat = distance * F.cos(F.radians(elevation))
    return flat * F.sin(F.radians(azimuth)), flat * F.cos(F.radians(azimuth)), distance * F.sin(F.radians(elevation))


def velocity(speed: Column, heading: Column) -> tuple[Column, Column]:
    """East and north parts of a speed on a heading."""
    return speed * F.sin(F.radians(heading)), speed * F.cos(F.radians(heading))


def heading_of(ve: Column, vn: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(ve, vn)), F.lit(360.0))


def turn_between(h1: Column, h2: Column) -> Column:
    """The smaller angle between two headings."""
    d = F.abs(h1 - h2)
    return F.least(d, 360.0 - d)


def distance2(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    return F.sqrt((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2))


def seconds_of_day(text: Column) -> Column:
    """``HH:MM:SS[.f]``, else ``MM:SS[.f]``, else a number of seconds, else null."""
    hms, ms = r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$", r"^(\d+):(\d{2}(?:\.\d+)?)$"
    trimmed = F.trim(text)

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(trimmed, pattern, k).try_cast("double")

    return F.coalesce(part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3), part(ms, 1) * 60 + part(ms, 2), trimmed.try_cast("double"))
