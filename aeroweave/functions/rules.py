"""Scalar rules as Column expressions: categories, limits, names, evidence masses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ACCURACY, CONSUMER_NAMES, DEFAULT_RELIABILITY, DEFAULT_SIGMA, INDUSTRIAL_NAMES, LIMITS, POSITION_SIGMA, RELIABILITY, UAV_BANDS_MHZ


def by_key(key: Column, values: dict[str, float], default: float | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, v in values.items():
        out = out.when(key == k, F.lit(float(v)))
    return out if default is None else out.otherwise(F.lit(float(default)))


def sigma(source: Column, part: int) -> Column:
    return by_key(source, {k: v[part] for k, v in ACCURACY.items()}, ACCURACY["radar"][part])


def reliability(source: Column) -> Column:
    return by_key(source, RELIABILITY, DEFAULT_RELIABILITY)


def position_sigma(source: Column) -> Column:
    return by_key(source, POSITION_SIGMA, DEFAULT_SIGMA)


def limit(category: Column, part: int) -> Column:
    return by_key(category, {k: v[part] for k, v in LIMITS.items()}, LIMITS["unknown"][part])


def category_by_limits(speed: Column, altitude: Column) -> Column:
    return (
        F.when((altitude > 1000) | (speed > 80), "ga")
        .when((speed < 25) & (altitude < 300), "uav_consumer")
        .when(altitude < 800, "uav_industrial")
        .otherwise("unknown")
    )


def model_category(text: Column) -> Column:
    low = F.lower(text)

    def has(names: tuple[str, ...]) -> Column:
        return low.rlike("|".join(names))

    return F.when(has(CONSUMER_NAMES), "uav_consumer").when(has(INDUSTRIAL_NAMES), "uav_industrial").otherwise("uav_unknown")


def in_uav_band(mhz: Column) -> Column:
    out = F.lit(False)
    for low, high in UAV_BANDS_MHZ:
        out = out | mhz.between(low, high)
    return out


def adaptive_window(speed: Column) -> Column:
    return F.greatest(F.lit(120.0), F.least(F.lit(180.0), 5.0 / F.when(speed > 0, speed).otherwise(10.0)))


def mass_from_detection(rel: Column, quality: Column, detected: Column) -> Column:
    """Evidence that a target is real (r), false (f), or either (t)."""
    w = rel * F.greatest(F.lit(0.1), F.least(F.lit(1.0), quality))
    r = F.when(detected, 0.85 * w).otherwise(0.1 * w)
    f = F.when(detected, 0.05 * (1 - w)).otherwise(0.6 * w)
    return F.struct(r.alias("r"), f.alias("f"), (1 - r - f).alias("t"))


def mass_from_position(rel: Column, error_m: Column, sigma_m: Column) -> Column:
    doubt = 1 / (1 + F.exp(-0.8 * (error_m / sigma_m - 3)))
    r, f = 0.8 * rel * (1 - doubt), 0.7 * doubt
    t = F.greatest(F.lit(0.0), 1 - r - f)
    total = r + f + t
    return F.struct((r / total).alias("r"), (f / total).alias("f"), (t / total).alias("t"))


def mass_from_coverage(seen: Column, of: Column, quality: Column) -> Column:
    share = seen / F.greatest(of, F.lit(1))
    r, f = 0.9 * share * quality, 0.2 * (1 - share)
    return F.struct(r.alias("r"), f.alias("f"), F.greatest(F.lit(0.0), 1 - r - f).alias("t"))


def dempster(a: Column, b: Column) -> Column:
    """Combined mass with its conflict k; not normalized if the conflict is total."""
    k = a["r"] * b["f"] + a["f"] * b["r"]
    left = F.when(k < 1, 1 - k).otherwise(1.0)
    r = (a["r"] * b["r"] + a["r"] * b["t"] + a["t"] * b["r"]) / left
    f = (a["f"] * b["f"] + a["f"] * b["t"] + a["t"] * b["f"]) / left
    return F.struct(r.alias("r"), f.alias("f"), (a["t"] * b["t"] / left).alias("t"), k.alias("k"))
