"""Conflicts between fused tracks and intrusions into zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Conflict, Zone
from ..functions.geo import haversine, velocity


def states(fused: DataFrame, frame_s: float) -> DataFrame:
    """The last row of each track in each time frame, with its velocity (unknown: 0, level)."""
    frame = F.rint(F.col("time_sec") / frame_s) * frame_s
    last = Window.partitionBy("frame", "system_track_id").orderBy(F.col("time_sec").desc())
    rows = fused.withColumn("frame", frame).withColumn("k", F.row_number().over(last)).where("k = 1 and e is not null and n is not null and u is not null")
    ve, vn = velocity(F.coalesce("speed", F.lit(0.0)), F.coalesce("heading", F.lit(0.0)))
    return rows.select("frame", F.col("system_track_id").alias("track"), "e", "n", "u", ve.alias("ve"), vn.alias("vn"))


def conflicts(fused: DataFrame, c: Conflict = Conflict()) -> DataFrame:
    """time_sec, track_a, track_b, dcpa_m, tcpa_s, rel_speed_ms, potential_risk, level, severity, advice_turn_deg.

    Only pairs that can reach a level are joined: caution needs a risk over 0.5, which ends at 1262 m, and the
    other levels need a closest approach under the warning distance within the warning time. So tracks meet
    by frame and by cells of that reach at the highest speed there is.
    """
    rows = states(fused, c.frame_s)
    top = rows.agg(F.max(F.sqrt(F.col("ve") * F.col("ve") + F.col("vn") * F.col("vn")))).first()[0] or 0.0
    caution = 1262.02 * c.radius_m / 2000.0
    cell = max(caution, c.warning_m + 2 * c.warning_s * top)
    place = {"cx": F.floor(F.col("e") / cell), "cy": F.floor(F.col("n") / cell)}
    a = rows.withColumns(place).select("frame", "cx", "cy", *[F.col(x).alias(f"{x}1") for x in ("track", "e", "n", "u", "ve", "vn")])
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = rows.withColumns(place).withColumn("d", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j")})
    b = b.select("frame", "cx", "cy", *[F.col(x).alias(f"{x}2") for x in ("track", "e", "n", "u", "ve", "vn")])
    pairs = a.join(b, ["frame", "cx", "cy"]).where("track1 < track2")
    de, dn, du = (F.col(f"{x}2") - F.col(f"{x}1") for x in "enu")
    we, wn = F.col("ve2") - F.col("ve1"), F.col("vn2") - F.col("vn1")
    pairs = pairs.withColumns({"de": de, "dn": dn, "du": du, "we": we, "wn": wn})
    dist = F.sqrt(F.expr("de * de + dn * dn + du * du"))
    rel = F.sqrt(F.expr("we * we + wn * wn"))
    pairs = pairs.withColumns({"dist": dist, "rel": rel, "dot": F.expr("de * we + dn * wn")})
    pairs = pairs.where(F.col("dist") <= F.greatest(F.lit(caution), c.warning_m + c.warning_s * F.col("rel")))
    return _levels(pairs, c)


def _levels(pairs: DataFrame, c: Conflict) -> DataFrame:
    dist, rel, dot = F.col("dist"), F.col("rel"), F.col("dot")
    slow = rel < 1
    t = F.when(~slow, -dot / (rel * rel))
    at = F.sqrt(F.pow(F.col("de") + F.col("we") * t, 2) + F.pow(F.col("dn") + F.col("wn") * t, 2) + F.pow(F.col("du"), 2))
    dcpa = F.when(slow | (t < 0), dist).otherwise(at)
    tcpa = F.when(slow & (dist > 500), None).when(slow | (t < 0), 0.0).otherwise(t)
    sigma = c.radius_m / 3
    cos = F.when((rel > 1e-3) & (dist > 1e-3), dot / (rel * dist)).otherwise(0.0)
    base = F.exp(-(dist * dist) / (2 * sigma * sigma)) * F.greatest(F.lit(0.1), 1 - c.speed_factor * cos)
    risk = F.when(dist > 2 * c.radius_m, 0.0).otherwise(F.least(base, F.lit(1.0)))
    rows = pairs.withColumns({"dcpa": dcpa, "tcpa": tcpa, "risk": risk}).where(~((F.col("rel") < 5) & (F.col("dist") < 1000)))
    critical = (F.col("dcpa") < c.critical_m) & (F.col("tcpa") < c.critical_s)
    warning = (F.col("dcpa") < c.warning_m) & (F.col("tcpa") < c.warning_s)
    level = F.when(critical, "critical").when(warning, "warning").when(F.col("risk") > 0.5, "caution")
    severity = F.when(F.col("level") == "critical", "critical").when(F.col("level") == "warning", "high").otherwise("medium")
    advice = F.when(F.col("risk") >= 0.3, F.round(30 + 30 * F.col("risk"), 1))
    return (
        rows.withColumn("level", level)
        .where("level is not null")
        .select(
            F.col("frame").alias("time_sec"),
            F.col("track1").alias("track_a"),
            F.col("track2").alias("track_b"),
            F.round("dcpa", 1).alias("dcpa_m"),
            F.round("tcpa", 1).alias("tcpa_s"),
            F.round("rel", 2).alias("rel_speed_ms"),
            F.round("risk", 3).alias("potential_risk"),
            "level",
            severity.alias("severity"),
            advice.alias("advice_turn_deg"),
        )
    )


def geofence(obs: DataFrame, zones: tuple[Zone, ...], sources: tuple[str, ...] = ("adsb", "radar")) -> DataFrame:
    """Reports inside a zone's circle and altitudes. The zones are literals of the plan: no join."""
    altitude = F.coalesce("alt_geom", "u")

    def entry(z: Zone) -> Column:
        d = haversine(F.col("lat"), F.col("lon"), F.lit(z.lat), F.lit(z.lon))
        inside = (d < z.radius_m) & altitude.between(z.alt_min_m, z.alt_max_m)
        return F.when(inside, F.struct(F.lit(z.name).alias("fence_name"), F.round(d, 1).alias("distance_to_center_m")))

    found = obs.where(F.col("source").isin(*sources)).select("time_sec", "obs_id", F.concat_ws(":", "source", "target_id").alias("track_id"), F.explode(F.array_compact(F.array(*map(entry, zones)))).alias("z"))
    return found.select("time_sec", "track_id", F.lit("geofence_intrusion").alias("type"), "z.fence_name", "z.distance_to_center_m", F.lit("critical").alias("level"), F.lit("critical").alias("severity"), F.format_string("inside %s", F.col("z.fence_name")).alias("description"))
