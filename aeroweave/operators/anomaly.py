"""Anomalies of tracks: kinematic rules, rolling deviations, losses. One windowed pass yields all flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import turn_between
from ..functions.rules import category_by_limits, limit

# Severities in rising order.
SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def _order(key: str, tie: str) -> Window:
    return Window.partitionBy(key).orderBy("time_sec", tie)


def _event(kind: str, test: Column, confidence: float, severity: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity")))


def rule_anomalies(rows: DataFrame, tie: str = "obs_id") -> DataFrame:
    """track_id, time_sec, type, confidence, severity. ``rows``: track_id, time_sec, speed, heading, climb_rate, alt_geom, u.

    A track's limits are those of the category of its mean speed and mean altitude; tracks of one report have none.
    """
    whole, w = Window.partitionBy("track_id"), _order("track_id", tie)
    altitude = F.coalesce("alt_geom", "u")
    rows = rows.withColumns({"n": F.count("*").over(whole), "ms": F.coalesce(F.avg("speed").over(whole), F.lit(0.0)), "ma": F.coalesce(F.avg(altitude).over(whole), F.lit(0.0))})
    category = category_by_limits(F.col("ms"), F.col("ma"))
    dt = F.col("time_sec") - F.lag("time_sec").over(w)
    wide = F.lead("time_sec").over(w) - F.lag("time_sec").over(w)
    turn = turn_between(F.lead("heading").over(w), F.lag("heading").over(w))
    rows = rows.withColumns({"category": category, "dt": dt, "dv": F.abs(F.col("speed") - F.lag("speed").over(w)), "wide": wide, "turn": turn}).where("n >= 2")
    top, low, climb, sink, turn_rate, ceiling = (limit(F.col("category"), k) for k in range(6))
    speed, rate = F.col("speed"), F.col("climb_rate")
    events = F.array(
        _event("overspeed", speed > top, 1.0, "high"),
        _event("stall_speed", (speed > 0) & (speed < low) & ~(speed > top), 0.90, "medium"),
        _event("altitude_ceiling", altitude > ceiling, 1.0, "medium"),
        _event("excessive_climb", rate > climb, 1.0, "high"),
        _event("excessive_descent", (rate < -sink) & ~(rate > climb), 1.0, "high"),
        _event("excessive_turn", (F.col("wide") >= 2) & (F.col("turn") > turn_rate * F.col("wide")), 1.0, "high"),
        _event("impossible_accel", (F.col("dt") > 0) & (F.col("dv") > 30 * F.col("dt")), 1.0, "critical"),
    )
    return rows.select("track_id", "time_sec", F.explode(F.array_compact(events)).alias("e")).select("track_id", "time_sec", "e.type", "e.confidence", "e.severity")


def zscore_anomalies(rows: DataFrame, z: float = 3.0, half: int = 5, tie: str = "obs_id", columns: tuple[str, ...] = ("speed", "heading", "climb_rate", "u")) -> DataFrame:
    """Values more than ``z`` population deviations from the mean of the 2 * half + 1 rows around them."""
    w = _order("track_id", tie)
    around = w.rowsBetween(-half, half)
    rows = rows.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("track_id"))})
    for c in columns:
        rows = rows.withColumns({f"m_{c}": F.avg(c).over(around), f"s_{c}": F.stddev_pop(c).over(around), f"c_{c}": F.count(c).over(around)})
    inner = rows.where((F.col("n") >= 2 * half) & (F.col("k") > half) & (F.col("k") <= F.col("n") - half))
    events = []
    for c in columns:
        score = F.when((F.col(f"c_{c}") >= half) & (F.col(f"s_{c}") >= 1e-6), F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"))
        fields = F.struct(F.lit(f"statistical_deviation_{c}").alias("type"), F.least(score / 6, F.lit(0.99)).alias("confidence"), F.when(score < 4.5, "medium").otherwise("high").alias("severity"))
        events.append(F.when(score > z, fields))
    return inner.select("track_id", "time_sec", F.explode(F.array_compact(F.array(*events))).alias("e")).select("track_id", "time_sec", "e.type", "e.confidence", "e.severity")


def signal_loss(rows: DataFrame, gap_s: float = 60.0, tie: str = "obs_id") -> DataFrame:
    """Reports that come more than ``gap_s`` after the one before."""
    dt = F.col("time_sec") - F.lag("time_sec").over(_order("track_id", tie))
    found = rows.withColumn("dt", dt).where(F.col("dt") > gap_s)
    return found.select("track_id", "time_sec", F.lit("signal_loss").alias("type"), F.lit(0.85).alias("confidence"), F.when(F.col("dt") > 2 * gap_s, "high").otherwise("medium").alias("severity"))


def coop_dropout(fused: DataFrame) -> DataFrame:
    """Rows of fused tracks without a cooperative source right after a row with one."""
    w = Window.partitionBy("system_track_id").orderBy("time_sec")
    coop = F.col("sources").rlike("adsb|remote_id")
    found = fused.withColumns({"coop": coop, "was": F.lag(coop).over(w)}).where("was and not coop")
    return found.select(F.col("system_track_id").alias("track_id"), "time_sec", F.lit("cooperative_dropout").alias("type"), F.lit(0.80).alias("confidence"), F.lit("critical").alias("severity"))


def deduplicated(events: DataFrame) -> DataFrame:
    """The most severe event per track, type and second (half-even), then the earliest."""
    key = Window.partitionBy("track_id", "type", F.rint("time_sec")).orderBy(severity_rank(F.col("severity")).desc(), "time_sec", F.col("confidence").desc())
    return events.withColumn("k", F.row_number().over(key)).where("k = 1").drop("k")


def as_tracks(obs: DataFrame) -> DataFrame:
    return obs.withColumn("track_id", F.concat_ws(":", "source", "target_id"))


def all_anomalies(obs: DataFrame, fused: DataFrame) -> DataFrame:
    single = as_tracks(obs)
    joint = fused.select(F.col("system_track_id").alias("track_id"), "time_sec", "speed", "heading", F.lit(None).cast("double").alias("climb_rate"), F.lit(None).cast("double").alias("alt_geom"), "u", F.lit(0).cast("long").alias("obs_id"))
    out = coop_dropout(fused)
    for rows in (single, joint):
        for find in (rule_anomalies, zscore_anomalies, signal_loss):
            out = out.unionByName(find(rows))
    return deduplicated(out)
