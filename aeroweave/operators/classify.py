"""Target classes from spectrum labels and kinematics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import model_category


def spectrum_labels(obs: DataFrame) -> DataFrame:
    """target_id, label: category of the most frequent model text (ties: the first in order of text)."""
    counts = obs.where("source = 'spectrum' and uav_model_text is not null").groupBy("target_id", "uav_model_text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("target_id").orderBy(F.col("n").desc(), "uav_model_text")
    best = counts.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("target_id", model_category(F.col("uav_model_text")).alias("label"))


def kinematics(rows: DataFrame, keys: list[str]) -> DataFrame:
    altitude = F.coalesce("alt_geom", "u") if "alt_geom" in rows.columns else F.col("u")
    return rows.groupBy(*keys).agg(F.avg(altitude).alias("mean_alt"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.count("*").alias("n"))


def decide(stats: DataFrame) -> DataFrame:
    """Adds category, confidence, reason. ``stats``: source (null: fused), label, mean_alt, mean_speed, max_speed."""
    known = F.col("mean_speed").isNotNull() & F.col("mean_alt").isNotNull()
    rules = (
        (F.col("label").isNotNull(), F.col("label"), 0.95, "spectrum label"),
        ((F.col("source") == "adsb") & (F.col("max_speed") > 80), F.lit("ga"), 0.90, "fast cooperative aircraft"),
        ((F.col("source") == "remote_id") & (F.col("mean_alt") < 120), F.lit("uav_consumer"), 0.85, "remote id, low"),
        (F.col("source") == "remote_id", F.lit("uav_industrial"), 0.80, "remote id"),
        (known & ((F.col("mean_speed") > 50) | (F.col("mean_alt") > 600)), F.lit("ga"), 0.70, "fast or high"),
        (known, F.lit("uav_consumer"), 0.70, "slow and low"),
        (F.lit(True), F.lit("unknown"), 0.0, "no kinematics"),
    )
    category = confidence = reason = None
    for test, cat, conf, why in rules:
        test = F.coalesce(test, F.lit(False))
        category = F.when(test, cat) if category is None else category.when(test, cat)
        confidence = F.when(test, conf) if confidence is None else confidence.when(test, conf)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return stats.withColumns({"category": category, "confidence": confidence, "reason": reason})


def classify(obs: DataFrame, fused: DataFrame) -> DataFrame:
    """Every single-source track and every fused track: track_id, source, original_tid, category, confidence, reason."""
    labels = spectrum_labels(obs)
    single = kinematics(obs, ["source", "target_id"]).join(labels, "target_id", "left")
    single = decide(single).select(F.concat_ws(":", "source", "target_id").alias("track_id"), "source", F.col("target_id").alias("original_tid"), "category", "confidence", "reason")
    joint = kinematics(fused, ["system_track_id"]).withColumns({"source": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})
    sure = F.round(F.least(F.col("confidence") + 0.05, F.lit(0.99)), 4)
    joint = decide(joint).select(F.col("system_track_id").alias("track_id"), F.lit("fused").alias("source"), F.col("system_track_id").alias("original_tid"), "category", sure.alias("confidence"), "reason")
    return single.unionByName(joint)
