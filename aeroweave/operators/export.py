"""Final products: target list, unified trajectories, summaries, samples for display, files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Origin
from ..functions.geo import wgs84
from .anomaly import SEVERITIES, severity_rank


def target_list(fused: DataFrame, classes: DataFrame, anomalies: DataFrame, origin: Origin = Origin()) -> DataFrame:
    """One row a system track: span, sources, mean place, speeds, class, anomalies and the worst severity."""
    rolled = fused.groupBy("system_track_id").agg(
        F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"), F.count("*").alias("n_points"), F.avg("e").alias("e"), F.avg("n").alias("n"), F.avg("u").alias("avg_u"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("sources", ","))))), "|").alias("sources"),
    )
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col("severity"))))
    seen = anomalies.groupBy(F.col("track_id").alias("system_track_id")).agg(F.count("*").alias("anomaly_count"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("anomaly_types"), worst.alias("max_severity"))
    kinds = classes.where("source = 'fused'").select(F.col("track_id").alias("system_track_id"), "category", "confidence")
    rows = rolled.join(kinds, "system_track_id", "left").join(seen, "system_track_id", "left")
    lat, lon, _ = wgs84(F.col("e"), F.col("n"), F.col("avg_u"), origin)
    return rows.select(
        "system_track_id", F.round("start_sec", 2).alias("start_sec"), F.round("end_sec", 2).alias("end_sec"), F.round(F.col("end_sec") - F.col("start_sec"), 2).alias("duration_sec"), "n_points", "sources",
        F.round(lat, 6).alias("avg_lat"), F.round(lon, 6).alias("avg_lon"), F.round("avg_u", 2).alias("avg_alt_m"), F.round("avg_speed", 2).alias("avg_speed_ms"), F.round("max_speed", 2).alias("max_speed_ms"),
        F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("anomaly_count", F.lit(0).cast("long")).alias("anomaly_count"), F.coalesce("anomaly_types", F.lit("")).alias("anomaly_types"), F.coalesce("max_severity", F.lit("none")).alias("max_severity"),
    )


def unified_trajectory(obs: DataFrame, classes: DataFrame) -> DataFrame:
    """Positional reports of all sources but spectrum, with each track's class; sort by (source, target_id, time)."""
    kinds = classes.where("source != 'fused'").select("source", F.col("original_tid").alias("target_id"), "category")
    rows = obs.where("source != 'spectrum'").dropna(subset=["time_sec", "lat", "lon"]).join(kinds, ["source", "target_id"], "left")
    return rows.select("source", "target_id", F.round("time_sec", 2).alias("time_sec"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round(F.coalesce("alt_geom", "u"), 2).alias("alt_m"), F.round("speed", 2).alias("speed_ms"), F.round("heading", 2).alias("heading_deg"), F.coalesce("category", F.lit("unknown")).alias("category"), "target_type")


def result_summary(classes: DataFrame, anomalies: DataFrame, conflicts: DataFrame) -> DataFrame:
    """section, name, count: classes, anomaly types and severities, conflict levels."""

    def counts(rows: DataFrame, section: str, column: str) -> DataFrame:
        return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).select(F.lit(section).alias("section"), "name", "count")

    out = counts(classes, "category", "category")
    for rows, section, column in ((anomalies, "anomaly_type", "type"), (anomalies, "anomaly_severity", "severity"), (conflicts, "conflict_level", "level")):
        out = out.unionByName(counts(rows, section, column))
    return out


def dashboard(obs: DataFrame) -> DataFrame:
    """Per source: reports, targets, span."""
    return obs.groupBy("source").agg(F.count("*").alias("reports"), F.count_distinct("target_id").alias("targets"), F.round(F.max("time_sec") - F.min("time_sec"), 2).alias("span_sec"))


def sampled_tracks(obs: DataFrame, tracks: int = 50, points: int = 100) -> DataFrame:
    """The first points of the first tracks of each source, as a map shows them."""
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy("target_id"))
    row = F.row_number().over(Window.partitionBy("source", "target_id").orderBy("time_sec", "obs_id"))
    rows = obs.dropna(subset=["lat", "lon"]).withColumns({"r": rank, "k": row}).where((F.col("r") <= tracks) & (F.col("k") <= points))
    return rows.select("source", "target_id", F.col("k").alias("point"), F.round("time_sec", 2).alias("time_sec"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def top_events(events: DataFrame, first: int = 200) -> DataFrame:
    return events.orderBy("time_sec", "track_id", "type").limit(first)


def geojson_lines(sample: DataFrame) -> DataFrame:
    """source, target_id, feature: a GeoJSON LineString of each sampled track."""
    point = F.struct("point", F.array("lon", "lat").alias("at"))
    lines = sample.groupBy("source", "target_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["at"]).alias("at"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("at").alias("coordinates")).alias("geometry"), F.struct("source", "target_id").alias("properties"))
    return lines.select("source", "target_id", F.to_json(feature).alias("feature"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; whoever needs a single file of a small result coalesces it first."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (a few rows) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def as_json(df: DataFrame, rows: int = 1000) -> str:
    """At most ``rows`` rows as indented JSON text."""
    return json.dumps([r.asDict(recursive=True) for r in df.limit(rows).collect()], indent=2, ensure_ascii=False, default=str)


def top_types(events: DataFrame, top: int = 10) -> DataFrame:
    """type, events: the most frequent types of events."""
    return events.groupBy("type").agg(F.count("*").alias("events")).orderBy(F.col("events").desc(), "type").limit(top)


def time_histogram(events: DataFrame, bins: int = 29) -> DataFrame:
    """severity, bin (from 0), from_sec, events: events in equal stretches of the time they cover; the last
    stretch holds its end."""
    span = events.agg(F.min("time_sec").alias("t0"), F.max("time_sec").alias("t1"))
    width = (F.col("t1") - F.col("t0")) / bins
    rows = events.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("time_sec") - F.col("t0"), width)), F.lit(0))).cast("int"))  # one row
    return rows.groupBy("severity", "bin").agg(F.first(F.col("t0") + F.col("bin") * width).alias("from_sec"), F.count("*").alias("events"))
