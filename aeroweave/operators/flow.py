"""Traffic flow: counts over time and space, corridors of dense cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import heading_of
from .graph import components


def temporal_flow(obs: DataFrame, bin_s: float = 60.0) -> DataFrame:
    """Per time bin: active targets over all sources, reports, mean altitude."""
    start = (F.col("time_sec") / bin_s).cast("long") * bin_s
    altitude = F.coalesce("alt_geom", "u")
    return obs.groupBy(start.alias("time_sec")).agg(F.count_distinct("target_id").alias("active_targets"), F.count("*").alias("total_reports"), F.avg(altitude).alias("avg_altitude"))


def heatmap(obs: DataFrame, cell_m: float = 500.0, ref_e: float = 0.0, ref_n: float = 0.0) -> DataFrame:
    """Reports per cell, with its center and mean height."""
    gx, gy = F.floor((F.col("e") - ref_e) / cell_m), F.floor((F.col("n") - ref_n) / cell_m)
    cells = obs.dropna(subset=["e", "n"]).groupBy(gx.alias("grid_x"), gy.alias("grid_y")).agg(F.count("*").alias("count"), F.avg("u").alias("avg_u"))
    return cells.select("grid_x", "grid_y", ((F.col("grid_x") + 0.5) * cell_m + ref_e).alias("center_e"), ((F.col("grid_y") + 0.5) * cell_m + ref_n).alias("center_n"), "count", "avg_u")


def corridors(cells: DataFrame, density: int = 5, least: int = 3) -> DataFrame:
    """Components of 4-neighbouring dense cells, of ``least`` cells or more."""
    shift = 1 << 30
    key = (F.col("grid_x") + shift) * F.lit(1 << 32) + (F.col("grid_y") + shift)
    dense = cells.where(F.col("count") >= density).withColumn("id", key)
    right = dense.select("id", (key + F.lit(1 << 32)).alias("nb"))
    up = dense.select("id", (key + 1).alias("nb"))
    ids = dense.select(F.col("id").alias("nb"))
    edges = right.unionByName(up).join(ids, "nb").select(F.col("id").alias("a"), F.col("nb").alias("b"))
    members = dense.join(components(edges), "id")
    place = F.struct("center_e", "center_n")
    grown = members.groupBy("component").agg(
        F.count("*").alias("cell_count"), F.sum("count").alias("total_points"), F.avg("center_e").alias("center_e"), F.avg("center_n").alias("center_n"), F.min(place).alias("west"), F.max(place).alias("east")
    )
    de, dn = F.col("east.center_e") - F.col("west.center_e"), F.col("east.center_n") - F.col("west.center_n")
    return grown.where(F.col("cell_count") >= least).select("cell_count", "total_points", "center_e", "center_n", F.round(heading_of(de, dn), 1).alias("direction_deg"), F.round(F.sqrt(de * de + dn * dn), 1).alias("length_m"))


def flow_report(flow: DataFrame, cells: DataFrame, corridor_rows: DataFrame) -> DataFrame:
    """One row: span, peak and its first time, total reports, hotspots (cells at or above the 95th percentile)."""
    time = flow.agg(
        (F.max("time_sec") - F.min("time_sec")).alias("time_span_sec"),
        F.max("active_targets").alias("peak_targets"),
        F.max_by("time_sec", F.struct("active_targets", -F.col("time_sec"))).alias("peak_time_sec"),
        F.sum("total_reports").alias("total_reports"),
    )
    edge = cells.agg(F.percentile("count", 0.95).alias("edge"))
    hot = cells.crossJoin(F.broadcast(edge)).agg(F.count_if(F.col("count") >= F.col("edge")).alias("hotspot_count"))  # one row each
    return time.crossJoin(hot).crossJoin(corridor_rows.agg(F.count("*").alias("corridor_count")))
