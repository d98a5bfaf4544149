"""Radio-spectrum occupancy grid and false-alarm filter.

All evidence is non-negative, so the order of updates does not matter: equal events are counted first, each
distinct set of sensors meets the grid's cells once, and the sums are clipped at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Occupancy
from ..functions.geo import distance2
from ..functions.rules import in_uav_band
from .graph import cut


def events(obs: DataFrame, p: Occupancy = Occupancy()) -> DataFrame:
    """target_id, window, sensors (distinct positions, in order): detections of a target in a time window."""
    rows = obs.where("source = 'spectrum' and sensor_id is not null and target_id is not null")
    start = rows.agg(F.min("time_sec").alias("t0"))
    window = F.floor((F.col("time_sec") - F.col("t0")) / p.window_s)
    place = F.struct("sensor_id", "e", "n")
    return rows.crossJoin(F.broadcast(start)).groupBy("target_id", window.alias("window")).agg(F.array_sort(F.collect_set(place)).alias("sensors"))  # start: one row



def _index(x: Column, p: Occupancy) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(p.cells - 1), ((x + p.extent_m) / p.cell_m).cast("int")))


def _center(i: Column, p: Occupancy) -> Column:
    return i * p.cell_m - p.extent_m + p.cell_m / 2


def grid(found: DataFrame, p: Occupancy = Occupancy()) -> DataFrame:
    """row, col, log_odds, detection_count, probability of the cells that some event touched.

    A single station raises a ring around it; several raise a hill at their mean. A set of sensors touches a
    bounded number of cells, so the rows grow with the distinct sets, not with the detections.
    """
    sets = found.groupBy("sensors").agg(F.count("*").alias("events")).withColumn("k", F.size("sensors"))

    def mean_of(c: str) -> Column:
        return F.aggregate("sensors", F.lit(0.0), lambda a, s: a + s[c]) / F.col("k")

    sets = sets.withColumns({"ce": mean_of("e"), "cn": mean_of("n")})
    many = F.least(F.col("k"), F.lit(4))
    spread = F.greatest(F.lit(500.0), p.range_m / (0.5 * F.col("k")))
    reach = F.when(F.col("k") == 1, F.lit(int(p.range_m / p.cell_m))).otherwise((3 * spread / p.cell_m).cast("int"))
    sets = sets.withColumns({"ci": _index(F.col("ce"), p), "cj": _index(F.col("cn"), p), "reach": reach, "spread": spread, "many": many})

    def span(c: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("reach")), F.least(F.lit(p.cells - 1), F.col(c) + F.col("reach"))))

    cells = sets.withColumn("col", span("ci")).withColumn("row", span("cj"))
    d = distance2(_center(F.col("col"), p), _center(F.col("row"), p), F.col("ce"), F.col("cn"))
    cells = cells.withColumn("d", d)
    ring = F.log(F.lit(p.confidence) / (F.lit(1 - p.confidence + 1e-10))) * F.exp(-0.5 * F.pow((F.col("d") - p.ring_m) / p.ring_sigma_m, 2)) * 0.15
    hill = (0.3 + 0.2 * F.col("many")) * F.exp(-0.5 * F.pow(F.col("d") / F.col("spread"), 2))
    gain = F.when(F.col("k") > 1, hill).when(F.col("d").between(50, p.range_m), ring)
    touched = cells.withColumn("gain", gain).where("gain is not null")
    summed = touched.groupBy("row", "col").agg(F.least(F.lit(p.clip), F.sum(F.col("gain") * F.col("events"))).alias("log_odds"), F.sum("events").alias("detection_count"))
    return summed.withColumn("probability", 1 / (1 + F.exp(-F.col("log_odds"))))


def high_cells(cells: DataFrame, p: Occupancy = Occupancy(), high: float = 0.58, covered: float = 0.55) -> DataFrame:
    """One row: cells above ``high``, and the share of all cells above ``covered``."""
    return cells.agg(F.count_if(F.col("probability") > high).alias("high_prob_cells"), (F.count_if(F.col("probability") > covered) / F.lit(p.cells * p.cells)).alias("coverage"), F.max("probability").alias("max_probability"))


def track_overlap(cells: DataFrame, fused: DataFrame, p: Occupancy = Occupancy()) -> DataFrame:
    """system_track_id, overlap: mean probability at a track's points (0.5 where nothing was heard)."""
    points = fused.where("e is not null and n is not null").select("system_track_id", _index(F.col("e"), p).alias("col"), _index(F.col("n"), p).alias("row"))
    return points.join(cells.select("row", "col", "probability"), ["row", "col"], "left").groupBy("system_track_id").agg(F.avg(F.coalesce("probability", F.lit(0.5))).alias("overlap"), F.count("*").alias("points"))


def false_alarms(obs: DataFrame, fused: DataFrame, p: Occupancy = Occupancy(), tracks: int | None = 50, mhz: float = 1.0) -> DataFrame:
    """target_id, window, rows, sensors, reason of every group of detections that looks false.

    The first that holds: one sensor and at most two rows; mean frequency outside all control bands; three or
    more rows at irregular short intervals; two or more sensors and no fused track near. ``mhz``: what one
    unit of frequency is; ``tracks``: how many fused tracks (by id) are asked, None for all.
    """
    rows = obs.where("source = 'spectrum' and target_id is not null").withColumn("window", F.floor(F.col("time_sec") / p.false_alarm_s))
    keys = ["target_id", "window"]
    step = F.col("time_sec") - F.lag("time_sec").over(Window.partitionBy(*keys).orderBy("time_sec", "obs_id"))
    groups = rows.withColumn("step", step).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_distinct("sensor_id").alias("sensors"), F.avg("frequency").alias("freq"), F.avg("time_sec").alias("at"), F.stddev_pop("step").alias("sd"), F.avg("step").alias("mean_step"), F.avg("e").alias("se"), F.avg("n").alias("sn")
    )
    asked = fused.where("e is not null and n is not null")
    if tracks is not None:
        asked = asked.join(F.broadcast(fused.select("system_track_id").distinct().orderBy("system_track_id").limit(tracks)), "system_track_id", "left_semi")  # at most ``tracks`` rows
    several = groups.where("sensors >= 2").select(*keys, "at", "se", "sn")
    heard = _heard(several, keys, asked.select("system_track_id", "time_sec", "e", "n"), p.false_alarm_s, 0.8 * p.range_m).withColumn("heard", F.lit(True))
    judged = groups.join(heard, keys, "left")
    uneven = (F.col("rows") >= 3) & (F.col("mean_step") < 2) & (F.try_divide("sd", "mean_step") > 1.5)
    reason = (
        F.when((F.col("sensors") == 1) & (F.col("rows") <= 2), "single_station_isolated")
        .when((F.col("freq") > 0) & ~in_uav_band(F.col("freq") * mhz), "frequency_out_of_band")
        .when(uneven, "irregular_intervals")
        .when((F.col("sensors") >= 2) & F.col("heard").isNull(), "no_track_corroboration")
    )
    return judged.withColumn("reason", reason).where("reason is not null").select(*keys, "rows", "sensors", "reason")


#: Rows of numbers that are broadcast; more are joined by a shuffle.
FEW_ROWS = 100_000


def _few(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def _heard(several: DataFrame, keys: list[str], points: DataFrame, half_s: float, reach_m: float) -> DataFrame:
    """``keys`` of the groups (at, se, sn) within whose reach the mean place of some track lies, over its points
    at most ``half_s`` from ``at``.

    Groups whose times take the same points share a span, from the first to the last time of these points, and
    within a span those at one place ask the same. So each track's mean is made once a span, and is held against
    the distinct places only.
    """
    bucket = F.floor(F.col("time_sec") / half_s)
    times = cut(points.select("time_sec").distinct().withColumn("bucket", bucket))
    around = several.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("at") / half_s) + d for d in (-1, 0, 1)])))
    met = around.join(times, "bucket").where(F.abs(F.col("time_sec") - F.col("at")) <= half_s)
    spans = cut(met.groupBy(*keys, "se", "sn").agg(F.min("time_sec").alias("low"), F.max("time_sec").alias("high")))
    asks = _few(spans.select("low", "high", "se", "sn").distinct())
    covered = spans.select("low", "high").distinct().withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / half_s), F.floor(F.col("high") / half_s))))
    covered = _few(covered.join(times, "bucket").where("time_sec between low and high").select("low", "high", "time_sec"))
    means = points.repartition("system_track_id").join(covered, "time_sec").groupBy("low", "high", "system_track_id").agg(F.avg("e").alias("me"), F.avg("n").alias("mn"))
    found = means.join(asks, ["low", "high"]).where(distance2(F.col("me"), F.col("mn"), F.col("se"), F.col("sn")) < reach_m).select("low", "high", "se", "sn").distinct()
    return spans.join(found, ["low", "high", "se", "sn"]).select(*keys)


def report(obs: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: detections, those in false groups and their share, groups by reason."""
    total = obs.where("source = 'spectrum'").agg(F.count("*").alias("detections"))
    reasons = alarms.groupBy("reason").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    summed = reasons.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("false_alarms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("filter_breakdown"))
    return total.crossJoin(summed).withColumn("false_alarm_rate", F.try_divide("false_alarms", "detections"))
