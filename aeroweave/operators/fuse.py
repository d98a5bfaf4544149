"""System tracks: grouping of associated tracks, weighted fusion, quality of fused tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SOURCES
from ..functions.geo import distance2, heading_of, velocity
from ..functions.rules import sigma
from .graph import components

LEVELS = {"confirmed": 2, "suspected": 1, "pending": 0}


def track_groups(tracks: DataFrame, associations: DataFrame, confidence: str = "suspected") -> DataFrame:
    """system_track_id, source, target_id: components of associated tracks; tracks by themselves stay.

    ``tracks``: source_rank, source, target_id. Numbers follow the least (source_rank, target_id) of a group.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("s")).cast("int") - 1
    key = F.concat(rank.cast("string"), F.lit(":"), F.col("t"))
    level = F.coalesce(F.when(F.col("level") == "confirmed", 2).when(F.col("level") == "suspected", 1).when(F.col("level") == "pending", 0), F.lit(1))
    strong = associations.where(level >= LEVELS.get(confidence, 1))

    edges = strong.select(F.col("src_a").alias("s"), F.col("tid_a").alias("t"), F.col("src_b"), F.col("tid_b")).withColumn("a", key)
    edges = edges.select("a", F.col("src_b").alias("s"), F.col("tid_b").alias("t")).withColumn("b", key).select("a", "b")
    nodes = tracks.select("source", "target_id", F.col("source").alias("s"), F.col("target_id").alias("t")).distinct().withColumn("id", key)
    grouped = nodes.join(components(edges), "id", "left").select("source", "target_id", F.coalesce("component", "id").alias("group"))
    # one row a group goes through one task: the numbering is global by definition
    numbers = grouped.select("group").distinct().withColumn("k", F.row_number().over(Window.orderBy("group")))
    return grouped.join(numbers, "group").select(F.format_string("ST%04d", F.col("k")).alias("system_track_id"), "source", "target_id")


def wls_fused(obs: DataFrame, key: str, bin_s: float = 1.0) -> DataFrame:
    """Per track and time bin the means weighted by inverse variances: position, altitude, velocity.

    ``key``: the system track's column. A bin of one report passes through unchanged.
    """
    source = F.col("source")
    ve, vn = velocity(F.col("speed"), F.col("heading"))
    w = {f"w{k}": 1 / (sigma(source, k) * sigma(source, k)) for k in range(3)}
    rows = obs.where("e is not null and n is not null").withColumns({"bin": F.rint(F.col("time_sec") / bin_s) * bin_s, "ve": ve, "vn": vn, **w})

    def mean(value: str, weight: str):
        known = F.when(F.col(value).isNotNull(), F.col(weight))
        return F.sum(F.col(value) * F.col(weight)) / F.sum(known)

    fused = rows.groupBy(F.col(key).alias("system_track_id"), F.col("bin").alias("time_sec")).agg(
        mean("e", "w0").alias("e"), mean("n", "w0").alias("n"), mean("u", "w1").alias("u"), mean("ve", "w2").alias("ve"), mean("vn", "w2").alias("vn"), F.array_sort(F.collect_set("source")).alias("s")
    )
    return fused.select("system_track_id", "time_sec", "e", "n", "u", F.sqrt(F.expr("ve * ve + vn * vn")).alias("speed"), heading_of(F.col("ve"), F.col("vn")).alias("heading"), F.array_join("s", ",").alias("sources"), F.size("s").alias("source_count"))


def nearest_fused(obs: DataFrame, fused: DataFrame, members: DataFrame | None = None, tolerance_s: float = 3.0, first: int = 20, sample: int | None = 100) -> DataFrame:
    """source, de, dn: errors of reports against the nearest point of fused tracks within the tolerance.

    Literally every target is held against every fused track of the sample; ``members`` (system_track_id,
    source, target_id) restricts a track to its own reports. A target takes part with its ``first`` reports of
    the track's time, if it has three there. Which these are a report tells by the times of its neighbours, and
    a point by its track's neighbouring points whether it is the nearest, so reports and points that meet in
    buckets of time are judged one by one and nothing made of their pairs is shuffled.
    """
    own = Window.partitionBy("system_track_id")
    points = fused.withColumns({"m": F.count("e").over(own), "t0": F.min(F.when(F.col("e").isNotNull(), F.col("time_sec"))).over(own) - 5, "t1": F.max(F.when(F.col("e").isNotNull(), F.col("time_sec"))).over(own) + 5})
    points = points.withColumns({"f0": F.lag("time_sec").over(own.orderBy("time_sec")), "f2": F.lead("time_sec").over(own.orderBy("time_sec"))}).where("m >= 5")
    if sample is not None:
        points = points.join(F.broadcast(points.select("system_track_id").distinct().orderBy("system_track_id").limit(sample)), "system_track_id", "left_semi")  # at most ``sample`` rows
    w = Window.partitionBy("source", "target_id").orderBy("time_sec", "obs_id")
    steps = {f"b{k}": F.lag("time_sec", k).over(w) for k in (1, 2, first)} | {f"a{k}": F.lead("time_sec", k).over(w) for k in (1, 2)}
    rows = obs.where("source != 'spectrum' and e is not null and n is not null").select("source", "target_id", "time_sec", "e", "n", "obs_id").withColumns(steps | {"again": (F.lag("time_sec").over(w) == F.col("time_sec")) & (F.lag("obs_id").over(w) == F.col("obs_id"))})
    rows = rows.where("not coalesce(again, false)")  # a repeated report has its place in the order, but one error
    keys = ["bucket"]
    if members is not None:
        rows, keys = rows.join(members.distinct(), ["source", "target_id"]), ["bucket", "system_track_id"]
    near = F.explode(F.array(*[F.floor(F.col("time_sec") / tolerance_s) + d for d in (-1, 0, 1)]))
    asked = rows.select("source", "time_sec", "e", "n", *steps, *keys[1:], near.alias("bucket"))
    points = points.select(*keys[1:], "t0", "t1", "f0", "f2", F.col("time_sec").alias("ft"), F.col("e").alias("fe"), F.col("n").alias("fn"), F.floor(F.col("time_sec") / tolerance_s).alias("bucket"))
    met = asked.join(points, keys).where("time_sec between t0 and t1").where(F.abs(F.col("time_sec") - F.col("ft")) <= tolerance_s)
    nearest = "(f0 is null or abs(time_sec - f0) > abs(time_sec - ft)) and (f2 is null or abs(time_sec - f2) >= abs(time_sec - ft))"
    early = f"(b{first} is null or b{first} < t0)"
    three = "coalesce(b2 >= t0, false) or coalesce(b1 >= t0 and a1 <= t1, false) or coalesce(a2 <= t1, false)"
    return met.where(nearest).where(early).where(three).select("source", (F.col("e") - F.col("fe")).alias("de"), (F.col("n") - F.col("fn")).alias("dn"))


def rmse_per_source(errors: DataFrame, least: int = 10) -> DataFrame:
    def root(c: str):
        return F.sqrt(F.avg(F.col(c) * F.col(c)))

    total = F.sqrt(F.avg(F.expr("de * de + dn * dn")))
    return errors.groupBy("source").agg(root("de").alias("rmse_e"), root("dn").alias("rmse_n"), total.alias("rmse_total"), F.count("*").alias("samples")).where(F.col("samples") >= least)


def prediction_rmse(fused: DataFrame, sample: int | None = 100) -> DataFrame:
    """One row: root mean square of what a constant velocity from two points misses the third by."""
    w = Window.partitionBy("system_track_id").orderBy("time_sec")
    rows = fused
    if sample is not None:
        rows = rows.join(F.broadcast(fused.select("system_track_id").distinct().orderBy("system_track_id").limit(sample)), "system_track_id")  # at most ``sample`` rows
    step = {f"{c}0": F.lag(c).over(w) for c in ("time_sec", "e", "n")} | {f"{c}2": F.lead(c).over(w) for c in ("time_sec", "e", "n")}
    rows = rows.withColumns(step).withColumns({"dt": F.col("time_sec") - F.col("time_sec0"), "after": F.col("time_sec2") - F.col("time_sec")}).where("dt >= 0.01 and after >= 0.01")
    guess = {c: F.col(c) + (F.col(c) - F.col(f"{c}0")) / F.col("dt") * F.col("after") for c in "en"}
    rows = rows.withColumn("miss", distance2(guess["e"], guess["n"], F.col("e2"), F.col("n2")))
    return rows.agg(F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("fused_rmse"), F.count("miss").alias("samples"))


def smoothness(fused: DataFrame) -> DataFrame:
    """One row: means over tracks of the jerk's root mean square and of the speed's population deviation."""
    w = Window.partitionBy("system_track_id").orderBy("time_sec")
    ve, vn = velocity(F.coalesce("speed", F.lit(0.0)), F.coalesce("heading", F.lit(0.0)))
    rows = fused.withColumns({"ve": ve, "vn": vn, "dt": F.greatest(F.lit(0.01), F.col("time_sec") - F.lag("time_sec").over(w)), "m": F.count("*").over(Window.partitionBy("system_track_id"))}).where("m >= 4")
    rows = rows.withColumns({"ae": (F.col("ve") - F.lag("ve").over(w)) / F.col("dt"), "an": (F.col("vn") - F.lag("vn").over(w)) / F.col("dt")})
    rows = rows.withColumns({"je": (F.col("ae") - F.lag("ae").over(w)) / F.col("dt"), "jn": (F.col("an") - F.lag("an").over(w)) / F.col("dt")})
    tracks = rows.groupBy("system_track_id").agg(F.sqrt(F.avg(F.expr("je * je + jn * jn"))).alias("jerk"), F.stddev_pop("speed").alias("deviation"))
    return tracks.agg(F.avg("jerk").alias("jerk_rms"), F.avg("deviation").alias("speed_std"), F.count("*").alias("tracks"))


def improvement(rmse: DataFrame, fused_rmse: DataFrame) -> DataFrame:
    """source, improvement_pct: how far the fused figure lies below the source's."""
    gain = (F.col("rmse_total") - F.col("fused_rmse")) / F.col("rmse_total") * 100
    return rmse.crossJoin(F.broadcast(fused_rmse.select("fused_rmse"))).select("source", F.round(F.greatest(F.lit(0.0), gain), 1).alias("improvement_pct"))  # one row
