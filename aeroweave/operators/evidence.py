"""Evidential credibility of tracks: masses folded by Dempster's rule, averaged where they conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance2
from ..functions.rules import dempster, mass_from_detection, mass_from_position, position_sigma, reliability

CONFLICT = 0.65


def _start() -> Column:
    """No evidence: combining with it changes nothing."""
    return F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("f"), F.lit(1.0).alias("t"), F.lit(0.0).alias("k"))


def _folded(masses: Column) -> Column:
    """Combination of all, k: the largest conflict on the way."""

    def merge(a: Column, m: Column) -> Column:
        c = dempster(a, m)
        return F.struct(c["r"].alias("r"), c["f"].alias("f"), c["t"].alias("t"), F.greatest(a["k"], c["k"]).alias("k"))

    return F.aggregate(masses, _start(), merge)


def fuse(masses: Column) -> Column:
    """Struct r, f, t, k, strategy of an array of masses (struct r, f, t) in order."""
    n = F.size(masses)

    def mean(c: str) -> Column:
        return F.aggregate(masses, F.lit(0.0), lambda a, m: a + m[c]) / n

    total = mean("r") + mean("f") + mean("t")
    average = F.struct((mean("r") / total).alias("r"), (mean("f") / total).alias("f"), (mean("t") / total).alias("t"))
    one_by_one, averaged = _folded(masses), _folded(F.array_repeat(average, n))

    def of(c: Column, strategy: str) -> Column:
        return F.struct(c["r"].alias("r"), c["f"].alias("f"), c["t"].alias("t"), c["k"].alias("k"), F.lit(strategy).alias("strategy"))

    return F.when(n == 0, of(_start(), "none")).when(n == 1, of(one_by_one, "single")).when(one_by_one["k"] > CONFLICT, of(averaged, "murphy")).otherwise(of(one_by_one, "dempster"))


def decision(m: Column) -> Column:
    return F.when(m["r"] > 0.65, "confirmed_real").when(m["f"] > 0.50, "suspected_false").when(m["k"] > CONFLICT, "high_conflict").otherwise("uncertain")


def source_errors(obs: DataFrame, fused: DataFrame, key: str, per_track: bool = True) -> DataFrame:
    """system_track_id, source, error_m: distance of a source's mean position to the track's mean position.

    ``per_track``: the mean of the source's reports of the track; else of all its reports.
    """
    center = fused.where("e is not null").groupBy("system_track_id").agg(F.avg("e").alias("te"), F.avg("n").alias("tn"))
    rows = obs.where("source != 'spectrum' and e is not null and n is not null")
    if per_track:
        means = rows.groupBy(F.col(key).alias("system_track_id"), "source").agg(F.avg("e").alias("se"), F.avg("n").alias("sn"))
        joined = means.join(center, "system_track_id")
    else:
        seen = rows.select(F.col(key).alias("system_track_id"), "source").distinct()
        joined = seen.join(rows.groupBy("source").agg(F.avg("e").alias("se"), F.avg("n").alias("sn")), "source").join(center, "system_track_id")
    return joined.select("system_track_id", "source", distance2(F.col("se"), F.col("sn"), F.col("te"), F.col("tn")).alias("error_m"))


def credibility(errors: DataFrame, tracks: int | None = 200) -> DataFrame:
    """credibility, false_prob, uncertainty, conflict_k, strategy, decision, system_track_id, n_sources.

    Each source gives a detection mass and a position mass, sources in order of name. ``tracks``: the first so
    many by id, None for all.
    """
    rows = errors
    if tracks is not None:
        rows = rows.join(F.broadcast(errors.select("system_track_id").distinct().orderBy("system_track_id").limit(tracks)), "system_track_id", "left_semi")  # at most ``tracks`` rows
    source = F.col("source")
    quality = F.when(source.isin("adsb", "remote_id"), 0.85).otherwise(0.65)
    seen = mass_from_detection(reliability(source), quality, F.lit(True))
    placed = mass_from_position(reliability(source), F.col("error_m"), position_sigma(source))
    each = rows.groupBy("system_track_id").agg(F.array_sort(F.collect_list(F.struct("source", seen.alias("seen"), placed.alias("placed")))).alias("s"))
    masses = F.flatten(F.transform("s", lambda x: F.array(x["seen"], x["placed"])))
    fused = each.select("system_track_id", F.size("s").alias("n_sources"), fuse(masses).alias("m"))
    m = F.col("m")
    return fused.select(F.round(m["r"], 4).alias("credibility"), F.round(m["f"], 4).alias("false_prob"), F.round(m["t"], 4).alias("uncertainty"), F.round(m["k"], 4).alias("conflict_k"), m["strategy"].alias("strategy"), decision(m).alias("decision"), "system_track_id", "n_sources")
