"""Linking tracks of different sources, and pieces of broken tracks of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Association, Maintenance
from ..functions.geo import distance2, heading_of, turn_between
from .align import TRACK
from .graph import greedy_matching
from .pairs import pairs_met, reported, states_met


def track_summary(obs: DataFrame, least: int = 5) -> DataFrame:
    """source_rank, source, target_id, t_min, t_max, e_c, n_c, u_c, n_rows of spatial tracks with enough rows."""
    rows = obs.where("source != 'spectrum' and target_id is not null")
    return rows.groupBy("source_rank", *TRACK).agg(F.min("time_sec").alias("t_min"), F.max("time_sec").alias("t_max"), F.avg("e").alias("e_c"), F.avg("n").alias("n_c"), F.avg("u").alias("u_c"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def coarse_candidates(summary: DataFrame, p: Association = Association()) -> DataFrame:
    """Pairs of tracks of two sources whose times may meet and whose centroids are near: joined by grid cells."""
    side = 2 * p.coarse_m
    cell = {"cx": F.floor(F.col("e_c") / side), "cy": F.floor(F.col("n_c") / side)}
    names = ("source_rank", "source", "target_id", "t_min", "t_max", "e_c", "n_c", "n_rows", *(c for c in ("reports",) if c in summary.columns))
    a = summary.withColumns(cell).select("cx", "cy", *[F.col(c).alias(f"{c}_a") for c in names])
    b = summary
    for c, at in (("cx", "e_c"), ("cy", "n_c")):  # every cell that the largest distance reaches
        b = b.withColumn(c, F.explode(F.sequence(*[F.floor((F.col(at) + d) / side) for d in (-p.coarse_m, p.coarse_m)])))
    b = b.select("cx", "cy", *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = a.join(b, ["cx", "cy"]).where("source_rank_a < source_rank_b").withColumn("centroid_m", distance2(F.col("e_c_a"), F.col("n_c_a"), F.col("e_c_b"), F.col("n_c_b")))
    close = F.when((F.col("source_a") == "remote_id") & (F.col("source_b") == "radar"), p.coarse_close_m).otherwise(p.coarse_m)
    slack = p.coarse_slack_s
    meet = (F.col("t_max_a") + slack >= F.col("t_min_b") - slack) & (F.col("t_max_b") + slack >= F.col("t_min_a") - slack)
    return pairs.where(meet & (F.col("centroid_m") <= close)).drop("cx", "cy")


def similarity(p: Association = Association()) -> tuple[Column, dict[str, Column]]:
    """Score of two states with columns {t,e,n,u,speed,heading,climb}1 and 2, 0 if a gate rejects them; details."""
    c = {f"{x}{k}": F.col(f"{x}{k}") for x in ("t", "e", "n", "u", "speed", "heading", "climb") for k in (1, 2)}
    d3 = F.sqrt(F.pow(c["e1"] - c["e2"], 2) + F.pow(c["n1"] - c["n2"], 2) + F.pow(c["u1"] - c["u2"], 2))

    def part(k: int, f) -> Column:
        return c[f"speed{k}"] * f(F.radians(c[f"heading{k}"]))

    climb = [F.coalesce(c[f"climb{k}"], F.lit(0.0)) for k in (1, 2)]
    dv = F.sqrt(F.pow(part(1, F.sin) - part(2, F.sin), 2) + F.pow(part(1, F.cos) - part(2, F.cos), 2) + F.pow(climb[0] - climb[1], 2))
    dh = turn_between(c["heading1"], c["heading2"])
    du = F.abs(c["u1"] - c["u2"])
    dt = F.abs(c["t1"] - c["t2"])
    window = F.greatest(F.lit(120.0), F.least(F.lit(180.0), 5.0 / F.when(c["speed1"] > 0, c["speed1"]).otherwise(10.0)))
    rejected = (dt > window) | (d3 > p.max_distance_m) | F.coalesce(dv > p.max_speed_diff, F.lit(False)) | F.coalesce(dh > p.max_heading_diff, F.lit(False))
    sigma = p.max_distance_m / 3
    score = (
        0.35 * F.exp(-(d3 * d3) / (2 * sigma * sigma))
        + 0.25 * F.coalesce(1 - dv / p.max_speed_diff, F.lit(0.5))
        + 0.20 * F.coalesce(1 - dh / p.max_heading_diff, F.lit(0.5))
        + 0.20 * F.when(du > p.max_altitude_diff, 0.0).otherwise(1 - du / p.max_altitude_diff)
    )
    details = {"dist_3d_m": d3, "d_alt_m": du, "speed_diff_ms": dv, "heading_diff_deg": dh, "time_window_sec": window}
    return F.when(rejected, 0.0).otherwise(score), details


_STATE = {"t": "time_sec", "e": "e", "n": "n", "u": "u", "speed": "speed", "heading": "heading", "climb": "climb_rate"}


def with_reports(summary: DataFrame, obs: DataFrame) -> DataFrame:
    """The summary with ``reports``, an array of a track's states in order of time."""
    state = F.struct("time_sec", "obs_id", *[F.col(c).alias(x) for x, c in _STATE.items()])
    found = obs.where("source != 'spectrum'").groupBy(*TRACK).agg(F.array_sort(F.collect_list(state)).alias("reports"))
    return summary.join(found.withColumn("reports", F.transform("reports", lambda r: F.struct(*[r[x].alias(x) for x in _STATE]))), list(TRACK))


def nearest_matches(candidates: DataFrame, p: Association = Association()) -> DataFrame:
    """Each candidate pair's probes of the sparser track with the nearest report in time of the other, scored.

    ``candidates``: coarse candidates of a summary with reports. Probes: all reports of a track of three or
    fewer, else the first, the middle and the last. A pair holds all that it needs, so no pairs are shuffled.
    """
    pairs = candidates.where(F.greatest("t_min_a", "t_min_b") <= F.least("t_max_a", "t_max_b"))
    base_a = F.col("n_rows_a") <= F.col("n_rows_b")
    base, other = (F.when(base_a, F.col(f"reports_{x}")).otherwise(F.col(f"reports_{y}")) for x, y in ("ab", "ba"))
    keys = ["source_a", "target_id_a", "source_b", "target_id_b"]
    pairs = pairs.select(*keys, base.alias("base"), other.alias("other"))
    m = F.size("base")
    probes = F.when(m <= 3, F.sequence(F.lit(0), m - 1)).otherwise(F.array(F.lit(0), F.floor(m / 2).cast("int"), m - 1))

    def met(k: Column) -> Column:
        t = F.get("base", k)["t"]
        nearest = F.array_min(F.transform("other", lambda x, i: F.struct(F.abs(t - x["t"]).alias("gap"), i.alias("k"))))["k"]
        return F.struct(k.cast("long").alias("probe"), F.get("base", k).alias("s1"), F.get("other", nearest).alias("s2"))

    rows = pairs.select(*keys, F.explode(F.transform(probes, met)).alias("x"))
    rows = rows.select(*keys, "x.probe", *[F.col(f"x.s{k}.{x}").alias(f"{x}{k}") for k in (1, 2) for x in _STATE]).where(F.abs(F.col("t1") - F.col("t2")) <= p.max_gap_s)
    rows = rows.where(distance2(F.col("e1"), F.col("n1"), F.col("e2"), F.col("n2")) <= p.max_fine_m)
    score, details = similarity(p)
    return rows.withColumns({"score": score, **details})


def best_matches(scored: DataFrame) -> DataFrame:
    """The best probe of each pair of tracks; among equal scores the earliest."""
    keys = ("source_a", "target_id_a", "source_b", "target_id_b")
    names = ("t1", "score", "dist_3d_m", "d_alt_m", "speed_diff_ms", "heading_diff_deg", "time_window_sec")
    best = scored.where("score is not null").groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("score", -F.col("probe"))).alias("s"))
    return best.select(*keys, "s.*")


def associate(obs: DataFrame, p: Association = Association()) -> DataFrame:
    """One-to-one associations per pair of sources, best scores first."""
    tracks = reported(obs, p.min_rows)
    best = pairs_met(tracks, p, p.suspected)  # a probe below it is no pair's best that counts
    taken = greedy_matching(best, ("source_a", "source_b"), "target_id_a", "target_id_b", "score")
    taken = states_met(taken, tracks)
    taken = taken.withColumns(similarity(p)[1])
    level = F.when(F.col("score") >= p.confirmed, "confirmed").otherwise("suspected")
    return taken.select(F.col("t1").alias("time_sec"), F.col("source_a").alias("src_a"), F.col("target_id_a").alias("tid_a"), F.col("source_b").alias("src_b"), F.col("target_id_b").alias("tid_b"), "score", level.alias("level"), "dist_3d_m", "d_alt_m", "speed_diff_ms", "heading_diff_deg", "time_window_sec")


def endpoints(obs: DataFrame, least: int = 3, tail: int = 5) -> DataFrame:
    """Per track: first and last position and the velocities of its first and last ``tail`` rows."""
    w = Window.partitionBy(*TRACK)
    rows = obs.where("source != 'spectrum' and e is not null and n is not null")
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy("time_sec", "obs_id")), "m": F.count("*").over(w)}).where(F.col("m") >= least)
    place = F.struct("time_sec", "e", "n")

    def at(k: Column) -> Column:
        return F.max(F.when(F.col("i") == k, place))

    found = rows.groupBy(*TRACK).agg(at(F.lit(1)).alias("f"), at(F.least(F.lit(tail), F.col("m"))).alias("f5"), at(F.col("m")).alias("l"), at(F.greatest(F.lit(1), F.col("m") - (tail - 1))).alias("l5"))

    def rate(a: str, b: str, c: str) -> Column:
        dt = F.col(f"{b}.time_sec") - F.col(f"{a}.time_sec")
        return F.when(dt > 0, (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) / dt).otherwise(0.0)

    return found.select(
        *TRACK,
        *[F.col(f"f.{c}").alias(f"{c}_start") for c in ("time_sec", "e", "n")],
        *[F.col(f"l.{c}").alias(f"{c}_end") for c in ("time_sec", "e", "n")],
        *[rate("f", "f5", c).alias(f"v{c}_start") for c in "en"],
        *[rate("l5", "l", c).alias(f"v{c}_end") for c in "en"],
    )


def broken_tracks(obs: DataFrame, p: Maintenance = Maintenance()) -> DataFrame:
    """Tracks that go on where another of the source ended: an interval join by buckets of the longest gap."""
    ends = endpoints(obs, p.min_rows)
    old = ends.select("source", F.col("target_id").alias("tid_old"), F.col("time_sec_end").alias("t0"), "e_end", "n_end", "ve_end", "vn_end")
    low, high = F.floor((F.col("t0") + p.min_gap_s) / p.max_gap_s), F.floor((F.col("t0") + p.max_gap_s) / p.max_gap_s)
    old = old.withColumn("bucket", F.explode(F.sequence(low, high)))
    new = ends.select("source", F.col("target_id").alias("tid_new"), F.col("time_sec_start").alias("t1"), "e_start", "n_start", "ve_start", "vn_start").withColumn("bucket", F.floor(F.col("t1") / p.max_gap_s))
    gap = F.col("t1") - F.col("t0")
    pairs = old.join(new, ["source", "bucket"]).where((F.col("tid_old") != F.col("tid_new")) & (gap >= p.min_gap_s) & (gap <= p.max_gap_s)).withColumn("gap", gap)
    pairs = pairs.withColumn("err", distance2(F.col("e_end") + F.col("ve_end") * F.col("gap"), F.col("n_end") + F.col("vn_end") * F.col("gap"), F.col("e_start"), F.col("n_start")))
    s0, s1 = F.sqrt(F.expr("ve_end * ve_end + vn_end * vn_end")), F.sqrt(F.expr("ve_start * ve_start + vn_start * vn_start"))
    moving = (s0 > 1) & (s1 > 1)
    ratio = F.when(moving, F.abs(s0 - s1) / F.greatest(s0, s1)).otherwise(0.0)
    turn = turn_between(heading_of(F.col("ve_end"), F.col("vn_end")), heading_of(F.col("ve_start"), F.col("vn_start")))
    pairs = pairs.withColumns({"ratio": ratio, "turn": turn}).where((F.col("err") <= p.gate_m) & (F.col("ratio") <= p.max_speed_ratio) & (F.col("turn") <= p.max_heading_diff))
    score = 1 - 0.4 * F.col("err") / p.gate_m - 0.3 * F.col("ratio") - 0.3 * F.col("turn") / p.max_heading_diff
    best = Window.partitionBy("source", "tid_new").orderBy(F.col("score").desc(), "tid_old")
    rows = pairs.withColumn("score", score).withColumn("k", F.row_number().over(best)).where("k = 1")
    return rows.select(
        "source", "tid_old", "tid_new", F.round("gap", 2).alias("gap_sec"), F.round("err", 2).alias("pred_error_m"), F.round("ratio", 3).alias("speed_ratio"), F.round("turn", 1).alias("heading_diff_deg"), F.round("score", 4).alias("score"), F.when(F.col("score") >= p.confirmed, "confirmed").otherwise("suspected").alias("status")
    )


def maintenance_stats(broken: DataFrame) -> DataFrame:
    """Counts and means over all sources (source null) and for each."""
    values = [F.count("*").alias("pairs"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "suspected").alias("suspected"), F.avg("gap_sec").alias("avg_gap_sec"), F.avg("pred_error_m").alias("avg_error_m")]
    return broken.rollup("source").agg(*values)


def confirmation(flags: DataFrame, key: str = "target_id", frames: int = 3) -> DataFrame:
    """Level after each frame from the last ``frames`` match flags (columns: key, frame, matched)."""
    w = Window.partitionBy(key).orderBy("frame").rowsBetween(-(frames - 1), 0)
    hits, seen = F.sum(F.col("matched").cast("int")).over(w), F.count("*").over(w)
    level = F.when(F.col("matched") & (seen >= frames) & (hits >= frames), "confirmed")
    level = level.when(F.col("matched") & (hits >= F.greatest(F.lit(1), F.floor(seen / 2))), "suspected")
    level = level.when(~F.col("matched") & (seen >= frames) & (hits == 0), "pending").when(~F.col("matched") & (hits > 0), "suspected").otherwise("pending")
    return flags.withColumn("level", level)
