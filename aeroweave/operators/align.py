"""Frames, outliers, gaps and resampling of single-source tracks."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import enu

TRACK = ("source", "target_id")


def track_order(*extra: str) -> Window:
    return Window.partitionBy(*TRACK).orderBy("time_sec", *(extra or ("obs_id",)))


def reference(obs: DataFrame, rows: int = 100) -> DataFrame:
    """One row lat0, lon0, alt0: the mean of the first ``rows`` rows with a position of every source."""
    order = Window.partitionBy("source").orderBy("target_id", "time_sec", "obs_id")
    first = obs.where("lat is not null and lon is not null").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    return first.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.avg(F.coalesce("alt_geom", F.lit(0.0))).alias("alt0"))


def add_enu(obs: DataFrame, ref: DataFrame) -> DataFrame:
    """e, n, u about the reference row; a missing altitude counts as 0."""
    at = tuple(F.col(c) for c in ("lat0", "lon0", "alt0"))
    e, n, u = enu(F.col("lat"), F.col("lon"), F.coalesce("alt_geom", F.lit(0.0)), at=at)
    return obs.drop("e", "n", "u").crossJoin(F.broadcast(ref)).withColumns({"e": e, "n": n, "u": u}).drop("lat0", "lon0", "alt0")  # ref: one row


def outlier_flags(obs: DataFrame, max_speed: float = 200.0, max_climb: float = 50.0) -> DataFrame:
    """Adds bad_position and bad_altitude by the way from the track's previous report, original values.

    No division: a step in no time is an outlier if it leads anywhere. Spectrum rows hold sensor positions and
    are never flagged.
    """
    w = track_order()
    dt = F.col("time_sec") - F.lag("time_sec").over(w)
    de, dn, du = (F.col(c) - F.lag(c).over(w) for c in "enu")
    spatial = F.col("source") != "spectrum"
    return obs.withColumns(
        {
            "bad_position": F.coalesce(spatial & (F.sqrt(de * de + dn * dn) > max_speed * dt), F.lit(False)),
            "bad_altitude": F.coalesce(spatial & (F.abs(du) > max_climb * dt), F.lit(False)),
        }
    )


def reject_outliers(obs: DataFrame, max_speed: float = 200.0, max_climb: float = 50.0) -> DataFrame:
    flagged = outlier_flags(obs, max_speed, max_climb)

    def unless(flag: str, c: str) -> Column:
        return F.when(F.col(flag), None).otherwise(F.col(c))

    out = {c: unless("bad_position", c) for c in ("lat", "lon", "e", "n") if c in obs.columns} | {"u": unless("bad_altitude", "u")}
    return flagged.withColumns(out).drop("bad_position", "bad_altitude")


def data_gaps(obs: DataFrame, gap_s: float = 5.0, per_target: bool = True) -> DataFrame:
    """Rows that follow the one before after more than ``gap_s``; per track, or per source over all its tracks.

    The latter orders a whole source in one task and is meant for small inputs.
    """
    w = track_order() if per_target else Window.partitionBy("source").orderBy("time_sec", "obs_id")
    dt = F.col("time_sec") - F.lag("time_sec").over(w)
    return obs.withColumn("gap_s", dt).where(F.col("gap_s") > gap_s)


def timeline(obs: DataFrame, step_s: float = 1.0) -> DataFrame:
    """Per track the times floor(first) .. ceil(last) in steps."""
    span = obs.groupBy(*TRACK).agg(F.floor(F.min("time_sec")).alias("t0"), F.ceil(F.max("time_sec")).alias("t1"))
    return span.select(*TRACK, F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / step_s).cast("int"))).alias("k"), "t0").select(*TRACK, (F.col("t0") + F.col("k") * step_s).cast("double").alias("time_sec"))


def resample_linear(obs: DataFrame, columns: tuple[str, ...] = ("e", "n", "u"), step_s: float = 1.0) -> DataFrame:
    """Values on the timeline between the neighbouring reports; outside a track's reports by the nearest two."""
    values = F.struct("time_sec", *columns)
    points = obs.groupBy(*TRACK, "time_sec").agg(*[F.avg(c).alias(c) for c in columns]).dropna(subset=list(columns))
    w = Window.partitionBy(*TRACK).orderBy("time_sec")
    # each report knows the one after; the last takes the one before, so that it serves times behind it
    pairs = points.withColumns({"p": values, "q": F.lead(values).over(w), "o": F.lag(values).over(w)})
    pairs = pairs.where("q is not null or o is not null").withColumns({"a": F.when(F.col("q").isNotNull(), F.col("p")).otherwise(F.col("o")), "b": F.coalesce("q", "p")})
    grid = timeline(points, step_s).select(*TRACK, "time_sec", F.lit(1).alias("asked"))
    marked = pairs.select(*TRACK, "time_sec", "a", "b", F.lit(0).alias("asked")).unionByName(grid, allowMissingColumns=True)
    before = Window.partitionBy(*TRACK).orderBy("time_sec", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*TRACK).orderBy("time_sec", "asked").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    side = F.struct("a", "b")
    known = F.when(F.col("asked") == 0, side)
    got = marked.withColumn("s", F.coalesce(F.last(known, True).over(before), F.first(known, True).over(after))).where("asked = 1 and s is not null")
    share = (F.col("time_sec") - F.col("s.a.time_sec")) / (F.col("s.b.time_sec") - F.col("s.a.time_sec"))
    return got.select(*TRACK, "time_sec", *[(F.col(f"s.a.{c}") + share * (F.col(f"s.b.{c}") - F.col(f"s.a.{c}"))).alias(c) for c in columns])


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y), x rising, whose first two and last two pieces are one cubic each."""
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * slope[i - 1] + h[i - 1] * slope[i])
    first, last = x[2] - x[0], x[-1] - x[-3]
    a[0, :2] = h[1], first
    b[0] = ((h[0] + 2 * first) * h[1] * slope[0] + h[0] ** 2 * slope[1]) / first
    a[-1, -2:] = last, h[-2]
    b[-1] = (h[-1] ** 2 * slope[-2] + (2 * last + h[-1]) * h[-2] * slope[-1]) / last
    d = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[k]
    c2 = (3 * slope[k] - 2 * d[k] - d[k + 1]) / h[k]
    c3 = (d[k] + d[k + 1] - 2 * slope[k]) / h[k] ** 2
    return y[k] + t * (d[k] + t * (c2 + t * c3))


def resample_cubic(obs: DataFrame, columns: tuple[str, ...] = ("e", "n", "u"), step_s: float = 1.0, dense_s: float = 1.0) -> DataFrame:
    """As ``resample_linear``; tracks of four reports or more that are closer than ``dense_s`` on average get a
    cubic spline."""
    shape = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("time_sec", *columns)]])

    def one(track: pd.DataFrame) -> pd.DataFrame:
        points = track[["time_sec", *columns]].dropna().groupby("time_sec", as_index=False).mean()
        if len(points) < 2:
            return pd.DataFrame(columns=shape.names)
        x = points["time_sec"].to_numpy()
        at = np.arange(np.floor(x[0]), np.ceil(x[-1]) + step_s / 2, step_s)
        out = {"source": track["source"].iloc[0], "target_id": track["target_id"].iloc[0], "time_sec": at}
        for c in columns:
            y = points[c].to_numpy()
            if len(x) >= 4 and np.diff(x).mean() < dense_s:
                out[c] = not_a_knot(x, y, at)
            else:
                k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
                out[c] = y[k] + (at - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])
        return pd.DataFrame(out)

    return obs.select(*TRACK, "time_sec", *columns).groupBy(*TRACK).applyInPandas(one, shape)
