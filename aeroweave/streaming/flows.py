"""Streaming forms of the windowed operators; on ordered input they agree with the batch ones.

Observation time is seconds of a day; streams carry it as an event timestamp ``at``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.imm import FUSED, Filter, LEAST_STEP, _VARIANCE


def with_event_time(obs: DataFrame) -> DataFrame:
    return obs.withColumn("at", F.timestamp_millis((F.col("time_sec") * 1000).cast("long")))


def temporal_flow(stream: DataFrame, bin_s: int = 60, late: str = "2 minutes") -> DataFrame:
    """Per time bin: distinct targets (approximate, as streams need), reports, mean altitude."""
    binned = stream.withWatermark("at", late).groupBy(F.window("at", f"{bin_s} seconds"))
    counted = binned.agg(F.approx_count_distinct("target_id", 0.01).alias("active_targets"), F.count("*").alias("total_reports"), F.avg(F.coalesce("alt_geom", "u")).alias("avg_altitude"))
    return counted.select(F.unix_timestamp("window.start").cast("double").alias("time_sec"), "active_targets", "total_reports", "avg_altitude")


def sessions(stream: DataFrame, gap_s: int = 60, late: str = "2 minutes") -> DataFrame:
    """Per track the spells without a gap over ``gap_s``: a new spell is a loss of signal before it."""
    spells = stream.withWatermark("at", late).groupBy("source", "target_id", F.session_window("at", f"{gap_s} seconds"))
    return spells.agg(F.count("*").alias("reports"), F.min("time_sec").alias("first_sec"), F.max("time_sec").alias("last_sec")).drop("session_window")


_FLAGS = T.StructType([T.StructField("target_id", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("level", T.StringType())])
_LAST = T.StructType([T.StructField("flags", T.ArrayType(T.BooleanType()))])


def confirmation(stream: DataFrame, frames: int = 3) -> DataFrame:
    """Level of each target after each frame (columns target_id, frame, matched), from its last match flags."""

    def level(last: list[bool]) -> str:
        hits = sum(last)
        if last[-1]:
            return "confirmed" if hits >= frames else "suspected" if hits >= max(1, len(last) // 2) else "pending"
        return "suspected" if hits else "pending"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values("frame")
        levels = []
        for matched in rows["matched"]:
            last = [*last, bool(matched)][-frames:]
            levels.append(level(last))
        state.update((last,))
        yield pd.DataFrame({"target_id": key[0], "frame": rows["frame"].to_numpy(), "level": levels})

    return stream.select("target_id", "frame", "matched").groupBy("target_id").applyInPandasWithState(follow, _FLAGS, _LAST, "append", GroupStateTimeout.NoTimeout)


_FILTER = T.StructType([T.StructField("time_sec", T.DoubleType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("held", T.ArrayType(T.DoubleType()))])


def _packed(f: Filter) -> list[float]:
    return np.concatenate([f.mu, *[np.concatenate([m.x, m.p.ravel()]) for m in f.models]]).tolist()


def _unpacked(values: list[float]) -> Filter:
    f, at = Filter(np.zeros(6)), 3
    v = np.array(values)
    f.mu = v[:3].copy()
    for m in f.models:
        k = len(m.x)
        m.x, m.p = v[at : at + k].copy(), v[at + k : at + k + k * k].reshape(k, k).copy()
        at += k + k * k
    return f


def imm_fused(stream: DataFrame) -> DataFrame:
    """Filtered states of system tracks (system_track_id, source, time_sec, e, n, u) as reports arrive in order.

    The state of a track is its filter; the first report waits for the second, which gives the first motion.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).dropna(subset=["e", "n"]).sort_values("time_sec", kind="stable")
        before, values, held = state.get if state.exists else (None, None, None)
        imm = _unpacked(values) if values else None
        points = [(t, np.array([e, n, 0.0 if np.isnan(u) else u]), s) for t, e, n, u, s in zip(*(rows[c] for c in ("time_sec", "e", "n", "u", "source")), strict=True)]
        if imm is None:
            waiting = [(held[0], np.array(held[1:4]), "adsb" if len(held) < 5 else SOURCE_ORDER[int(held[4])])] if held else []
            points = waiting + points
            if len(points) < 2:
                if points:
                    t, p, s = points[0]
                    state.update((t, [], [t, *p, float(SOURCE_ORDER.index(s))]))
                return
            (t0, p0, _), (t1, p1, _) = points[:2]
            motion = (p1 - p0) / max(t1 - t0, LEAST_STEP)
            motion[2] = 0.0
            imm, before = Filter(np.concatenate([p0, motion])), t0
        out = []
        for t, p, s in points:
            dt, before = max(t - before, LEAST_STEP), t
            e, n, u, ve, vn, vu = imm.step(p, dt, _VARIANCE.get(s, _VARIANCE["radar"]))
            out.append((key[0], t, e, n, u, ve, vn, vu, np.hypot(ve, vn), np.degrees(np.arctan2(ve, vn)) % 360, s, 1, *imm.mu, imm.models[1].x[6]))
        state.update((float(before), _packed(imm), []))
        yield pd.DataFrame(out, columns=FUSED.names)

    rows = stream.select("system_track_id", "source", "time_sec", "e", "n", "u")
    return rows.groupBy("system_track_id").applyInPandasWithState(follow, FUSED, _FILTER, "append", GroupStateTimeout.NoTimeout)


SOURCE_ORDER = ("adsb", "remote_id", "radar", "spectrum")
