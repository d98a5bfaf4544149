"""Interacting-multiple-model Kalman fusion of a system track's reports.

Inherently sequential per track: reports are grouped by track and filtered in order by NumPy code, a step of many
tracks at once; ``filter_track`` is the plain form for one. Three motion
models run side by side: constant velocity (6 states), coordinated turn with an estimated turn rate (7) and
constant acceleration (9). They exchange position and velocity at each step by the model probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ACCURACY

# Fixed values of the filter.
START_PROBABILITY = np.array([0.5, 0.25, 0.25])
TRANSITION = np.array([[0.85, 0.08, 0.07], [0.10, 0.80, 0.10], [0.10, 0.10, 0.80]])
NOISE = {"cv": 0.5, "ct": 3.0, "ca": 8.0}
TURN_NOISE = 0.001
STATE_VARIANCE, TURN_VARIANCE, ACCELERATION_VARIANCE = 100.0, 0.01, 10.0
LEAST_TURN = 1e-4
LOG_LIMIT = 500.0
LEAST_STEP = 0.01
ADAPTIVE_R = np.diag([25.0, 25.0, 50.0])
TOGETHER = 20_000  # reports whose tracks are filtered together
ADAPTIVE_KEEP, ADAPTIVE_LAST, ADAPTIVE_LEAST, ADAPTIVE_BUFFER = 0.7, 8, 4, 12


def chain(order: int, dt: float) -> np.ndarray:
    """Transition of a chain of ``order`` integrators: 2 is position and velocity, 3 adds acceleration."""
    row = [1.0, dt, dt * dt / 2][:order]
    return np.array([[row[j - i] if j >= i else 0.0 for j in range(order)] for i in range(order)])


def chain_noise(order: int, dt: float, q: float) -> np.ndarray:
    """Covariance that white noise of strength q on the last integrator leaves after dt."""
    out = np.empty((order, order))
    for i in range(order):
        for j in range(order):
            a, b = order - 1 - i, order - 1 - j
            scale = [1, 1, 2][a] * [1, 1, 2][b]
            out[i, j] = q * dt ** (a + b + 1) / ((a + b + 1) * scale)
    return out


@dataclass
class Model:
    """State as (axis, derivative) laid out derivative-first: e, n, u, ve, vn, vu, ..."""

    kind: str
    x: np.ndarray
    p: np.ndarray
    adaptive_r: np.ndarray = field(default_factory=ADAPTIVE_R.copy)
    innovations: list = field(default_factory=list)

    @staticmethod
    def start(kind: str, state: np.ndarray) -> "Model":
        size = {"cv": 6, "ct": 7, "ca": 9}[kind]
        p = np.eye(size) * STATE_VARIANCE
        if kind == "ct":
            p[6, 6] = TURN_VARIANCE
        if kind == "ca":
            p[6:, 6:] = np.eye(3) * ACCELERATION_VARIANCE
        return Model(kind, np.concatenate([state, np.zeros(size - 6)]), p)

    def _turn_jacobian(self, dt: float) -> np.ndarray:
        jacobian = np.eye(7)
        ve, vn, w = self.x[3], self.x[4], self.x[6]
        jacobian[2, 5] = dt
        if abs(w) <= LEAST_TURN:
            jacobian[0, 3] = jacobian[1, 4] = dt
            return jacobian
        s, c = np.sin(w * dt), np.cos(w * dt)
        jacobian[:2, 3:5] = np.array([[s, c - 1], [1 - c, s]]) / w
        jacobian[3:5, 3:5] = [[c, -s], [s, c]]
        # derivatives by the turn rate
        ds, dc = (w * dt * c - s) / w**2, (w * dt * s - (1 - c)) / w**2
        jacobian[0, 6] = ve * ds - vn * dc
        jacobian[1, 6] = ve * dc + vn * ds
        jacobian[3:5, 6] = dt * np.array([-ve * s - vn * c, ve * c - vn * s])
        return jacobian

    def predict(self, dt: float) -> None:
        if self.kind == "ct":
            w, (ve, vn) = self.x[6], self.x[3:5].copy()
            if abs(w) > LEAST_TURN:
                s, c = np.sin(w * dt), np.cos(w * dt)
                self.x[:2] += [(ve * s - vn * (1 - c)) / w, (ve * (1 - c) + vn * s) / w]
                self.x[3:5] = [ve * c - vn * s, ve * s + vn * c]
            else:
                self.x[:2] += dt * self.x[3:5]
            self.x[2] += dt * self.x[5]
            # the Jacobian is taken at the state already moved on
            f = self._turn_jacobian(dt)
            q = np.zeros((7, 7))
            q[:6, :6] = np.kron(chain_noise(2, dt, NOISE["ct"]), np.eye(3))
            q[6, 6] = TURN_NOISE * dt
        else:
            order = 2 if self.kind == "cv" else 3
            f, q = np.kron(chain(order, dt), np.eye(3)), np.kron(chain_noise(order, dt, NOISE[self.kind]), np.eye(3))
            self.x = f @ self.x
        self.p = f @ self.p @ f.T + q

    def update(self, z: np.ndarray, r: np.ndarray | None) -> float:
        """Correct by a position; the likelihood of it. Without ``r`` the noise adapts to the innovations."""
        y = z - self.x[:3]
        self.innovations = [*self.innovations, y][-ADAPTIVE_BUFFER:]
        if len(self.innovations) >= ADAPTIVE_LEAST:
            last = np.array(self.innovations[-ADAPTIVE_LAST:])
            self.adaptive_r = ADAPTIVE_KEEP * self.adaptive_r + (1 - ADAPTIVE_KEEP) * (last.T @ last) / len(last)
        r = self.adaptive_r if r is None else r
        s = self.p[:3, :3] + r
        inverse = np.linalg.inv(s)
        gain = self.p[:, :3] @ inverse
        self.x = self.x + gain @ y
        keep = np.eye(len(self.x))
        keep[:, :3] -= gain
        self.p = keep @ self.p @ keep.T + gain @ r @ gain.T
        log = -0.5 * (y @ inverse @ y + np.log((2 * np.pi) ** 3 * max(abs(np.linalg.det(s)), 1e-30)))
        return max(float(np.exp(np.clip(log, -LOG_LIMIT, LOG_LIMIT))), 1e-300)


class Filter:
    def __init__(self, state: np.ndarray):
        self.models = [Model.start(kind, state) for kind in ("cv", "ct", "ca")]
        self.mu = START_PROBABILITY.copy()

    def step(self, z: np.ndarray, dt: float, r: np.ndarray | None) -> np.ndarray:
        prior = np.maximum(TRANSITION.T @ self.mu, 1e-30)
        share = TRANSITION * self.mu[:, None] / prior[None, :]
        xs = np.array([m.x[:6] for m in self.models])
        ps = np.array([m.p[:6, :6] for m in self.models])
        mixed = share.T @ xs
        for j, m in enumerate(self.models):
            d = xs - mixed[j]
            # only the common block is mixed; covariances with further states stay as they were
            m.p[:6, :6] = np.einsum("i,ikl->kl", share[:, j], ps + d[:, :, None] * d[:, None, :])
            m.x[:6] = mixed[j]
        likelihood = np.empty(3)
        for j, m in enumerate(self.models):
            m.predict(dt)
            likelihood[j] = m.update(z, r)
        mu = prior * likelihood
        total = np.nansum(mu)
        self.mu = mu / total if np.isfinite(total) and total > 1e-30 else START_PROBABILITY.copy()
        return self.mu @ np.array([m.x[:6] for m in self.models])


FUSED = T.StructType(
    [
        T.StructField("system_track_id", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("time_sec", "e", "n", "u", "ve", "vn", "vu", "speed", "heading")],
        T.StructField("sources", T.StringType()),
        T.StructField("source_count", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("model_cv_prob", "model_ct_prob", "model_ca_prob", "omega_est")],
    ]
)
_VARIANCE = {s: np.diag([h * h, h * h, a * a]) for s, (h, a, _) in ACCURACY.items()}


def filter_track(track: pd.DataFrame) -> pd.DataFrame:
    """Filtered states of one system track's reports (two or more) in order of time.

    Reports without a position give no row, but time moves on with them.
    """
    track = track.sort_values(["time_sec", "source_rank", "obs_id"], kind="stable")
    if len(track) < 2:
        return pd.DataFrame(columns=FUSED.names)
    t, place = track["time_sec"].to_numpy(), track[["e", "n", "u"]].to_numpy(float)
    known = ~np.isnan(place[:, :2]).any(axis=1)
    place = np.nan_to_num(place)
    first_step = max(t[1] - t[0], LEAST_STEP)
    motion = (place[1] - place[0]) / first_step if known[0] and known[1] else np.zeros(3)
    motion[2] = 0.0
    imm, before, rows = Filter(np.concatenate([place[0], motion])), t[0], []
    for k in range(len(track)):
        dt, before = max(t[k] - before, LEAST_STEP), t[k]
        if not known[k]:
            continue
        source = track["source"].iloc[k]
        e, n, u, ve, vn, vu = imm.step(place[k], dt, _VARIANCE.get(source, _VARIANCE["radar"]))
        rows.append((track["system_track_id"].iloc[0], t[k], e, n, u, ve, vn, vu, np.hypot(ve, vn), np.degrees(np.arctan2(ve, vn)) % 360, source, 1, *imm.mu, imm.models[1].x[6]))
    return pd.DataFrame(rows, columns=FUSED.names)


def _chains(order: int, dt: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """``chain`` and ``chain_noise`` of each dt, for three axes, derivative-first."""
    f, noise = np.zeros((2, len(dt), 3 * order, 3 * order))
    for i in range(order):
        for j in range(order):
            a, b = order - 1 - i, order - 1 - j
            for k in range(3):
                noise[:, 3 * i + k, 3 * j + k] = q * dt ** (a + b + 1) / ((a + b + 1) * [1, 1, 2][a] * [1, 1, 2][b])
                if j >= i:
                    f[:, 3 * i + k, 3 * j + k] = [1, dt, dt * dt / 2][j - i]
    return f, noise


def _turned(x: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of the turn model moved on, and the Jacobians at these, as ``Model.predict`` has them."""
    w, ve, vn = x[:, 6], x[:, 3].copy(), x[:, 4].copy()
    turns = ~(np.abs(w) <= LEAST_TURN)
    by = np.where(turns, w, 1.0)
    s, c = np.sin(by * dt), np.cos(by * dt)
    x = x.copy()
    x[:, 0] += np.where(turns, (ve * s - vn * (1 - c)) / by, dt * ve)
    x[:, 1] += np.where(turns, (ve * (1 - c) + vn * s) / by, dt * vn)
    x[:, 3], x[:, 4] = np.where(turns, ve * c - vn * s, ve), np.where(turns, ve * s + vn * c, vn)
    x[:, 2] += dt * x[:, 5]
    ve, vn = x[:, 3], x[:, 4]
    ds, dc = (by * dt * c - s) / by**2, (by * dt * s - (1 - c)) / by**2
    f = np.zeros((len(x), 7, 7))
    f[:, range(7), range(7)] = 1.0
    f[:, 2, 5] = dt
    bent = {(0, 3): s / by, (0, 4): (c - 1) / by, (1, 3): (1 - c) / by, (1, 4): s / by, (3, 3): c, (3, 4): -s, (4, 3): s, (4, 4): c}
    bent |= {(0, 6): ve * ds - vn * dc, (1, 6): ve * dc + vn * ds, (3, 6): dt * (-ve * s - vn * c), (4, 6): dt * (ve * c - vn * s)}
    for (i, j), value in bent.items():
        f[:, i, j] = np.where(turns, value, dt if (i, j) in ((0, 3), (1, 4)) else float(i == j))
    return x, f


def _corrected(x: np.ndarray, p: np.ndarray, z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, s = z - x[:, :3], p[:, :3, :3] + r
    inverse = np.linalg.inv(s)
    gain = p[:, :, :3] @ inverse
    x = x + (gain @ y[:, :, None])[:, :, 0]
    keep = np.broadcast_to(np.eye(x.shape[1]), p.shape).copy()
    keep[:, :, :3] -= gain
    p = keep @ p @ keep.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1)
    log = -0.5 * (np.einsum("si,sij,sj->s", y, inverse, y) + np.log((2 * np.pi) ** 3 * np.maximum(np.abs(np.linalg.det(s)), 1e-30)))
    return x, p, np.maximum(np.exp(np.clip(log, -LOG_LIMIT, LOG_LIMIT)), 1e-300)


def filter_tracks(rows: pd.DataFrame) -> pd.DataFrame:
    """``filter_track`` of many tracks at once: rows lie track by track, in order; a step is one of all tracks."""
    name = rows["system_track_id"].to_numpy()
    start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    size = np.diff(np.r_[start, len(name)])
    start, size = (x[np.argsort(-size, kind="stable")] for x in (start, size))  # the longest first: those that go on lead
    many = int((size >= 2).sum())
    start, size = start[:many], size[:many]
    if not many:
        return pd.DataFrame(columns=FUSED.names)
    t, place, source = rows["time_sec"].to_numpy(float), rows[["e", "n", "u"]].to_numpy(float), rows["source"].to_numpy()
    known = ~np.isnan(place[:, :2]).any(axis=1)
    place = np.nan_to_num(place)
    variance = np.array([_VARIANCE.get(x, _VARIANCE["radar"]) for x in pd.unique(source)])[pd.factorize(source)[0]]
    motion = (place[start + 1] - place[start]) / np.maximum(t[start + 1] - t[start], LEAST_STEP)[:, None]
    motion[~(known[start] & known[start + 1])] = 0.0
    motion[:, 2] = 0.0
    models = [Model.start(kind, np.zeros(6)) for kind in ("cv", "ct", "ca")]
    xs = [np.zeros((many, len(m.x))) for m in models]
    for x in xs:
        x[:, :6] = np.concatenate([place[start], motion], axis=1)
    ps = [np.broadcast_to(m.p, (many, *m.p.shape)).copy() for m in models]
    mu, before = np.broadcast_to(START_PROBABILITY, (many, 3)).copy(), t[start].copy()
    out = np.empty((len(t), 10))
    done = np.zeros(len(t), bool)
    for k in range(int(size[0])):
        going = int(np.searchsorted(-size, -k))  # tracks longer than k
        at = start[:going] + k
        step, before[:going] = np.maximum(t[at] - before[:going], LEAST_STEP), t[at]
        g = np.flatnonzero(known[at])
        if not len(g):
            continue
        at, dt, z, r = at[g], step[g], place[at[g]], variance[at[g]]
        prior = np.maximum(mu[g] @ TRANSITION, 1e-30)
        share = TRANSITION * mu[g][:, :, None] / prior[:, None, :]
        x6, p6 = np.stack([x[g, :6] for x in xs], axis=1), np.stack([p[g][:, :6, :6] for p in ps], axis=1)
        mixed = share.transpose(0, 2, 1) @ x6
        likelihood = np.empty((len(g), 3))
        for j in range(3):
            d = x6 - mixed[:, j, None]
            x, p = xs[j][g], ps[j][g]
            p[:, :6, :6] = np.einsum("si,sikl->skl", share[:, :, j], p6 + d[:, :, :, None] * d[:, :, None, :])
            x[:, :6] = mixed[:, j]
            if j == 1:
                x, f = _turned(x, dt)
                q = np.zeros((len(g), 7, 7))
                q[:, :6, :6] = _chains(2, dt, NOISE["ct"])[1]
                q[:, 6, 6] = TURN_NOISE * dt
            else:
                f, q = _chains(2, dt, NOISE["cv"]) if j == 0 else _chains(3, dt, NOISE["ca"])
                x = (f @ x[:, :, None])[:, :, 0]
            xs[j][g], ps[j][g], likelihood[:, j] = _corrected(x, f @ p @ f.transpose(0, 2, 1) + q, z, r)
        new = prior * likelihood
        total = np.nansum(new, axis=1)
        fine = np.isfinite(total) & (total > 1e-30)
        mu[g] = np.where(fine[:, None], new / np.where(fine, total, 1.0)[:, None], START_PROBABILITY)
        out[at, :6] = np.einsum("si,sik->sk", mu[g], np.stack([x[g, :6] for x in xs], axis=1))
        out[at, 6:9], out[at, 9] = mu[g], xs[1][g, 6]
        done[at] = True
    at = np.flatnonzero(done)
    e, n, u, ve, vn, vu, *last = out[at].T
    return pd.DataFrame(dict(zip(FUSED.names, (name[at], t[at], e, n, u, ve, vn, vu, np.hypot(ve, vn), np.degrees(np.arctan2(ve, vn)) % 360, source[at], np.ones(len(at), np.int32), *last), strict=True)))


def _filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tracks, ``TOGETHER`` reports or more at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= TOGETHER:
            rows = pd.concat(held, ignore_index=True)
            ends = rows["system_track_id"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])[-1])  # the last track may go on
            if cut:
                yield filter_tracks(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
            size = 0 if not cut else len(held[0])
    if held:
        yield filter_tracks(pd.concat(held, ignore_index=True))


def imm_fused(obs: DataFrame, groups: DataFrame) -> DataFrame:
    """Fused tracks of the groups (system_track_id, source, target_id). A shuffle by track, then Arrow batches."""
    names = ("system_track_id", "source", "source_rank", "obs_id", "time_sec", "e", "n", "u")
    rows = obs.where("source != 'spectrum'").join(groups, ["source", "target_id"]).select(*names)
    spark = obs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = rows.repartition(parts, "system_track_id").sortWithinPartitions("system_track_id", F.col("time_sec").asc_nulls_last(), "source_rank", "obs_id")
    return ordered.mapInPandas(_filtered, FUSED)
