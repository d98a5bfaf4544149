"""Pairs of near tracks, held against each other a cell at a time by NumPy.

A pair takes no row of its own until its reports have met: tracks meet by cells of the plane, and the nearest
reports in time of all pairs of a cell are found by one search in the cell's sorted times. Cells with many reports
are dealt in parts, each part of one side to each part of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SOURCES, Association
from .graph import cut

STATE = ("t", "e", "n", "u", "speed", "heading", "climb")
KEYS = ("source_a", "target_id_a", "source_b", "target_id_b")
DETAILS = ("dist_3d_m", "d_alt_m", "speed_diff_ms", "heading_diff_deg", "time_window_sec")
PART_A, PART_B = 1 << 16, 1 << 19  # reports in a part of a cell: those that stream, those that are held
BLOCK = 1 << 20  # centroids held against each other at once
_TRACK = ("source_rank", "source", "target_id", "t_min", "t_max", "e_c", "n_c", "n_rows", "reports")


def reported(obs: DataFrame, least: int = 5) -> DataFrame:
    """``associate.track_summary`` with ``reports``, an array of each track's states in any order.

    One grouping, written to the shared folder, as it is read several times.
    """
    rows = obs.where("source != 'spectrum' and target_id is not null")
    state = F.struct(F.col("time_sec").alias("t"), "obs_id", "e", "n", "u", "speed", "heading", F.col("climb_rate").alias("climb"))
    found = rows.groupBy("source_rank", "source", "target_id").agg(F.min("time_sec").alias("t_min"), F.max("time_sec").alias("t_max"), F.avg("e").alias("e_c"), F.avg("n").alias("n_c"), F.collect_list(state).alias("reports"))
    found = found.withColumn("n_rows", F.size("reports").cast("long")).where((F.col("n_rows") >= least) & F.col("e_c").isNotNull() & F.col("n_c").isNotNull())
    return cut(found.select(*_TRACK))


class Tracks:
    """Tracks with their reports laid end to end, in order of time, those without a time last."""

    def __init__(self, table: pa.Table):
        column = {c: table[c].combine_chunks() for c in _TRACK}
        self.source, self.target = column["source"], column["target_id"]
        self.rank, self.t_min, self.t_max, self.e_c, self.n_c, self.n_rows = (column[c].to_numpy(zero_copy_only=False) for c in ("source_rank", "t_min", "t_max", "e_c", "n_c", "n_rows"))
        names = np.array(self.source.to_pylist(), object)
        self.remote, self.radar = names == "remote_id", names == "radar"
        size = column["reports"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        flat = column["reports"].flatten()
        fields = {c: flat.field(c) for c in STATE}
        state = {c: x.to_numpy(zero_copy_only=False).astype(float) for c, x in fields.items()}
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat.field("obs_id").to_numpy(zero_copy_only=False), state["t"], owner))
        self.t, self.e, self.n, self.u, self.speed, self.heading, self.climb = (state[c][order] for c in STATE)
        self.no_speed = fields["speed"].is_null().to_numpy(zero_copy_only=False)[order]
        self.still = self.no_speed | np.isnan(self.heading)
        self.climb = np.nan_to_num(self.climb, nan=0.0)
        turn = np.radians(self.heading)
        self.ve, self.vn = self.speed * np.sin(turn), self.speed * np.cos(turn)
        times, rank = np.unique(self.t, return_inverse=True)
        self.ranks, self.at = len(times) + 1, rank.astype(np.int64)
        self.owner, self.key = owner, owner * self.ranks + self.at
        new = np.ones(len(self.key), bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        # all reports of three or fewer, else the first, the middle and the last
        few = size[:, None] <= 3
        k = np.where(few, np.arange(3), np.stack([0 * size, size // 2, size - 1], axis=1))
        self.probe = np.where(k < size[:, None], k, -1)

    def nearest(self, report: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For each report the one of another track that is nearest in time, the earliest of such."""
        at = np.searchsorted(self.key, other * self.ranks + self.at[report])
        left, right = np.maximum(at - 1, self.start[other]), np.minimum(at, self.end[other] - 1)
        t = self.t[report]
        with np.errstate(invalid="ignore"):
            return np.where(np.abs(t - self.t[right]) < np.abs(t - self.t[left]), right, self.first[left])

    def score(self, x: np.ndarray, y: np.ndarray, p: Association) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray | None]]]:
        """As ``associate.similarity``: scores (NaN where SQL has null), details with masks of what is null."""
        with np.errstate(invalid="ignore", over="ignore"):
            d3 = np.sqrt((self.e[x] - self.e[y]) ** 2 + (self.n[x] - self.n[y]) ** 2 + (self.u[x] - self.u[y]) ** 2)
            dv = np.sqrt((self.ve[x] - self.ve[y]) ** 2 + (self.vn[x] - self.vn[y]) ** 2 + (self.climb[x] - self.climb[y]) ** 2)
            still = self.still[x] | self.still[y]
            turn = np.abs(self.heading[x] - self.heading[y])
            dh, du = np.minimum(turn, 360.0 - turn), np.abs(self.u[x] - self.u[y])
            speed = self.speed[x]
            speed = np.where(~self.no_speed[x] & ~(speed <= 0), speed, 10.0)  # SQL's NaN is above 0
            window = np.maximum(120.0, np.fmin(180.0, 5.0 / speed))
            rejected = (np.abs(self.t[x] - self.t[y]) > window) | (d3 > p.max_distance_m) | (~still & ~(dv <= p.max_speed_diff)) | (dh > p.max_heading_diff)
            sigma = p.max_distance_m / 3
            score = (
                0.35 * np.exp(-(d3 * d3) / (2 * sigma * sigma))
                + 0.25 * np.where(still, 0.5, 1 - dv / p.max_speed_diff)
                + 0.20 * np.where(np.isnan(dh), 0.5, 1 - dh / p.max_heading_diff)
                + 0.20 * np.where(du > p.max_altitude_diff, 0.0, 1 - du / p.max_altitude_diff)
            )
        score[rejected] = 0.0
        return score, dict(zip(DETAILS, ((d3, np.isnan(d3)), (du, np.isnan(du)), (dv, still), (dh, np.isnan(dh)), (window, None)), strict=True))


def _blocks(all_: Tracks, many: int, p: Association) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (numbers of tracks) of the first ``many`` tracks with the others, a block at a time."""
    a, b = slice(0, many), slice(many, None)
    e, n, rank, t_min, t_max, radar = (x[b] for x in (all_.e_c, all_.n_c, all_.rank, all_.t_min, all_.t_max, all_.radar))
    step = max(1, BLOCK // max(1, len(e)))
    for k in range(0, many, step):
        a = slice(k, min(k + step, many))
        far = np.sqrt((all_.e_c[a, None] - e) ** 2 + (all_.n_c[a, None] - n) ** 2)
        near = far <= p.coarse_m
        if p.coarse_close_m != p.coarse_m:
            near &= (far <= p.coarse_close_m) | ~(all_.remote[a, None] & radar)
        near &= all_.rank[a, None] < rank
        near &= (all_.t_min[a, None] <= t_max) & (t_min <= all_.t_max[a, None])
        i, j = np.nonzero(near)
        if len(i):
            yield i + k, j + many


def _probes(all_: Tracks, i: np.ndarray, j: np.ndarray, p: Association) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the first, second and third probe: pairs (positions in i, j), the probe's number, its report, the report it met."""
    of_a = all_.n_rows[i] <= all_.n_rows[j]
    base, other = np.where(of_a, i, j), np.where(of_a, j, i)
    for c in range(3):
        number = all_.probe[base, c]
        pair = np.flatnonzero(number >= 0)
        x = all_.start[base[pair]] + number[pair]
        y = all_.nearest(x, other[pair])
        with np.errstate(invalid="ignore"):
            keep = np.flatnonzero(np.abs(all_.t[x] - all_.t[y]) <= p.max_gap_s)
            pair, x, y = pair[keep], x[keep], y[keep]
            keep = np.flatnonzero(np.sqrt((all_.e[x] - all_.e[y]) ** 2 + (all_.n[x] - all_.n[y]) ** 2) <= p.max_fine_m)
        pair, x, y = pair[keep], x[keep], y[keep]
        yield pair, number[pair], x, y


def _named(all_: Tracks, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    return [column.take(pa.array(k)) for k in (i, j) for column in (all_.source, all_.target)]


def _units(tracks: DataFrame, p: Association) -> DataFrame:
    """Tracks as they are dealt to tasks: unit, side (0: held, 1: streams), the track's columns."""
    side = 2 * p.coarse_m
    spatial = len(SOURCES) - 1
    a = tracks.where(F.col("source_rank") < spatial - 1).withColumns({"cx": F.floor(F.col("e_c") / side), "cy": F.floor(F.col("n_c") / side)})
    b = tracks.where("source_rank > 0")
    for c, at in (("cx", "e_c"), ("cy", "n_c")):  # every cell that the largest distance reaches
        b = b.withColumn(c, F.explode(F.sequence(*[F.floor((F.col(at) + d) / side) for d in (-p.coarse_m, p.coarse_m)])))
    count = {"a": a.groupBy("cx", "cy").agg(F.ceil(F.sum("n_rows") / PART_A).alias("a")), "b": b.groupBy("cx", "cy").agg(F.ceil(F.sum("n_rows") / PART_B).alias("b"))}
    large = count["a"].join(count["b"], ["cx", "cy"]).where("a > 1 or b > 1")  # as many as there are parts at most

    def dealt(rows: DataFrame, own: str, other: str, number: int) -> DataFrame:
        rows = rows.select("cx", "cy", *_TRACK).join(F.broadcast(large), ["cx", "cy"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in "ab"})
        rows = rows.withColumns({f"part_{own}": F.pmod(F.xxhash64("source", "target_id"), own), f"part_{other}": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        return rows.select(F.concat_ws(":", "cx", "cy", "part_a", "part_b").alias("unit"), F.lit(number).alias("side"), *_TRACK)

    return dealt(b, "b", "a", 0).unionByName(dealt(a, "a", "b", 1))


def _met(tracks: DataFrame, p: Association, schema: str, rows) -> DataFrame:
    """``rows(all, i, j)`` gives the columns of a block of candidate pairs."""
    spark = tracks.sparkSession
    units = _units(tracks, p)
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            label = np.array([f"{x}/{y}" for x, y in zip(batch.column("unit").to_pylist(), batch.column("side").to_pylist(), strict=True)], object)
            cuts = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)] if len(label) else [0]
            for s, e in zip(cuts, cuts[1:]):
                unit, side = label[s].rsplit("/", 1)
                part = batch.slice(s, e - s).select(list(_TRACK))
                if unit != now:
                    now, held, size = unit, [], 0
                if side == "0":
                    held.append(part)
                    size += len(part)
                elif held:
                    if len(held) > 1:
                        held = pa.Table.from_batches(held).combine_chunks().to_batches()
                    all_ = Tracks(pa.Table.from_batches([part, *held]))
                    for i, j in _blocks(all_, len(part), p):
                        yield from rows(all_, i, j)

    dealt = units.repartition(many, "unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(run, schema)


_KEY_SCHEMA = ", ".join(f"{c} string" for c in KEYS)


def probes_met(tracks: DataFrame, p: Association = Association(), scores: bool = True) -> DataFrame:
    """Rows of ``associate.nearest_matches`` (keys, probe, t1, t2) and, with ``scores``, score and details.

    ``tracks``: as ``reported`` gives them.
    """
    details = ("score", *DETAILS) if scores else ()
    schema = f"{_KEY_SCHEMA}, probe long, t1 double, t2 double" + "".join(f", {c} double" for c in details)

    def rows(all_: Tracks, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for pair, number, x, y in _probes(all_, i, j, p):
            values = [*_named(all_, i[pair], j[pair]), pa.array(number, pa.int64()), pa.array(all_.t[x]), pa.array(all_.t[y])]
            if scores:
                score, more = all_.score(x, y, p)
                values += [pa.array(score, mask=np.isnan(score)), *(pa.array(v, mask=m) for v, m in more.values())]
            if len(pair):
                yield pa.RecordBatch.from_arrays(values, [*KEYS, "probe", "t1", "t2", *details])

    return _met(tracks, p, schema, rows)


def pairs_met(tracks: DataFrame, p: Association = Association(), least: float = 0.0) -> DataFrame:
    """Keys and score of the best probe of each pair, where it is ``least`` or more; among equal ones of the first.

    ``k_base`` and ``k_other``: places, in order of time, of the report that probes and of the one it met.
    """

    def rows(all_: Tracks, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        best, at = np.full(len(i), -1.0), np.zeros((2, len(i)), np.int64)
        for pair, _, x, y in _probes(all_, i, j, p):
            score = np.nan_to_num(all_.score(x, y, p)[0], nan=-1.0)
            better = np.flatnonzero(score > best[pair])
            best[pair[better]], at[:, pair[better]] = score[better], (x[better], y[better])
        pair = np.flatnonzero((best >= least) & (best >= 0))
        if len(pair):
            k = at[:, pair] - all_.start[all_.owner[at[:, pair]]]
            yield pa.RecordBatch.from_arrays([*_named(all_, i[pair], j[pair]), pa.array(best[pair]), *(pa.array(x, pa.int32()) for x in k)], [*KEYS, "score", "k_base", "k_other"])

    return _met(tracks, p, _KEY_SCHEMA + ", score double, k_base int, k_other int", rows)


def states_met(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """The pairs with the states that met as columns {t,e,n,u,speed,heading,climb}1 and 2."""
    ordered = tracks.withColumn("reports", F.array_sort(F.transform("reports", lambda r: F.struct(r["t"].isNull(), r["t"].alias("t"), r["obs_id"], *[r[c].alias(c) for c in STATE[1:]]))))
    rows = pairs
    for x in "ab":
        rows = rows.join(ordered.select(F.col("source").alias(f"source_{x}"), F.col("target_id").alias(f"target_id_{x}"), F.col("n_rows").alias(f"n_rows_{x}"), F.col("reports").alias(f"reports_{x}")), [f"source_{x}", f"target_id_{x}"])
    base_a = F.col("n_rows_a") <= F.col("n_rows_b")
    s1, s2 = (F.get(F.when(base_a, F.col(f"reports_{x}")).otherwise(F.col(f"reports_{y}")), F.col(k)) for x, y, k in (("a", "b", "k_base"), ("b", "a", "k_other")))
    rows = rows.select(*pairs.columns, s1.alias("s1"), s2.alias("s2"))
    return rows.select(*pairs.columns, *[F.col(f"s{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in STATE])
