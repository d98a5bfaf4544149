"""Pairs of tracks met a cell at a time give what the plain form gives; greedy matching in bands; parts of large cells."""

import random

import numpy as np
import pandas as pd
import pytest

from aeroweave.config import Association
from aeroweave.operators import associate, graph, imm, pairs

KEYS = ("source_a", "target_id_a", "source_b", "target_id_b")


@pytest.fixture(scope="module")
def obs(spark):
    random.seed(11)
    rows = []
    for source, rank in (("adsb", 0), ("remote_id", 1), ("radar", 2)):
        for k in range(25):
            e, n = random.uniform(-700, 700), random.uniform(-700, 700)
            for _ in range(random.choice((3, 5, 6, 9))):
                lost, speed = random.random() < 0.1, random.choice((None, 0.0, 0.02, 8.0, 45.0, float("nan")))
                place = (None, None) if lost else (e + random.uniform(-200, 200), n + random.uniform(-200, 200))
                rows.append((len(rows), source, rank, f"t{k}", float(random.randrange(40)) * 10, *place, None if random.random() < 0.1 else random.uniform(0, 700), speed, random.choice((None, 10.0, 80.0, 200.0, 350.0)), random.choice((None, 0.0, 60.0))))
    return spark.createDataFrame(rows, "obs_id long, source string, source_rank int, target_id string, time_sec double, e double, n double, u double, speed double, heading double, climb_rate double").cache()


def plain(obs, p):
    return associate.nearest_matches(associate.coarse_candidates(associate.with_reports(associate.track_summary(obs, p.min_rows), obs), p), p)


def values(rows, names):
    return sorted((tuple(str(round(r[c], 9)) if isinstance(r[c], float) else str(r[c]) for c in names) for r in rows))


@pytest.mark.parametrize("least,parts", ((5, False), (3, True)))
def test_pairs_of_a_cell_equal_the_plain_form(spark, obs, monkeypatch, least, parts):
    if parts:  # every cell in several parts, blocks of a few tracks
        monkeypatch.setattr(pairs, "PART_A", 12)
        monkeypatch.setattr(pairs, "PART_B", 25)
        monkeypatch.setattr(pairs, "BLOCK", 20)
    p = Association(min_rows=least)
    want = plain(obs, p).collect()
    names = (*KEYS, "probe", "t1", "t2", "score", *pairs.DETAILS)
    assert len(want) > 200
    assert values(pairs.probes_met(pairs.reported(obs, least), p).collect(), names) == values(want, names)


def test_best_pairs_equal_the_plain_form(spark, obs):
    p = Association()
    tracks = pairs.reported(obs)
    best = associate.best_matches(plain(obs, p).where("score >= 0.3"))
    met = pairs.states_met(pairs.pairs_met(tracks, p, 0.3), tracks).withColumns(associate.similarity(p)[1])
    names = (*KEYS, "t1", "score", *pairs.DETAILS)
    assert values(met.collect(), names) == values(best.collect(), names)


def test_greedy_in_bands(spark, monkeypatch):
    monkeypatch.setattr(graph, "BAND", 4)
    random.seed(4)
    rows = list({(g, a, b): (g, a, b, random.randrange(30) / 30) for g in "xy" for a in map(str, range(30)) for b in map(str, range(25)) if random.random() < 0.4}.values())
    used, want = set(), set()
    for g, a, b, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if not {(g, 0, a), (g, 1, b)} & used:
            used |= {(g, 0, a), (g, 1, b)}
            want.add((g, a, b))
    got = graph.greedy_matching(spark.createDataFrame(rows, "g string, a string, b string, s double"), ("g",), "a", "b", "s")
    assert {(r.g, r.a, r.b) for r in got.collect()} == want


def test_components_of_few_edges_take_no_rounds(spark):
    random.seed(6)
    ids = [f"n{k}" for k in random.sample(range(900), 900)]
    edges = [(ids[k], ids[k + 1]) for k in range(len(ids) - 1) if k % 100]
    want = {x: min(ids[k - k % 100 + 1 : k - k % 100 + 101] if k % 100 else ids[k - 99 : k + 1]) for k, x in enumerate(ids) if k}
    spark.sparkContext.setJobGroup("path", "components of paths")
    got = dict(graph.components(spark.createDataFrame(edges, "a string, b string")).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs <= 8


def test_tracks_filtered_together_equal_one_by_one():
    rng, tracks = np.random.default_rng(2), []
    for k in range(40):
        m = int(rng.integers(1, 25))
        t = np.sort(rng.integers(0, 900, m)).astype(float)
        place = rng.normal(0, 500, (1, 3)) + t[:, None] * rng.normal(0, 5, (1, 3)) + rng.normal(0, 30, (m, 3))
        place[rng.random(m) < 0.15] = np.nan
        tracks.append(pd.DataFrame({"system_track_id": f"ST{k:04}", "source": rng.choice(["adsb", "remote_id", "radar"], m), "source_rank": 0, "obs_id": range(m), "time_sec": t, **dict(zip("enu", place.T))}))
    want = pd.concat([imm.filter_track(x) for x in tracks], ignore_index=True)
    got = pd.concat(imm._filtered(iter([*np.array_split(pd.concat(tracks), 7)])), ignore_index=True)
    got = got.sort_values(["system_track_id", "time_sec"], kind="stable", ignore_index=True)
    assert len(want) > 200 and (got[["system_track_id", "sources"]] == want[["system_track_id", "sources"]]).all().all()
    numbers = [c for c in imm.FUSED.names if c not in ("system_track_id", "sources")]
    assert np.allclose(got[numbers].astype(float), want[numbers].astype(float), rtol=1e-6, atol=1e-6)
