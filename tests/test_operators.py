"""Small hand-made cases, properties, and comparisons with plain Python."""

import math
import os
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeroweave.config import Origin, Zone
from aeroweave.functions import geo, rules
from aeroweave.operators import align, anomaly, associate, conflict, evidence, flow, fuse, graph, imm, network, pog
from aeroweave.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_time_strings(spark):
    df = spark.createDataFrame([("01:02:03.5",), ("12:30.25",), ("7.5",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(geo.seconds_of_day(F.col("t"))).collect()] == [3723.5, 750.25, 7.5, None, None]


def test_scalars(spark):
    ve, vn = geo.velocity(F.lit(10.0), F.lit(90.0))
    r = one(spark, ve=ve, vn=vn, turn=geo.turn_between(F.lit(350.0), F.lit(10.0)), window=rules.adaptive_window(F.lit(10.0)))
    assert r.ve == pytest.approx(10) and abs(r.vn) < 1e-9 and r.turn == 20 and r.window == 120
    got = spark.createDataFrame([(20.0, 100.0), (30.0, 500.0), (30.0, 900.0), (90.0, 100.0)], "v double, a double")
    assert [x[0] for x in got.select(rules.category_by_limits(F.col("v"), F.col("a"))).collect()] == ["uav_consumer", "uav_industrial", "unknown", "ga"]


def test_enu_round_trip(spark):
    lat, lon, alt = geo.wgs84(F.lit(1234.5), F.lit(-987.0), F.lit(50.0))
    e, n, u = geo.enu(lat, lon, alt, Origin())
    assert list(one(spark, e=e, n=n, u=u)) == pytest.approx([1234.5, -987.0, 50.0])


def observations(spark, rows):
    """rows: (source, target, t, e, n, u[, speed, heading])"""
    full = [(k, *(list(r) + [None] * (8 - len(r)))) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "obs_id long, source string, target_id string, time_sec double, e double, n double, u double, speed double, heading double")
    ranks = readers.source_rank(F.col("source"))
    return df.withColumns({"source_rank": ranks, "climb_rate": F.lit(None).cast("double"), "lat": F.lit(30.45), "lon": F.lit(114.0), "alt_geom": F.lit(None).cast("double"), "sensor_id": F.lit(0), "frequency": F.lit(433.0)})


def test_outliers(spark):
    rows = [("adsb", "a", float(t), e, 0.0, 0.0) for t, e in enumerate((0.0, 100.0, 10000.0, 300.0))]
    rows += [("radar", "b", 0.0, e, 0.0, 0.0) for e in (0.0, 5.0)] + [("radar", "c", 0.0, 1.0, 0.0, 0.0)] * 2
    got = align.reject_outliers(observations(spark, rows)).orderBy("obs_id").select("e").collect()
    assert [r[0] is None for r in got] == [False, False, True, True, False, True, False, False]


def test_conflicts(spark):
    def pair(v1, v2, gap=1000.0):
        rows = [("a", 0.0, 0.0, 0.0, 0.0, abs(v1), 90.0 if v1 > 0 else 270.0), ("b", 0.0, gap, 0.0, 0.0, abs(v2), 90.0 if v2 > 0 else 270.0)]
        return conflict.conflicts(spark.createDataFrame(rows, "system_track_id string, time_sec double, e double, n double, u double, speed double, heading double")).collect()

    (head_on,) = pair(10.0, -10.0)
    assert (head_on.dcpa_m, head_on.tcpa_s, head_on.rel_speed_ms, head_on.level) == (0.0, 50.0, 20.0, "warning")
    assert pair(-10.0, 10.0) == []
    assert pair(0.5, 0.001, 600.0) == []


def test_evidence(spark):
    a = F.struct(F.lit(0.6).alias("r"), F.lit(0.1).alias("f"), F.lit(0.3).alias("t"))
    b = F.struct(F.lit(0.5).alias("r"), F.lit(0.2).alias("f"), F.lit(0.3).alias("t"))
    both, other = one(spark, m=rules.dempster(a, b)).m, one(spark, m=rules.dempster(b, a)).m
    assert list(both) == pytest.approx([0.63 / 0.83, 0.11 / 0.83, 0.09 / 0.83, 0.17]) and list(both) == pytest.approx(list(other))
    m = one(spark, m=rules.mass_from_detection(F.lit(0.92), F.lit(0.85), F.lit(True))).m
    assert list(m) == pytest.approx([0.6647, 0.0109, 0.3244])
    fused = one(spark, m=evidence.fuse(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(f).alias("f"), F.lit(1 - r - f).alias("t")) for r, f in ((0.9, 0.05), (0.05, 0.9))]))).m
    assert fused.strategy == "murphy" and fused.r + fused.f + fused.t == pytest.approx(1)


def test_greedy_example(spark):
    rows = [("x", "a1", "b1", 0.9), ("x", "a1", "b2", 0.8), ("x", "a2", "b1", 0.7), ("x", "a2", "b2", 0.1)]
    got = graph.greedy_matching(spark.createDataFrame(rows, "g string, a string, b string, s double"), ("g",), "a", "b", "s")
    assert {(r.a, r.b) for r in got.collect()} == {("a1", "b1"), ("a2", "b2")}


def test_greedy_random(spark):
    random.seed(3)
    rows = [("x", f"a{random.randrange(8)}", f"b{random.randrange(8)}", random.randrange(6) / 6) for _ in range(40)]
    rows = list({(g, a, b): (g, a, b, s) for g, a, b, s in rows}.values())
    used, want = set(), set()
    for _, a, b, _s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = graph.greedy_matching(spark.createDataFrame(rows, "g string, a string, b string, s double"), ("g",), "a", "b", "s")
    assert {(r.a, r.b) for r in got.collect()} == want


def test_components_random(spark):
    random.seed(5)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want


def test_confirmation(spark):
    df = spark.createDataFrame([("t", k, m) for k, m in enumerate((True, True, True, False))], "target_id string, frame int, matched boolean")
    assert [r.level for r in associate.confirmation(df).orderBy("frame").collect()] == ["suspected", "suspected", "confirmed", "suspected"]


def test_network_names_and_cells(spark):
    track = spark.createDataFrame([("s", 0.0, 6000.0, -25000.0), ("s", 1.0, 250.0, 750.0)], "system_track_id string, time_sec double, e double, n double")
    got = network.visits(track).orderBy("time_sec").collect()
    assert got[0].node == "G+012_-050" and (got[1].gi, got[1].gj) == (0, 2)


def test_capacity(spark):
    edges = spark.createDataFrame([("a", f"x{k}", 1) for k in range(4)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a", 10), ("x0", 1), ("z", 1)], "node string, traffic long")
    got = {r.node: r.capacity for r in network.capacity(edges, nodes, spark.createDataFrame([(0.0,)], "time_sec double")).collect()}
    assert got == {"a": 50.0, "x0": 15.0, "z": 15.0}


def test_betweenness_path(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    got = {r.node: r.betweenness for r in network.betweenness(edges, None).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 2 / 6, "c": 2 / 6, "d": 0.0})


def test_corridor(spark):
    cells = spark.createDataFrame([(0, 0, 5, 1.0), (1, 0, 5, 1.0), (2, 0, 5, 1.0), (9, 9, 5, 1.0)], "grid_x long, grid_y long, count long, avg_u double")
    cells = cells.withColumns({"center_e": (F.col("grid_x") + 0.5) * 500, "center_n": (F.col("grid_y") + 0.5) * 500})
    (r,) = flow.corridors(cells).collect()
    assert (r.cell_count, r.direction_deg, r.length_m) == (3, 90.0, 1000.0)


def test_false_alarms(spark):
    rows = [("spectrum", "one", 0.0, 0.0, 0.0, 0.0), ("spectrum", "one", 1.0, 0.0, 0.0, 0.0)] + [("spectrum", "two", float(k), 0.0, 0.0, 0.0) for k in range(3)]
    fused = spark.createDataFrame([], "system_track_id string, time_sec double, e double, n double")
    got = {r.target_id: (r.reason, r.rows) for r in pog.false_alarms(observations(spark, rows), fused).collect()}
    assert got == {"one": ("single_station_isolated", 2), "two": ("frequency_out_of_band", 3)}


def test_signal_loss(spark):
    rows = [("adsb", "a", t, 0.0, 0.0, 0.0) for t in (0.0, 60.0, 121.0, 242.0)]
    got = anomaly.signal_loss(anomaly.as_tracks(observations(spark, rows))).orderBy("time_sec").collect()
    assert [r.severity for r in got] == ["medium", "high"]


def test_zscore(spark):
    rows = [("adsb", "a", float(k), 0.0, 0.0, 1.0 if k == 6 else 0.0) for k in range(13)]
    got = anomaly.zscore_anomalies(anomaly.as_tracks(observations(spark, rows)))
    (r,) = got.collect()
    assert r.confidence == pytest.approx(math.sqrt(10) / 6) and r.severity == "medium"


def test_weighted_fusion(spark):
    rows = observations(spark, [("adsb", "a", 0.0, 0.0, 0.0, 0.0), ("remote_id", "b", 0.1, 10.0, 0.0, 0.0)]).withColumn("sid", F.lit("s"))
    (r,) = fuse.wls_fused(rows, "sid").collect()
    assert r.e == pytest.approx(1.0) and r.source_count == 2 and r.sources == "adsb,remote_id"


def test_imm_settles(spark):
    rows = observations(spark, [("adsb", "a", float(k), 100.0, -50.0, 30.0) for k in range(40)])
    groups = spark.createDataFrame([("ST0001", "adsb", "a")], "system_track_id string, source string, target_id string")
    last = imm.imm_fused(rows, groups).orderBy(F.col("time_sec").desc()).first()
    assert (last.e, last.n, last.u) == pytest.approx((100, -50, 30), abs=1e-3)
    assert last.model_cv_prob + last.model_ct_prob + last.model_ca_prob == pytest.approx(1)


def test_imm_models_against_plain_matrices():
    dt = 0.7
    f = imm.chain(3, dt)
    assert f.tolist() == [[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]]
    q = imm.chain_noise(3, dt, 8.0)
    want = [[dt**5 / 20, dt**4 / 8, dt**3 / 6], [dt**4 / 8, dt**3 / 3, dt**2 / 2], [dt**3 / 6, dt**2 / 2, dt]]
    assert np.allclose(q, 8 * np.array(want)) and np.allclose(imm.chain_noise(2, dt, 0.5), 0.5 * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]))
    m = imm.Model.start("ct", np.array([0.0, 0.0, 0.0, 10.0, 5.0, 1.0]))
    m.x[6] = 0.2
    base, step = m._turn_jacobian(dt), 1e-6
    for k in range(7):
        moved = []
        for sign in (1, -1):
            other = imm.Model("ct", m.x.copy(), m.p.copy())
            other.x[k] += sign * step
            other.predict(dt)
            moved.append(other.x)
        assert np.allclose((moved[0] - moved[1]) / (2 * step), base[:, k], atol=1e-4)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-50, 50), min_size=4, max_size=9))
def test_spline_reproduces_cubics(coefficients):
    x = np.array([0.0, 0.7, 1.9, 2.2, 3.5, 5.0])
    c = (coefficients + [0.0] * 4)[:4]
    y = np.polyval(c, x)
    at = np.linspace(-0.5, 5.5, 13)
    assert np.allclose(align.not_a_knot(x, y, at), np.polyval(c, at), rtol=1e-6, atol=1e-5)


def test_geofence(spark):
    rows = observations(spark, [("adsb", "a", 0.0, 0.0, 0.0, 50.0), ("adsb", "b", 0.0, 0.0, 0.0, 5000.0)])
    got = conflict.geofence(rows, (Zone("z", 114.0, 30.45, 100.0, 0.0, 1000.0),)).collect()
    assert [r.track_id for r in got] == ["adsb:a"]


def test_readers(spark, tmp_path):
    (tmp_path / "ad_adsb.csv").write_text("icao,rev_time,lng,lat,altitude,height,heading,speed,ver_speed\nA1,00:00:10,114.0,30.4,100,110,90,20,1\nA1,x,114.0,30.4,,,,,\n")
    (tmp_path / "ad_remote_id.csv").write_text("uas_id,rev_time,longitude,latitude,altitude_pressure,altitude_geodetic,height,direction,speed_horizontal,speed_vertical\nU1,30.5,114.0,30.4,1,2,3,4,5,6\n")
    (tmp_path / "ad_radar.csv").write_text("track_number,rev_time,longitude,latitude,height,heading_angle,velocity_x,velocity_y,velocity_z\n7,01:00,114.0,30.4,50,10,3,4,1\n8,01:00,114.0,30.4,50,10,3,,1\n")
    (tmp_path / "ad_spectrum_detect.csv").write_text("uav_id,rev_time,sensor_longitude,sensor_latitude,sensor_altitude,frequency,uav_model_text\nS1,5,,,,2440,DJI Mini\n")
    rows = {(r.source, r.target_id): r for r in readers.read_all(spark, str(tmp_path)).collect()}
    assert set(rows) == {("adsb", "A1"), ("remote_id", "U1"), ("radar", "7"), ("radar", "8"), ("spectrum", "S1")}
    assert rows["radar", "7"].speed == 5.0 and rows["radar", "8"].speed is None and rows["adsb", "A1"].time_sec == 10.0 and rows["radar", "7"].source_rank == 2
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, str(tmp_path / "none"), "adsb")
    assert readers.read_source(spark, str(tmp_path / "none"), "adsb", missing_ok=True).count() == 0


def workbook(path, rows):
    """A minimal workbook: shared strings, numbers, one inline string, cells left out."""
    import zipfile

    strings = sorted({c for r in rows for c in r if isinstance(c, str)})

    def cell(row, k, c):
        at = f'{chr(65 + k)}{row}'
        if c is None:
            return ""
        if c == "inline":
            return f'<c r="{at}" t="inlineStr"><is><t>inline</t></is></c>'
        return f'<c r="{at}" t="s"><v>{strings.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{at}"><v>{c}</v></c>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row r="{n}">' + "".join(cell(n, k, c) for k, c in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")


def test_readers_go_by_names(spark, tmp_path):
    """Any order of columns, further and missing columns, a workbook, and Parquet that holds numbers."""
    (tmp_path / "ad_adsb.csv").write_text("speed,extra,lat,rev_time,lng,icao,heading\n20,?,30.4,00:00:10,114.0,A1,90\nfast,?,30.4,11,114.0,A2,\n")
    workbook(tmp_path / "ad_radar.xlsx", [("velocity_z", "track_number", "rev_time", "latitude", "longitude", "velocity_x", "velocity_y"), (1, 7, "01:00", 30.4, 114.0, 3, 4), (1, "inline", 61, 30.4, 114.0, None, 4), (1, 9, "01:00", None, 114.0, 3, 4)])
    workbook(tmp_path / "ad_spectrum_detect.xlsx", [])
    spark.createDataFrame([("U1", "30.5", 114.0, 30.4)], "uas_id string, rev_time string, longitude double, latitude double").write.parquet(str(tmp_path / "ad_remote_id.parquet"))
    rows = {(r.source, r.target_id): r for r in readers.read_all(spark, str(tmp_path)).collect()}
    assert set(rows) == {("adsb", "A1"), ("adsb", "A2"), ("remote_id", "U1"), ("radar", "7"), ("radar", "inline")}
    assert rows["adsb", "A1"].speed == 20 and rows["adsb", "A2"].speed is None and rows["adsb", "A1"].alt_geom is None
    assert rows["radar", "7"].speed == 5 and rows["radar", "7"].time_sec == 60 and rows["radar", "inline"].speed is None and rows["radar", "inline"].time_sec == 61


def test_rest_without_corpus_operators(tmp_path):
    """With the corpus operators gone the entry still gives the other queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    shutil.copytree(root / "aeroweave", tmp_path / "aeroweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'heatmap' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_broken_track(spark):
    rows = [("radar", "old", float(t), 10.0 * t, 0.0, 0.0) for t in range(5)] + [("radar", "new", float(t), 10.0 * t, 0.0, 0.0) for t in range(14, 19)]
    (r,) = associate.broken_tracks(observations(spark, rows)).collect()
    assert (r.tid_old, r.tid_new, r.gap_sec, r.pred_error_m, r.score, r.status) == ("old", "new", 10.0, 0.0, 1.0, "confirmed")


def test_association(spark):
    rows = [(s, i, float(t), 5.0 * t, 0.0, 50.0, 5.0, 90.0) for s, i in (("adsb", "a"), ("radar", "r")) for t in range(8)]
    (r,) = associate.associate(observations(spark, rows)).collect()
    assert (r.src_a, r.tid_a, r.src_b, r.tid_b, r.level) == ("adsb", "a", "radar", "r", "confirmed") and r.score == pytest.approx(1.0)


def test_streams_agree_with_batch(spark, tmp_path):
    from aeroweave.streaming import flows

    rows = [("adsb", f"t{k % 3}", float(5 * k), float(k), 0.0, 10.0) for k in range(60)]
    obs = flows.with_event_time(observations(spark, rows)).withColumn("system_track_id", F.col("target_id"))
    path = str(tmp_path / "in")
    obs.coalesce(1).write.parquet(path)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name != "flow" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    def read():
        return spark.readStream.schema(obs.schema).parquet(path)

    got = {(r.time_sec, r.active_targets, r.total_reports) for r in run(flows.temporal_flow(read()), "flow").collect()}
    assert got == {(r.time_sec, r.active_targets, r.total_reports) for r in flow.temporal_flow(obs).collect()}
    frames = read().select("target_id", F.col("obs_id").alias("frame"), (F.col("obs_id") % 4 != 0).alias("matched"))
    stream = {tuple(r) for r in run(flows.confirmation(frames), "levels").collect()}
    batch = associate.confirmation(obs.select("target_id", F.col("obs_id").alias("frame"), (F.col("obs_id") % 4 != 0).alias("matched")))
    assert stream == {(r.target_id, r.frame, r.level) for r in batch.collect()}
    groups = obs.select(F.col("target_id").alias("system_track_id"), "source", "target_id").distinct()
    want = {(r.system_track_id, r.time_sec): r.e for r in imm.imm_fused(obs.drop("system_track_id"), groups).collect()}
    seen = {(r.system_track_id, r.time_sec): r.e for r in run(flows.imm_fused(read()), "imm").collect()}
    assert seen == pytest.approx(want)


def test_nearest_fused_against_plain(spark):
    rng = random.Random(3)
    points = [(f"ST{k}", 5.0 * i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(4) for i in sorted(rng.sample(range(60), [4, 9, 20, 40][k]))]
    reports = [(s, t, rng.choice([round(rng.uniform(0, 300), 1), 5.0 * rng.randrange(60) + 2.5]), rng.uniform(-9, 9), rng.uniform(-9, 9)) for s in ("adsb", "radar") for t in "abc" for _ in range({"a": 2, "b": 12, "c": 70}[t])]
    reports = [(i, *r) for i, r in enumerate(reports)]
    reports.append(reports[20])  # the same report twice
    want = []
    for track in {p[0] for p in points}:
        own = [p for p in points if p[0] == track]
        for target in {r[1:3] for r in reports} if len(own) >= 5 else ():
            seen = sorted((r[3], r[0], r[4], r[5]) for r in reports if r[1:3] == target and own[0][1] - 5 <= r[3] <= own[-1][1] + 5)
            for t, _, e, n in sorted(set(seen[:20])) if len(seen) >= 3 else ():
                gap, _, fe, fn = min((abs(t - p[1]), *p[1:]) for p in own)
                if gap <= 3:
                    want.append((target[0], round(e - fe, 6), round(n - fn, 6)))
    fused = spark.createDataFrame(points, "system_track_id string, time_sec double, e double, n double")
    obs = spark.createDataFrame(reports, "obs_id long, source string, target_id string, time_sec double, e double, n double")
    found = fuse.nearest_fused(obs, fused, sample=None)
    assert sorted((r.source, round(r.de, 6), round(r.dn, 6)) for r in found.collect()) == sorted(want) and len(want) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]  # nothing made of the pairs is grouped


def test_false_alarms_near_tracks_against_plain(spark):
    rng = random.Random(4)
    rows = [(k, f"t{k // 4}", rng.choice([rng.uniform(0, 200), 10.0 * rng.randrange(20)]), rng.choice([-9000.0, 0.0, 9000.0])) for k in range(160)]
    rows = [(i, t, s, 2440.0, i % 3, e, 0.0, "spectrum") for i, t, s, e in rows for s in (s, s)]
    points = [(f"ST{k}", rng.choice([5.0 * i, 5.0 * i + rng.random()]), rng.choice([-9000.0, 0.0, 9000.0]) + rng.uniform(-5000, 5000), 0.0) for k in range(2) for i in range(0, 40, 4)]
    groups = {}
    for i, t, s, _, sensor, e, _, _ in rows:
        groups.setdefault((t, math.floor(s / 10)), []).append((sensor, s, e))
    want = set()
    for key, g in groups.items():
        if len({x[0] for x in g}) < 2:
            continue
        at, se = (sum(x[k] for x in g) / len(g) for k in (1, 2))
        near = {}
        for track, t, e, _ in points:
            if abs(t - at) <= 10:
                near.setdefault(track, []).append(e)
        if not any(abs(sum(v) / len(v) - se) < 4000 for v in near.values()):
            want.add(key)
    obs = spark.createDataFrame(rows, "obs_id long, target_id string, time_sec double, frequency double, sensor_id int, e double, n double, source string")
    fused = spark.createDataFrame(points, "system_track_id string, time_sec double, e double, n double")
    found = pog.false_alarms(obs, fused, tracks=None)
    by = {(r.target_id, r.window): r.reason for r in found.collect()}
    assert {k for k, why in by.items() if why == "no_track_corroboration"} == {k for k in want if by.get(k) != "irregular_intervals"}
    assert 5 < len(want) < len([k for k, g in groups.items() if len({x[0] for x in g}) > 1])
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Aggregate" in x and "target_id" in x and "system_track_id" in x]  # no row for each group and track


def test_pairs_of_tracks_are_not_shuffled(spark):
    rows = [(i, s, r, f"t{k}", 10.0 * j, 100.0 * k, 0.0, 50.0, 10.0, 90.0, 0.0) for i, (s, r, k, j) in enumerate((s, r, k, j) for s, r in (("adsb", 0), ("remote_id", 1)) for k in range(3) for j in range(6))]
    obs = spark.createDataFrame(rows, "obs_id long, source string, source_rank int, target_id string, time_sec double, e double, n double, u double, speed double, heading double, climb_rate double")
    found = associate.nearest_matches(associate.coarse_candidates(associate.with_reports(associate.track_summary(obs), obs)))
    assert found.count() == 27  # three probes of each of nine pairs, at most 200 m apart
    assert {(r.target_id_a, r.target_id_b, r.probe): r.t1 - r.t2 for r in found.collect()} == {(f"t{a}", f"t{b}", k): 0 for a in range(3) for b in range(3) for k in (0, 3, 5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Window" not in above  # the pairs are not grouped again


def test_greedy_takes_no_rounds(spark):
    """A chain of pairs, each better than the next: rounds would take one of it at a time."""
    rows = [("g", f"a{i:02}", f"b{j:02}", 1.0 - (i + j) / 100) for i in range(20) for j in (i, i + 1)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "greedy matching of a chain")
    got = graph.greedy_matching(spark.createDataFrame(rows, "g string, a string, b string, s double"), ("g",), "a", "b", "s").collect()
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.a, r.b) for r in got) == [(f"a{i:02}", f"b{i:02}") for i in range(20)] and jobs <= 12


def test_components_of_a_long_path_keep_estimates_small(spark):
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)], "a string, b string")
    found = graph.components(edges)
    assert {r.component for r in found.collect()} == {"n0000"}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
