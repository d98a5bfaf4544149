"""Queries on tables that the given ones are too small for: wide identifiers, early times, against DuckDB SQL."""

import duckdb
import pytest
from test_oracles import DATA, QUERIES, SQL, rows, same


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The smallest events twice, the second time by users of five digits, two of whom begin alike."""
    path = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    con.execute(f"create table small as select * from read_parquet('{DATA}/events.parquet')")
    shifted = "select event_id + 1000 as event_id, ts, user_id + 10000 as user_id, event_type, value, props from small"
    con.execute(f"copy (select * from small union all {shifted}) to '{path}/events.parquet' (format parquet)")
    return str(path)


WIDE = ("anomaly_events", "classify_tracks", "community_capacity", "congested_nodes", "congestion_bands", "degree_centrality", "ds_credibility", "ds_position_mass", "fused_smoothness", "label_communities", "net_edges", "net_statistics", "pog_track_overlap", "rmse_per_source_members", "wls_fused_tracks")


@pytest.mark.parametrize("name", WIDE)
def test_users_of_five_digits(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{wide}/events.parquet')")
    df = QUERIES[name](spark, wide)
    got = rows(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert len(got) == len(want) > 0
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]


@pytest.fixture(scope="module")
def early(tmp_path_factory):
    """The smallest events half a month earlier: before and after the time that seconds are counted from."""
    path = tmp_path_factory.mktemp("early")
    rows_of = f"select * replace (ts - interval 15 days as ts) from read_parquet('{DATA}/events.parquet')"
    duckdb.connect().execute(f"copy ({rows_of}) to '{path}/events.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ("classify_tracks", "outlier_rejection", "temporal_flow", "wls_fused_tracks"))
def test_times_before_the_first_second(spark, early, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{early}/events.parquet')")
    df = QUERIES[name](spark, early)
    got = rows(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert len(got) == len(want) > 0
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]
