"""The pipeline's stages do what they decide, each on all that its predecessor kept."""

import corpus_pipeline
import helpers as H
import pytest

from aeroweave.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, H.SF)
        assert after.columns == docs.columns == COLUMNS, name
        rows = after.collect()
        before = {r["doc_id"] for r in docs.collect()}
        assert {r["doc_id"] for r in rows} <= before
        assert len({r["doc_id"] for r in rows}) > 0.5 * len(before) or name == "mixing"
        docs = spark.createDataFrame(rows, docs.schema)
    sizes = {}
    for r in docs.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, H.SF).collect()
    starts = {}
    for r in packed:
        starts[r["doc_id"]] = starts.get(r["doc_id"], 0) + (r["start"] == 0)
    assert starts == sizes


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_awkward_rows(spark, stage):
    assert stage(spark, H.documents(spark), H.SF).count() > 0
    assert stage(spark, H.none(spark), H.SF).count() == 0


@pytest.mark.parametrize("name, left", [("line_dedup", ["removed-lines"]), ("near_duplicates", ["kept"]), ("mixing", ["copies"])])
def test_tables_in_passing_go(spark, tmp_path, monkeypatch, name, left):
    """A stage leaves only the table that its result reads, and its texts are joined without a shuffle while that is small."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    after = dict(corpus_pipeline.STAGES)[name](spark, docs, H.SF)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == left
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in after._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert after.count() > 0
