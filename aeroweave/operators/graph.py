"""Iterative graph operators as DataFrame rounds; each round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = 1 << 20  # pairs of the first band of a greedy matching
FEW = 1 << 20  # edges that one task unites
SMALL = 500_000  # rows that are broadcast


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all share; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="aeroweave-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    A checkpoint would keep the optimizer's estimate of its size; a join's is the product of its sides', so round
    by round the number gets several times the digits, until the driver has no memory for it.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of edges (a, b): the smallest id reached, by least labels with shortcuts.

    A hub's labels are summed up before the shuffle. Ids can be any ordered type. At most ``FEW`` edges are united by
    one task, without rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = cut(both)
    if both.count() <= 2 * FEW:
        one = both.where("a < b").coalesce(1)
        return cut(one.mapInArrow(_unite, one.select(F.col("a").alias("id"), F.col("b").alias("component")).schema))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"))
        # shortcut: the label's own label
        jump = least.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = cut(least.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("new")))
        moved = after.join(labels, "id").where("new != label").limit(1).count()
        labels = after.select("id", F.col("new").alias("label"))
        if not moved:
            return labels.select("id", F.col("label").alias("component"))


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (a, b) together: the smaller root of two becomes the other's."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    kinds = None
    for batch in batches:
        kinds = batch.schema.types
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    for k in range(0, len(ids), 1 << 16):
        part = ids[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, kinds[0]), pa.array([find(x) for x in part], kinds[1])], ["id", "component"])


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, label): communities by synchronous weighted votes of neighbours in both directions.

    ``nodes``: id; ``edges``: a, b, weight. Ties go to the smallest label; the own label counts as a vote of the
    smallest weight, so that two nodes do not swap labels for ever.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = cut(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label", "weight")
        votes = votes.unionByName(labels.withColumn("weight", F.lit(1).cast("long"))).groupBy("id", "label").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "label")).alias("best")).select("id", F.col("best.label").alias("new"))
        after = cut(best.join(labels, "id"))
        moved = after.where("new != label").limit(1).count()
        labels = after.select("id", F.col("new").alias("label"))
        if not moved:
            break
    return labels


def greedy_matching(pairs: DataFrame, group: tuple[str, ...], left: str, right: str, score: str) -> DataFrame:
    """Rows accepted in order of score (then left, right), each side at most once in its group.

    Sequential by nature: each group's pairs stream in order through one task, which holds the ids taken so far.
    Many pairs go in bands, best scores first: the best ``BAND`` of all groups, then up to eight times as many and so
    on. A later band leaves out, before it is sorted, the pairs of ids that were taken, which are most of it.
    Only ids and scores take this way; the rows are joined to what is accepted.
    """
    names = (*group, left, right)
    pairs = cut(pairs)
    total, bounds = pairs.count(), []
    while BAND * 8 ** len(bounds) < total:
        bounds.append(1 - BAND * 8 ** len(bounds) / total)
    bounds = sorted(set(pairs.approxQuantile(score, bounds, 0.001)), reverse=True) if bounds else []
    shape = pairs.select(*names, score).schema

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two = None, set(), set()
        for batch in batches:
            keep = []
            lists = [batch.column(k).to_pylist() for k in range(len(names))]
            for i, (*key, a, b) in enumerate(zip(*lists, strict=True)):
                if key != now:
                    now, one, two = key, set(), set()
                if a not in one and b not in two:
                    one.add(a)
                    two.add(b)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    taken = None
    for low, high in zip([*bounds, None], [None, *bounds]):
        band = pairs.select(*names, score)
        # a null or NaN score is below or above all numbers, as in the order of the sort
        if low is not None:
            band = band.where(F.col(score) >= low)
        if high is not None:
            band = band.where((F.col(score) < high) | F.col(score).isNull())
            for side in (left, right):
                band = band.join(small(taken.select(*group, side)), [*group, side], "left_anti")
        ordered = band.select(*names, score).repartition(*group).sortWithinPartitions(*group, F.col(score).desc(), left, right)
        found = cut(ordered.mapInArrow(accept, shape))
        taken = found if taken is None else taken.unionByName(found)
    return pairs.join(small(taken), [*names, score], "left_semi")


def small(rows: DataFrame) -> DataFrame:
    """Rows already written, to be broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows
