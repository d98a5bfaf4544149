"""Connected components of an edge list, without collecting any of it.

Alternating large-star and small-star steps: each joins every node's neighbours to the smallest of them, so
the number of rounds grows with the logarithm of the longest path. Each step is written to the shared
folder; a hub's neighbours are summed up before the shuffle (min), and the join back to them is an ordinary
one that skew handling may split. A list of few edges is united by one task instead, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

MAX_ROUNDS = 60
#: Edges, 16 bytes each, that one task unites; more go through the rounds.
IN_ONE_TASK = 200_000

_STARS = T.StructType([T.StructField("id", T.LongType()), T.StructField("component", T.LongType())])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in read]) for k in (0, 1))
    ids, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in zip(places[: len(u)].tolist(), places[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:  # places are in order of the ids
            parent[max(a, b)] = min(a, b)
    found = ids[[root(k) for k in range(len(ids))]]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], names=_STARS.names)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. Returns (id, component): the smallest id that each id reaches.

    Loops and repeated edges do not matter; ids without an edge to another id are not in the result.
    """
    both = edges.where(F.col("a") != F.col("b"))
    now = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= IN_ONE_TASK:
        return now.coalesce(1).mapInArrow(_unite, _STARS)
    before = None
    for _ in range(MAX_ROUNDS):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        either = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = either.where("v > u or v < u").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
