"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x). Candidates are dealt to the nearest of a bounded sample of vectors
(``CENTERS``), so that a bucket covers a part of the space, and large buckets are cut into blocks by a hash. Each
block builds a cover tree, each group of queries another, and the two are walked together: a pair of nodes is
dropped when the largest product its covering radii allow is below the worst k-th score of the query node's
queries. The same bound holds for a whole bucket. A query first asks the bucket that promises most, and with the
k-th score it has from there only those others whose bound is not below it. The best k of all answers are the
result; nothing is left out that could be one of them.

How much is dropped depends on the vectors: ``search`` counts the products it computes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, cut

SCALE = 1024
TOP = 10
EVERY = 100
BUCKET_ROWS = 2048
BLOCK_ROWS = 16384
CENTERS = 1024
QUERY_GROUP = 1024
LEAF = 256
QUERY_LEAF = 4
MOST_CENTERS = 16
NONE = np.iinfo(np.int64).min


class Node:
    """Points ``rows`` within ``radius`` of ``center``; the children share them."""

    __slots__ = ("center", "children", "norm", "radius", "rows")

    def __init__(self, rows: np.ndarray, center: np.ndarray, radius: float):
        self.rows, self.center, self.radius = rows, center, radius
        self.norm = float(np.linalg.norm(center))
        self.children: list[Node] = []


def build(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree. A node's children are around centers taken farthest first, its own center before all others,
    until they cover its points within half its radius or are as many as leaves of its points would be, at most
    ``MOST_CENTERS``: centers lie at least as far apart
    as the last one was from those before it, and no point lies farther than that from its nearest center, to
    which it goes. Centers with few points share a child. A node of few points, or of equal ones, is a leaf."""
    rows = np.arange(len(points))
    distance = np.linalg.norm(points - points[0], axis=1)
    root = Node(rows, points[0], float(distance.max()))
    todo = [(root, 0)]
    while todo:
        node, first = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        own = points[node.rows]
        centers, far = [first], np.linalg.norm(own - points[first], axis=1)
        nearest = np.zeros(len(own), np.int64)
        most = min(MOST_CENTERS, max(2, len(own) // leaf))
        while len(centers) < most and far.max() > node.radius / 2:
            centers.append(int(node.rows[far.argmax()]))
            to = np.linalg.norm(own - points[centers[-1]], axis=1)
            closer = to < far
            far[closer], nearest[closer] = to[closer], len(centers) - 1
        if len(centers) == 1:  # all within half the radius that the node was given: a closer one is known
            node.radius = float(far.max())
            todo.append((node, first))
            continue
        sizes = np.bincount(nearest, minlength=len(centers))
        few = np.flatnonzero(sizes < leaf // 4)
        if len(few) == len(centers):
            continue
        for k in np.flatnonzero(sizes >= leaf // 4).tolist():
            mine = nearest == k
            child = Node(node.rows[mine], points[centers[k]], float(far[mine].max()))
            node.children.append(child)
            todo.append((child, centers[k]))
        if len(few):  # what lies alone: one child, so that no leaf holds next to nothing
            rest = node.rows[np.isin(nearest, few)]
            to = np.linalg.norm(points[rest] - points[centers[few[0]]], axis=1)
            child = Node(rest, points[centers[few[0]]], float(to.max()))
            node.children.append(child)
            todo.append((child, centers[few[0]]))
    return root


class Best:
    """The k best (score, smaller id first, null last) of each query so far, none below its ``floor``."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n, NONE) if floor is None else floor
        self.score = np.full((n, k), NONE)
        self.none = np.ones((n, k), bool)
        self.id = np.zeros((n, k), np.int64)
        self.row = np.full((n, k), -1, np.int64)
        self.products = 0

    def worst(self, queries: np.ndarray) -> int:
        return int(np.maximum(self.score[queries, -1], self.floor[queries]).min())

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> None:
        """``scores``: a row a query, a column a candidate; ``NONE`` takes no part."""
        k = self.k
        self.products += scores.size
        least = np.maximum(self.score[queries, -1], self.floor[queries])
        if scores.shape[1] > 4 * k:
            least = np.maximum(np.partition(scores, -k, axis=1)[:, -k], least)
        q, c = np.nonzero((scores >= least[:, None]) & (scores != NONE))
        if not len(q):
            return
        at = np.concatenate([np.repeat(np.arange(len(queries)), k), q])
        score = np.concatenate([self.score[queries].ravel(), scores[q, c]])
        null = np.concatenate([self.none[queries].ravel(), none[c]])
        ident = np.concatenate([self.id[queries].ravel(), ids[c]])
        row = np.concatenate([self.row[queries].ravel(), rows[c]])
        order = np.lexsort((row, ident, null, ~score, at))  # ~x orders as -x does, without its one overflow
        first = np.searchsorted(at[order], np.arange(len(queries)))
        take = order[(first[:, None] + np.arange(k)).ravel()]
        for mine, all_of in ((self.score, score), (self.none, null), (self.id, ident), (self.row, row)):
            mine[queries] = all_of[take].reshape(-1, k)


def search(queries: np.ndarray, own: np.ndarray, tree: Node, points: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best rows for each query but its own row (``own``); vectors are whole numbers, products are exact."""
    best = Best(len(queries), k, floor)
    narrow = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1] < 2**53
    q, p = (queries.astype(np.float64), points.astype(np.float64)) if narrow else (queries, points)

    def bound(a: Node, b: Node) -> float:
        return float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    start = build(queries.astype(np.float64), QUERY_LEAF)
    heap, count = [(-bound(start, tree), 0, start, tree)], 0
    while heap:
        up, _, a, b = heapq.heappop(heap)
        if slack(-up) < best.worst(a.rows):
            continue
        if not a.children and not b.children:
            for i in range(0, len(b.rows), 4096):
                part = b.rows[i : i + 4096]
                scores = (q[a.rows] @ p[part].T).astype(np.int64)
                scores[own[a.rows][:, None] == rows[part][None, :]] = NONE
                best.add(a.rows, scores, ids[part], none[part], rows[part])
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        for x, y in [(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]:
            count += 1
            heapq.heappush(heap, (-bound(x, y), count, x, y))
    return best


def slack(bound):
    """A bound with room for rounding; scores equal to it may still count."""
    return bound + 1 + 1e-9 * abs(bound)


_ROWS = T.StructType([T.StructField("row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("ints", T.BinaryType())])
_FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


_DEALT = T.StructType([*_ROWS.fields, T.StructField("bucket", T.IntegerType()), T.StructField("far", T.DoubleType())])
_ASKED = T.StructType([*_ROWS.fields, T.StructField("bucket", T.IntegerType()), T.StructField("floor", T.LongType())])
#: (dim, bucket) -> center; vectors of other lengths are bucket -1 of theirs
Centers = dict[int, tuple[list[int], np.ndarray]]


def _vectors(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places in the batch, vectors) of the rows of each length."""
    dims, ints = batch.column(2).to_numpy(), batch.column(3).to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _vectors([ints[k] for k in at])


def _to_ints(scale: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ident, dim, ints = [], [], [], []
            for r, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not len(x) or not np.isfinite(x).all():
                    continue
                row.append(r)
                ident.append(i)
                dim.append(len(x))
                ints.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ident, pa.int64()), pa.array(dim, pa.int32()), pa.array(ints, pa.binary())], names=_ROWS.names)

    return work


def _deal(centers: Centers):
    """To each row the bucket of its nearest center, and how far that is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, far = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.inf)
            for dim, at, x in _by_dim(batch):
                if dim not in centers:
                    continue
                names, c = centers[dim]
                for i in range(0, len(at), 1024):
                    part = x[i : i + 1024].astype(np.float64)
                    square = (part**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * part @ c.T
                    nearest = square.argmin(axis=1)
                    bucket[at[i : i + 1024]] = np.array(names, np.int32)[nearest]
                    far[at[i : i + 1024]] = np.linalg.norm(part - c[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket), pa.array(far)], names=_DEALT.names)

    return work


def _choose(centers: Centers, radius: dict[tuple[int, int], float], home: bool):
    """For each query the bucket that promises most; or (a further column: the k-th score it has) all others that
    may hold a score as good as that."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = None if home else batch.column(4).to_pylist()
            at_all, buckets = [], []
            for dim, at, x in _by_dim(batch):
                names, c = centers.get(dim, ([], np.empty((0, dim))))
                known = [k for k, n in enumerate(names) if (dim, n) in radius]
                inner = x.astype(np.float64) @ c[known].T
                bound = inner + np.linalg.norm(x.astype(np.float64), axis=1)[:, None] * np.array([radius[dim, names[k]] for k in known])
                names = np.array([*[names[k] for k in known], *([-1] if (dim, -1) in radius else [])], np.int32)
                if (dim, -1) in radius:
                    bound = np.concatenate([bound, np.full((len(at), 1), np.inf)], axis=1)
                if not len(names):
                    continue
                first = bound.argmax(axis=1)
                for k, place in enumerate(at.tolist()):
                    if home:
                        wanted = names[first[k] : first[k] + 1]
                    else:
                        least = floors[place]
                        good = np.ones(len(names), bool) if least is None else slack(bound[k]) >= least
                        good[first[k]] = False
                        wanted = names[good]
                    at_all.append(np.full(len(wanted), place))
                    buckets.append(wanted)
            if at_all:
                rows = batch.select(range(4)).take(pa.array(np.concatenate(at_all)))
                floor = pa.nulls(rows.num_rows, pa.int64()) if home else batch.column(4).take(pa.array(np.concatenate(at_all)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(buckets)), floor], names=_ASKED.names)

    return work


def _search_blocks(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns block, asks, row, vec_id, ints, floor, sorted by the first three: a block's candidates, then the queries."""
        block, data, ask, tree = None, [], [], None

        def vectors(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            none = np.array([r[1] is None for r in rows])
            return _vectors([r[2] for r in rows]), np.array([r[1] or 0 for r in rows], np.int64), none, np.array([r[0] for r in rows], np.int64)

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ask
            if not ask or not data:
                ask = []
                return
            if tree is None:
                points, ids, none, rows = vectors(data)
                tree = (build(points.astype(np.float64)), points, ids, none, rows)
            q, qid, _, own = vectors(ask)
            best = search(q, own, *tree, k, np.array([NONE if r[3] is None else r[3] for r in ask], np.int64))
            at, slot = np.nonzero(best.row >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.array(qid[at]), pa.array(best.id[at, slot], mask=best.none[at, slot]), pa.array(best.score[at, slot])], names=_FOUND.names
            )
            ask = []

        for batch in batches:
            for b, asks, row, ident, ints, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    yield from answer()
                    block, data, tree = b, [], None
                if asks:
                    ask.append((row, ident, ints, floor))
                    if len(ask) == QUERY_GROUP:
                        yield from answer()
                else:
                    data.append((row, ident, ints))
        yield from answer()

    return work


def top_products(embeddings: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose vec_id is divisible by ``every``.

    Vectors that are null, empty or hold null or non-finite components take no part. Only vectors of equal
    length meet. A repeated row is a candidate for its double, and as a query has a result of its own. A null
    vec_id is a candidate, last among equal scores, and no query. Extra columns are ignored; an empty table
    gives no rows. Scores are exact within 64 bits. The centers are at most ``CENTERS`` vectors.
    """
    raw = columns(embeddings, vec_id=T.LongType(), embedding=T.ArrayType(T.DoubleType()))
    rows = cut(raw.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").mapInArrow(_to_ints(scale), _ROWS), "vectors")
    wanted = max(1, min(CENTERS, -(-rows.count() // BUCKET_ROWS)))
    sample = rows.select("dim", "ints").orderBy(F.xxhash64("row"), "row").limit(wanted).distinct().orderBy("dim", "ints").collect()  # at most CENTERS vectors
    centers: Centers = {}
    for dim in {r["dim"] for r in sample}:
        mine = [i for i, r in enumerate(sample) if r["dim"] == dim]
        centers[dim] = (mine, _vectors([sample[i]["ints"] for i in mine]).astype(np.float64))
    dealt = cut(rows.mapInArrow(_deal(centers), _DEALT), "dealt-vectors")
    # a row for each bucket: at most CENTERS, and one for each length of vectors that has no center
    found = dealt.groupBy("dim", "bucket").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    sizes = cut(found.withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")), "buckets")
    radius = {(r["dim"], r["bucket"]): r["radius"] for r in sizes.select("dim", "bucket", "radius").collect()}
    parts = sizes.select("dim", "bucket", "parts")
    block = F.xxhash64("dim", "bucket", "part").alias("block")
    data = dealt.join(F.broadcast(parts), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    data = data.select(block, F.lit(0).alias("asks"), "row", "vec_id", "ints", F.lit(None).cast("long").alias("floor"))

    def answers(asked: DataFrame) -> DataFrame:
        each = asked.join(F.broadcast(parts), ["dim", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        each = each.select(block, F.lit(1).alias("asks"), "row", "vec_id", "ints", "floor")
        together = data.unionByName(each).repartition("block").sortWithinPartitions("block", "asks", "row")
        return cut(together.mapInArrow(_search_blocks(k), _FOUND), "found")

    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    queries = rows.where(F.col("vec_id") % every == 0)
    first = answers(queries.mapInArrow(_choose(centers, radius, True), _ASKED))
    ranked = first.withColumn("rank", F.row_number().over(order))
    floors = ranked.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    again = queries.join(cut(floors, "floors"), "row", "left").select(*_ROWS.names, "floor")
    rest = answers(cut(again.mapInArrow(_choose(centers, radius, False), _ASKED), "asked"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def duckdb_sql(k: int = TOP, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as qr, q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % {every} = 0 and q.r <> c.r and len(q.e) = len(c.e)),
k as (select *, row_number() over (partition by qr order by score desc, vec_id nulls last) as rank from s)
select query_id, rank::integer as rank, vec_id, score from k where rank <= {k}"""
