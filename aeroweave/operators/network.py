"""The airspace as a directed weighted graph of cells: traffic, centrality, communities, capacity."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Network
from .graph import components, propagate_labels

#: The path search holds the edges in each task; beyond this many it is refused rather than sampled.
EDGES_IN_MEMORY = 2_000_000


def node_name(gi: Column, gj: Column) -> Column:
    return F.format_string("G%+04d_%+04d", gi, gj)


def visits(fused: DataFrame, p: Network = Network()) -> DataFrame:
    rows = fused.where("e is not null and n is not null")
    return rows.select("system_track_id", "time_sec", F.rint(F.col("e") / p.cell_m).cast("int").alias("gi"), F.rint(F.col("n") / p.cell_m).cast("int").alias("gj")).withColumn("node", node_name(F.col("gi"), F.col("gj")))


def edges(fused: DataFrame, p: Network = Network()) -> DataFrame:
    """src, dst, weight: transitions of tracks from one cell to another."""
    w = Window.partitionBy("system_track_id").orderBy("time_sec")
    steps = visits(fused, p).withColumn("prev", F.lag("node").over(w)).where("prev is not null and prev != node")
    return steps.groupBy(F.col("prev").alias("src"), F.col("node").alias("dst")).agg(F.count("*").alias("weight"))


def nodes(fused: DataFrame, edge_rows: DataFrame, p: Network = Network()) -> DataFrame:
    """node, gi, gj, traffic, tracks_passing of the ends of edges."""
    ends = edge_rows.select(F.col("src").alias("node")).unionByName(edge_rows.select(F.col("dst").alias("node"))).distinct()
    counted = visits(fused, p).groupBy("node", "gi", "gj").agg(F.count("*").alias("traffic"), F.count_distinct("system_track_id").alias("tracks_passing"))
    return counted.join(ends, "node", "left_semi")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """node, degree (neighbours in and out), strength (their weights)."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def degree_centrality(edge_rows: DataFrame) -> DataFrame:
    found = degrees(edge_rows)
    count = found.agg(F.count("*").alias("nodes"))
    return found.crossJoin(F.broadcast(count)).select("node", F.try_divide(F.col("degree"), 2 * (F.col("nodes") - 1)).alias("degree_centrality"))  # one row


def weighted_degree(edge_rows: DataFrame) -> DataFrame:
    found = degrees(edge_rows)
    top = found.agg(F.max("strength").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("node", F.try_divide("strength", "top").alias("weighted_degree"))  # one row


def betweenness(edge_rows: DataFrame, sources: int | None = 200, tie: float = 1e-10) -> DataFrame:
    """node, betweenness: shares of shortest paths (length 1 / (weight + 0.1)) from the first ``sources`` nodes
    by name (None: all), scaled to all nodes.

    One search a source, spread over tasks; each task holds the edges, whose number is checked before.
    """
    n_edges = edge_rows.count()
    if n_edges > EDGES_IN_MEMORY:
        raise ValueError(f"{n_edges} edges do not fit in a task; coarsen the cells")
    spark = edge_rows.sparkSession
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    total = ends.count()
    if total < 3:
        return ends.select("node", F.lit(0.0).alias("betweenness"))
    held = spark.sparkContext.broadcast([(r["src"], r["dst"], r["weight"]) for r in edge_rows.collect()])
    chosen = ends if sources is None else ends.orderBy("node").limit(sources)
    used = total if sources is None else min(sources, total)

    def searches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[str, list[tuple[str, float]]] = {}
        for a, b, weight in sorted(held.value):
            out.setdefault(a, []).append((b, 1.0 / (weight + 0.1)))
        score: dict[str, float] = {}
        for batch in batches:
            for start in batch["node"]:
                for node, share in _dependencies(out, start, tie).items():
                    score[node] = score.get(node, 0.0) + share
        if score:  # a task may have no source
            yield pd.DataFrame({"node": list(score), "share": list(score.values())})

    shape = T.StructType([T.StructField("node", T.StringType()), T.StructField("share", T.DoubleType())])
    summed = chosen.repartition(spark.sparkContext.defaultParallelism).mapInPandas(searches, shape).groupBy("node").agg(F.sum("share").alias("share"))
    scale = total / used / ((total - 1) * (total - 2))
    return ends.join(summed, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(out: dict[str, list[tuple[str, float]]], start: str, tie: float) -> dict[str, float]:
    """How much of the shortest paths from ``start`` runs through each other node."""
    far, paths, before, order, done = {start: 0.0}, {start: 1.0}, {}, [], set()
    queue = [(0.0, start)]
    while queue:
        d, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        order.append(node)
        for other, length in out.get(node, ()):
            reach = d + length
            known = far.get(other)
            if known is None or reach < known - tie:
                far[other], paths[other], before[other] = reach, paths[node], [node]
                heapq.heappush(queue, (reach, other))
            elif abs(reach - known) <= tie and other not in done:
                paths[other] += paths[node]
                before[other].append(node)
    share = dict.fromkeys(order, 0.0)
    for node in reversed(order):
        for b in before.get(node, ()):
            share[b] += paths[b] / paths[node] * (1 + share[node])
    share.pop(start)
    return share


def critical_nodes(edge_rows: DataFrame, top: int = 15, sources: int | None = 200) -> DataFrame:
    joined = degree_centrality(edge_rows).join(betweenness(edge_rows, sources), "node").join(weighted_degree(edge_rows), "node")
    score = 0.3 * F.col("degree_centrality") + 0.4 * F.col("betweenness") + 0.3 * F.col("weighted_degree")
    return joined.withColumn("importance", score).orderBy(F.col("importance").desc(), "node").limit(top)


def communities(edge_rows: DataFrame, rounds: int = 50) -> DataFrame:
    """node, community (a node's name)."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = propagate_labels(ends, edge_rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), rounds)
    return found.select(F.col("id").alias("node"), F.col("label").alias("community"))


def weak_components(edge_rows: DataFrame) -> DataFrame:
    found = components(edge_rows.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.select(F.col("id").alias("node"), "component")


def vulnerability(edge_rows: DataFrame, node_rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """node, components_increase, traffic_load, vulnerability_score of the candidates (column node).

    All candidates at once: one labelling of the edges that are left without each of them.
    """
    asked = candidates.select(F.col("node").alias("gone")).distinct()
    left = edge_rows.select("src", "dst").where("src != dst").crossJoin(F.broadcast(asked)).where("src != gone and dst != gone")  # the candidates are a top-k
    name = [F.concat_ws("|", "gone", c) for c in ("src", "dst")]
    grown = components(left.select(name[0].alias("a"), name[1].alias("b")))
    parts = grown.select(F.split_part("id", F.lit("|"), F.lit(1)).alias("gone"), "component").groupBy("gone").agg(F.count_distinct("component").alias("parts"), F.count("*").alias("linked"))
    before = weak_components(edge_rows).agg(F.count_distinct("component").alias("was"), F.count("*").alias("all"))
    total = node_rows.agg(F.sum("traffic").alias("total"))
    rows = asked.join(parts, "gone", "left").crossJoin(before).crossJoin(total).join(node_rows, F.col("gone") == F.col("node"))
    # nodes that lost all their edges are components of one
    after = F.coalesce("parts", F.lit(0)) + (F.col("all") - 1 - F.coalesce("linked", F.lit(0)))
    rows = rows.withColumn("components_increase", after - F.col("was"))
    score = 0.5 * F.col("components_increase") + 0.5 * F.col("traffic") / F.greatest(F.col("total"), F.lit(1))
    return rows.select("node", "components_increase", F.col("traffic").alias("traffic_load"), score.alias("vulnerability_score"))


def clustering(edge_rows: DataFrame, first: int | None = 100) -> DataFrame:
    """node, clustering: share of a node's pairs of neighbours (either direction) that are linked."""
    link = edge_rows.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x != y").distinct()
    both = link.select(F.col("x").alias("node"), F.col("y").alias("nb")).unionByName(link.select(F.col("y").alias("node"), F.col("x").alias("nb")))
    asked = both.select("node").distinct()
    if first is not None:
        asked = asked.orderBy("node").limit(first)
    mine = both.join(asked, "node", "left_semi")
    wedges = mine.select("node", F.col("nb").alias("x")).join(mine.select("node", F.col("nb").alias("y")), "node").where("x < y")
    closed = wedges.join(link, ["x", "y"], "left_semi").groupBy("node").agg(F.count("*").alias("closed"))
    sizes = mine.groupBy("node").agg(F.count("*").alias("k"))
    share = F.try_divide(2 * F.coalesce("closed", F.lit(0)), F.col("k") * (F.col("k") - 1))
    return sizes.join(closed, "node", "left").select("node", F.coalesce(share, F.lit(0.0)).alias("clustering"))


def statistics(edge_rows: DataFrame, first: int | None = 100) -> DataFrame:
    n = edge_rows.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count_distinct("node").alias("nodes"))
    e = edge_rows.agg(F.count("*").alias("edges"))
    c = clustering(edge_rows, first).agg(F.avg("clustering").alias("avg_clustering"))
    rows = n.crossJoin(e).crossJoin(c)  # one row each
    return rows.select("nodes", "edges", F.try_divide(2 * F.col("edges"), F.col("nodes")).alias("avg_degree"), F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "avg_clustering")


def capacity(edge_rows: DataFrame, node_rows: DataFrame, fused: DataFrame, p: Network = Network()) -> DataFrame:
    """node, traffic, capacity (aircraft at a time by links and safe separation, 1 to 50), windows."""
    span = fused.agg(F.greatest(F.lit(1.0), F.max("time_sec") - F.min("time_sec")).alias("span"))
    windows = F.greatest(F.lit(1), F.floor(F.coalesce("span", F.lit(1.0)) / p.window_s))
    area = p.safety * p.cell_m**2 / p.separation_m**2
    room = F.greatest(F.lit(1.0), F.least(F.lit(50.0), area * F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1))))
    return node_rows.join(degrees(edge_rows), "node", "left").crossJoin(F.broadcast(span)).select("node", "traffic", room.alias("capacity"), windows.alias("windows"))  # one row


def congestion(room: DataFrame) -> DataFrame:
    index = F.col("traffic") / (F.col("capacity") * F.col("windows"))
    return room.where("traffic > 0").select("node", F.round(index, 4).alias("congestion_index"), F.round("capacity", 1).alias("dynamic_capacity"), F.col("traffic").alias("traffic_count"), (index > 1).alias("is_congested"))


def community_capacity(room: DataFrame, community_rows: DataFrame) -> DataFrame:
    summed = room.join(community_rows, "node").groupBy("community").agg(F.count("*").alias("n_nodes"), F.sum("capacity").alias("total"), F.sum("traffic").alias("current_load"), F.max("windows").alias("windows"))
    use = F.col("current_load") / (F.col("total") * F.col("windows"))
    return summed.select("community", "n_nodes", F.round("total", 1).alias("total_capacity"), "current_load", F.round(use, 4).alias("utilization"), (use > 0.8).alias("is_saturated"))


def most_congested(index_rows: DataFrame, top: int = 20) -> DataFrame:
    return index_rows.orderBy(F.col("congestion_index").desc(), "node").limit(top)


def congestion_bands(index_rows: DataFrame) -> DataFrame:
    """band, nodes: how many nodes are congested, busy (index over 0.5) or normal."""
    band = F.when(F.col("is_congested"), "congested").when(F.col("congestion_index") > 0.5, "busy").otherwise("normal")
    return index_rows.groupBy(band.alias("band")).agg(F.count("*").alias("nodes"))


def report(room: DataFrame, community_rows: DataFrame) -> DataFrame:
    """One row: the global congestion index, congested nodes and their share, communities and saturated ones."""
    index = F.col("traffic") / (F.col("capacity") * F.col("windows"))
    used = F.count_if(F.col("traffic") > 0)
    total = F.sum("traffic") / (F.sum("capacity") * F.max("windows"))
    nodes = room.agg(F.round(total, 4).alias("global_congestion_index"), F.count_if(index > 1).alias("n_congested_nodes"), F.round(F.count_if(index > 1) / F.greatest(used, F.lit(1)), 4).alias("congested_node_ratio"))
    groups = community_capacity(room, community_rows).agg(F.count("*").alias("n_communities"), F.count_if("is_saturated").alias("n_saturated_communities"))
    return nodes.crossJoin(groups)  # one row each
