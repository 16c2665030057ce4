"""Connected components by alternating large-star and small-star rounds, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Edges up to which one task joins them all (some 100 MB); beyond, rounds over the cluster do.
LOCAL_EDGES = 400_000


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: every node with its smallest connected node."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for df in batches:
        for a, b in zip(df["a"].tolist(), df["b"].tolist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]})


def connected_components(edges: DataFrame, ws: Workspace, name: str = "stars", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """edges (a, b): one row for each linked node, (node, component), the component being
    its smallest node; nodes without an edge are absent. Each round is written to the
    shared folder; only a count and a sum reach the driver. The neighbours of a hub are
    never gathered: minima are pre-aggregated, and the join's hot side is split by AQE."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = ws.write(e, f"{name}0")
    if e.count() <= local_edges:
        kind = dict(e.dtypes)["a"]
        return ws.write(e.coalesce(1).mapInPandas(_union, f"node {kind}, component {kind}"), f"{name}-local")
    k, before = 0, None
    while True:
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()
        large = ws.write(large, f"{name}{k}l")
        # small star: every node and its smaller neighbours move to the smallest of them
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.join(least, large["b"] == least["u"]).where("a <> m").select("m", F.col("a").alias("b"))
        small = moved.unionByName(least.select("m", F.col("u").alias("b"))).select(F.col("m").alias("a"), "b").distinct()
        k += 1
        e = ws.write(small, f"{name}{k}")
        ws.drop(f"{name}{k - 1}l")
        ws.drop(f"{name}{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        # a star forest is reached when nothing moves any more
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
