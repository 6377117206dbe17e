"""Distributed union-find over an edge list, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has ``src`` and ``dst`` of one orderable type; self-loops, repeats and rows with a null are ignored. Returns one row
    ``(node, component)`` for each node of an edge, where ``component`` is one of the component's nodes, the same for all.

    Each round hooks every node to the smallest of itself and its neighbours, in the order of a hash of the ids, and contracts the
    edges along these hooks. Under a hash order a node is a local minimum with probability one over its degree plus one, so the
    edges shrink by a constant factor a round and long chains don't make long runs. Every aggregate has a map-side combine, the
    joins are plain shuffle joins that adaptive execution splits where a hub is hot, and each round ends in a written table.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))

    def tidy(e: DataFrame) -> DataFrame:
        a, b = rank(F.col("src")), rank(F.col("dst"))
        return e.where("src <> dst").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()

    live = materialize(tidy(edges), "cc-edges")
    labels = None
    while not live.isEmpty():
        both = live.select("src", "dst").union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.min(rank(F.col("dst"))).alias("least"))
        before = [live, labels]
        hooks = materialize(hooks.select("node", F.least(rank(F.col("node")), F.col("least"))["id"].alias("parent")), "cc-hooks")
        if labels is None:
            labels = materialize(hooks.select("node", F.col("parent").alias("component")), "cc-labels")
        else:
            moved = hooks.select(F.col("node").alias("component"), "parent")
            labels = materialize(labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
        ends = live.join(hooks.select(F.col("node").alias("src"), F.col("parent").alias("a")), "src").join(hooks.select(F.col("node").alias("dst"), F.col("parent").alias("b")), "dst")
        live = materialize(tidy(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "cc-edges")
        release(*before, hooks)
    return labels if labels is not None else live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
