"""Connected components of an edge table by alternating large-star and small-star steps.

Every step keeps the components and shortens paths; a node with very many edges is only ever
grouped by minimum (which Spark sums up per task first) and joined with that one row, so no task
holds a node's neighbours. The minima are stored before that join: then both of its sides are
dealt by it alone, and Spark can split a node with many edges. Each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.llm._shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b). Large: each node's larger neighbours go to its least one; small: each node's smaller ones."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = pairs.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.distinct()
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b); the root is the component's least node."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        e = stored(_star(_star(e, True), False), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
