"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of the links (a, b); component is its smallest node.

    Alternates large-star and small-star steps until nothing changes: every step is a minimum per node with
    map-side combine and a join, and each round is kept as a table in the shared folder. A node with very many
    links is a skewed key of the join, which adaptive execution splits.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        near = large.join(low, "v")
        small = near.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        edges = stored(small.filter("v <> u").distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(
        roots.join(edges.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
