"""Connected components of a graph of any size, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from urlvane.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for all ends of edges (a, b): component is the smallest id that can be reached.

    Large-star and small-star steps alternate until the edges stay the same: every neighbour of a node is tied to
    the smallest one. Minima are combined map-side and joined back, so a hub is never collected. Edges are written
    to the shared folder each round; a round at least halves the longest path.
    """
    current = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    current = written(current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b")))
        current = written(small.filter("a <> b").distinct(), "edges")
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    # now every edge leads from a node to the smallest of its component
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
