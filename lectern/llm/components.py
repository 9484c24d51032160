"""Connected components of an edge table, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for edges ``a, b`` of long ids.

    Large-star and small-star steps in turn: each links a node's neighbours to the
    smallest one, so the table never outgrows the edges and ends as stars. Smallest
    neighbours come from partial aggregation and are joined back, so a hub is never
    gathered in one task. Each round is cut by a reliable checkpoint.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.shiftright("b", 20))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                current.select("b", "b").distinct()
            )
        before = state
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut_lineage(small.unionAll(smallest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
