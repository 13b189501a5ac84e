"""Connected components of an edge table, by alternating large-star and small-star steps.

All work is in joins and partial aggregations over edges; the driver sees one count and checksum a round, never edges or labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: of any type with an order); root is the smallest node that it reaches.

    Edges with a null end or two equal ends are ignored; repeated and reversed edges count once; no edges, no rows.
    Each round moves every node to the smallest neighbour of its neighbourhood; rounds grow with the logarithm of
    the longest path. A hub's edges are met by a join of two plain tables, which AQE splits when it is skewed.
    """
    mark = lambda frame: tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    here = settle(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(here)
    while True:
        both = here.select("a", "b").union(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a goes to the least of a's neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = settle(large, "large")
        # small star: each smaller neighbour of a, and a itself, goes to the least smaller neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = settle(small, "edges")
        drop_settled(here, large)
        here, before = after, seen
        seen = mark(here)  # edges that a round leaves as they were are the components
        if seen == before:
            break
    roots = here.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(here.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
