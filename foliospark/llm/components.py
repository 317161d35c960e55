"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges stored in one file.
PART_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node it reaches.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest it sees, which about
    halves path lengths; it ends when the edge count and the sum of roots stand still. Minima are combined
    before each shuffle, and the joins are equi-joins that AQE can split, so a hub is not one task's work.
    Edges are stored after each round, which keeps plans short and survives lost executors, in as few files as
    PART_EDGES an edge file allows: rounds never add edges. No edges: no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    parts = edges.count() // PART_EDGES + 1
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u <> v").distinct().coalesce(parts))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
