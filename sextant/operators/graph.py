"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.storage import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long, never null); label is the least node reachable.

    Each round reads and writes one edge table in the shared folder and deletes the one before; rounds grow with the
    logarithm of the nodes. Minima are pre-aggregated before they are shuffled and joined back, so a node with very many
    neighbours is never gathered. Self edges and repeated edges are harmless; no edges give no rows.
    """
    pairs = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour of u moves to the least of u's neighbourhood
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u's smaller neighbours, and u, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        before, pairs = pairs, cut(small, "edges")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
