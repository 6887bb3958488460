"""Connected components of a graph that no machine holds whole: large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges(a, b) the smallest node that it is connected with. No row for nodes without an edge.

    Every round is written to the shared folder, so a lost executor costs one round at most. A round keeps at most as many rows as it
    got; the number of rounds grows with the logarithm of the graph's size.
    """
    stars = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        # large star: each node's larger neighbours are tied to the smallest of its neighbourhood
        both = stars.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(stars.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: each node and its smaller neighbours are tied to the smallest of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        stars = large.join(low, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        stars = written(stars, "edges")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == state:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        state = now
