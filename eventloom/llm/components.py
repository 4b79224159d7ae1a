"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.llm.storage import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): every node of the links (a, b), with the smallest node it reaches.

    Rounds of large and small stars: each node's neighbours are linked to the smallest of them,
    first the larger neighbours, then the smaller. Minima are aggregated before the join, and stored,
    so that Spark can split a node with many neighbours. Each round is a stored table; the
    number of rounds grows with the logarithm of the longest chain."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a != b").distinct(), label)
    state = None
    while True:
        # Large star: neighbours larger than u are linked to the smallest around u.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
            "a != b").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        edges = stored(edges, label)
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), label)
        edges = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stored(edges, label)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
