"""Connected components of links by repeated minimum labels, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwise.llm.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); ``comp`` is the least node of its component.

    Every round replaces each link by links to the least neighbour (large star, then small star), which
    halves paths; it ends when a round changes nothing.  Sums over both sides find that without collecting.
    Empty input gives an empty table.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a node are linked to its least neighbour (or itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large")
        # small star: neighbours below a node, and itself, are linked to the least of them
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = edges.groupBy("v").agg(F.lit(1).alias("_one")).select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(roots)
