"""Connected components of a table of links, in a few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of
    ``links(a, b)`` (longs, not null).

    Alternating stars: each node hands its larger neighbours to its smallest
    one, then its smaller ones, until nothing changes. The number of rounds
    grows with the logarithm of a component's size. Each round is a written
    table; nothing but a checksum goes to the driver. No links: no rows.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("x > n").join(least, "n").select(F.col("x").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # every edge now points from the larger v to the smaller u
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").union(least.select("v", F.col("m").alias("u"))).distinct()
        edges = staged(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    found = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    roots = edges.select(F.col("u").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots)
