"""Degrees of a growing graph, over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_degrees(edges: DataFrame, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """``node, deg`` over a stream of ``src, dst`` and an event time. An edge that
    comes again within the watermark counts once; so does its other direction."""
    both = edges.select(ts, "src", "dst").union(edges.select(ts, F.col("dst").alias("src"), F.col("src").alias("dst")))
    once = both.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["src", "dst"])
    return once.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))


def windowed_degrees(edges: DataFrame, window: str = "1 hour", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """``window, node, deg``: new entries of each node per window of event time."""
    return edges.withWatermark(ts, lateness).groupBy(F.window(ts, window), F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
