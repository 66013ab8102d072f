"""Super-batches of partitions and mini-batches of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.keys import order_key


def super_batches(assignment: DataFrame, partition_batch: int, seed: int, epoch: int = 0) -> DataFrame:
    """``part, super_batch``: partitions in hashed order, ``partition_batch`` at a time.
    The one task that ranks them sees a row per partition."""
    order = Window.orderBy(order_key(seed, epoch, F.lit("part"), "part"), "part")
    parts = assignment.select("part").distinct()
    return parts.withColumn("super_batch", F.floor((F.row_number().over(order) - 1) / partition_batch).cast("long"))


def mini_batches(assignment: DataFrame, splits: DataFrame, batch_size: int, partition_batch: int, seed: int, epoch: int = 0, split: str = "train") -> DataFrame:
    """``batch, node, idx``: the seeds of a split in hashed order within their
    super-batch, ``batch_size`` at a time; the last one of a super-batch may be
    short. Super-batches without seeds have no batch."""
    groups = super_batches(assignment, partition_batch, seed, epoch)
    order = Window.partitionBy("super_batch").orderBy(order_key(seed, epoch, F.lit("node"), "node"), "node")
    seeds = assignment.join(splits.where(F.col("split") == split), "node", "left_semi").join(F.broadcast(groups), "part")
    seeds = seeds.select("super_batch", "node", (F.row_number().over(order) - 1).alias("pos"))
    counts = seeds.groupBy("super_batch").agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("n"))
    before = Window.orderBy("super_batch").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("super_batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = seeds.join(F.broadcast(first), "super_batch")
    return placed.select((F.col("first") + F.floor(F.col("pos") / batch_size)).cast("long").alias("batch"), "node", (F.col("pos") % batch_size).cast("long").alias("idx"))
