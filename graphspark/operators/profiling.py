"""What sampling touches: access counts and sizes of sampled subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.operators.sampling import discoveries


def access_freq(last_targets: DataFrame) -> DataFrame:
    """``node, freq``: batches in whose final node list a node is."""
    return last_targets.select("batch", "node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("freq"))


def spmm_sum(rows: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """``batch, node, total``: over each target's row, the sum of its neighbours' values."""
    v = values.select("batch", F.col("node").alias("dst"), value)
    return rows.join(v, ["batch", "dst"]).groupBy("batch", F.col("src").alias("node")).agg(F.sum(value).alias("total"))


def subtree_sizes(levels: list[DataFrame], rows: list[DataFrame]) -> DataFrame:
    """``node, size``: nodes of the sampled subtrees under each one-hop node,
    summed over batches.

    ``levels``: targets of layers 0..L; ``rows``: rows of layers 0..L-1, of
    which layer 0 is left out. From the outermost layer inwards each target
    gets the sum over its row, and one for itself except at the last step.
    With one layer all sizes are one.
    """
    depth = len(rows)
    sizes = levels[depth].select("batch", "node").distinct().withColumn("value", F.lit(1).cast("long"))
    for layer in range(depth - 1, 0, -1):
        found = spmm_sum(rows[layer], sizes)
        own = 0 if layer == 1 else 1
        sizes = levels[layer].select("batch", "node").join(found, ["batch", "node"], "left").select("batch", "node", (F.coalesce("total", F.lit(0)) + own).cast("long").alias("value"))
    return sizes.groupBy("node").agg(F.sum("value").alias("size"))


def neigh_size_before(levels: list[DataFrame], rows: list[DataFrame]) -> DataFrame:
    """Subtree sizes over all sampled edges."""
    return subtree_sizes(levels, rows)


def neigh_size_after(levels: list[DataFrame], rows: list[DataFrame]) -> DataFrame:
    """Subtree sizes over the edges that first meet a node."""
    return subtree_sizes(levels, [discoveries(t, r) for t, r in zip(levels, rows)])


def node_io(nodes: DataFrame, before: DataFrame, after: DataFrame, beta: float) -> DataFrame:
    """``node, io`` = before * beta + after; nodes that were never reached count zero."""
    b, a = before.withColumnRenamed("size", "b"), after.withColumnRenamed("size", "a")
    found = nodes.select("node").join(b, "node", "left").join(a, "node", "left")
    return found.select("node", (F.coalesce("b", F.lit(0)) * F.lit(float(beta)) + F.coalesce("a", F.lit(0))).alias("io"))


def beta(sample_seconds: float, gather_seconds: float, before: DataFrame, after: DataFrame) -> float:
    """Seconds per sampled edge over seconds per gathered row; 0 if either sum is."""
    total = lambda x: x.agg(F.sum("size")).first()[0] or 0
    b, a = total(before), total(after)
    return (sample_seconds / b) / (gather_seconds / a) if a and b and gather_seconds else 0.0
