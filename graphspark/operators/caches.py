"""Neighbour, feature and embedding caches under byte budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.operators.ingest import ranged, running_sum

INT32_MAX = (1 << 31) - 1


def neighbor_capacity(size: int, num_nodes: int) -> int:
    """Words that are left of ``size`` bytes beside the address table."""
    words = (size - 8 * num_nodes) // 8
    if words < 0:
        raise ValueError(f"{size} bytes don't hold the address table of {num_nodes} nodes")
    return words


def feature_capacity(size: float, num_nodes: int, num_features: int) -> int:
    """Feature rows that fit beside the address table."""
    rows = int((size - 4 * num_nodes) / 4 / num_features)
    if rows > INT32_MAX:
        raise ValueError("more rows than a 32-bit slot can name")
    return max(0, rows)


def neighbor_cache(score: DataFrame, degrees: DataFrame, size: int, num_nodes: int) -> DataFrame:
    """``node, address``: the longest run of nodes by descending score (then
    id) whose rows, a word longer than their degree, fit. No rows if nothing does."""
    capacity = neighbor_capacity(size, num_nodes)
    rows = score.select("node", F.col("cross_edges").alias("score")).join(degrees, "node").withColumn("words", F.col("deg") + 1)
    order = [F.col("score").desc(), F.col("node").asc()]
    placed = running_sum(ranged(rows, order), "words", "upto", [F.col("_range")], order)
    return placed.where(F.col("upto") <= capacity).select("node", (F.col("upto") - F.col("words")).alias("address"))


def neighbor_cache_fill(cache: DataFrame, edges: DataFrame) -> DataFrame:
    """``pos, word``: the cache's words: at each address the count, then the neighbours, ascending."""
    order = Window.partitionBy("node").orderBy("dst")
    rows = cache.join(edges.withColumnRenamed("src", "node"), "node").withColumn("r", F.row_number().over(order))
    counts = cache.join(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "left").select(F.col("address").alias("pos"), F.coalesce("n", F.lit(0)).alias("word"))
    return counts.union(rows.select((F.col("address") + F.col("r")).alias("pos"), F.col("dst").alias("word")))


def feature_cache_table(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``node, state, slot`` before the first batch: -2 for no candidate, -1 for
    one that isn't filled; slot by rank among the candidates, else null."""
    found = nodes.select("node").join(candidates.select("node", "slot"), "node", "left")
    return found.select("node", F.when(F.col("slot").isNull(), F.lit(-2)).otherwise(F.lit(-1)).alias("state"), "slot")


def feature_accesses(access: DataFrame, candidates: DataFrame) -> DataFrame:
    """``batch, node, slot, hit``: an access hits if its node is a candidate that
    an earlier batch has filled."""
    first = access.groupBy("node").agg(F.min("batch").alias("first"))
    found = access.join(candidates.select("node", "slot"), "node", "left").join(first, "node")
    return found.select("batch", "node", "slot", (F.col("slot").isNotNull() & (F.col("batch") > F.col("first"))).alias("hit"))


def feature_cache_hits(access: DataFrame, candidates: DataFrame) -> DataFrame:
    """``batch, accesses, hits``."""
    return feature_accesses(access, candidates).groupBy("batch").agg(F.count(F.lit(1)).alias("accesses"), F.count_if("hit").alias("hits"))


def embedding_table(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``node, state, slot, last_push`` before the first batch: -3 for no
    candidate, -2 for one that was never computed."""
    found = nodes.select("node").join(candidates.select("node", "slot"), "node", "left")
    return found.select("node", F.when(F.col("slot").isNull(), F.lit(-3)).otherwise(F.lit(-2)).alias("state"), "slot", F.lit(None).cast("long").alias("last_push"))


def embedding_actions(onehop: DataFrame, staleness: int) -> DataFrame:
    """``batch, node, action``: over a node's batches in order, the first is a
    push; a later one pulls if the last push is less than ``staleness`` batches
    ago, else it pushes again. A node's batches are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for part in batches:
            actions = []
            for node, batch in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if node != now or batch - last >= staleness:
                    now, last = node, batch
                    actions.append("push")
                else:
                    actions.append("pull")
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(actions, pa.string())], ["batch", "node", "action"])

    rows = onehop.select(F.col("node").cast("long").alias("node"), F.col("batch").cast("long").alias("batch")).distinct()
    return rows.repartition("node").sortWithinPartitions("node", "batch").mapInArrow(run, "batch long, node long, action string")


def embedding_sources(actions: DataFrame) -> DataFrame:
    """``batch, node, source``: for each pull, the latest batch that pushed the node."""
    order = Window.partitionBy("node").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    pushed = F.last(F.when(F.col("action") == "push", F.col("batch")), ignorenulls=True).over(order)
    return actions.withColumn("source", pushed).where("action = 'pull'").select("batch", "node", "source")


def pulled_embeddings(actions: DataFrame, pushed: DataFrame) -> DataFrame:
    """``batch, node, vec``: what each pull reads from ``pushed(batch, node, vec)``."""
    return embedding_sources(actions).join(pushed.withColumnRenamed("batch", "source"), ["node", "source"]).select("batch", "node", "vec")
