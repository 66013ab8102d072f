"""From edge lists to a graph in compressed sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.session import settled

#: Nodes of a range whose running sums one task takes.
RANGE = 1 << 16


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once; a self-loop once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def transposed(edges: DataFrame) -> DataFrame:
    """Incoming instead of outgoing entries."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, deg``; 0 for isolated nodes."""
    found = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def running_sum(rows: DataFrame, value: str, out: str, ranges: list[Column], order: list[Column]) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and with each row in ``order``.

    ``ranges``: expressions that ``order`` never descends, with rows enough in
    each for one task and few values in all. Only the ranges' sums are sorted
    in one task; rows are summed within their range.
    """
    names = [f"_range{k}" for k in range(len(ranges))]
    rows = rows.withColumns(dict(zip(names, ranges)))
    sums = rows.groupBy(*names).agg(F.sum(value).alias("_sum"))
    whole = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(whole), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(within)).join(before, names).withColumn(out, F.col(out) + F.col("_before")).drop(*names, "_before")


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, written once, with ``_range``: a number that ``order`` never
    descends, each of about ``RANGE`` rows. The ranges are over all of ``order``,
    so that ties of its first columns fall into several."""
    n = max(1, -(-rows.count() // RANGE))
    return settled(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def csr_indptr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, indptr``: where a node's row begins, and a closing row for the end."""
    deg = degrees(nodes, edges)
    rows = running_sum(deg, "deg", "upto", [F.floor(F.col("node") / RANGE)], [F.col("node")]).select("node", (F.col("upto") - F.col("deg")).alias("indptr"))
    end = deg.agg(F.coalesce(F.max("node") + 1, F.lit(0)).cast("long").alias("node"), F.coalesce(F.sum("deg"), F.lit(0)).cast("long").alias("indptr"))
    return rows.union(end)


def csr_indices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pos, src, dst``: each entry with its place in the column array."""
    order = Window.partitionBy("src").orderBy("dst")
    starts = csr_indptr(nodes, edges).withColumnRenamed("node", "src")
    return edges.withColumn("r", F.row_number().over(order)).join(starts, "src").select((F.col("indptr") + F.col("r") - 1).alias("pos"), "src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, nbrs`` (ascending), ``deg``; no row for isolated nodes."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).withColumn("deg", F.size("nbrs").cast("long"))


def graph_meta(nodes: DataFrame, edges: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``num_nodes, num_edges, num_features, num_classes``."""
    n = nodes.agg(F.count(F.lit(1)).alias("num_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("num_edges"))
    f = features.agg(F.coalesce(F.max(F.size("feat")), F.lit(0)).cast("long").alias("num_features"))
    c = labels.agg(F.count_distinct("label").alias("num_classes"))
    return n.crossJoin(e).crossJoin(f).crossJoin(c)
