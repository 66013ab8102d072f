"""What a partition assignment makes of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sided(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    a = assignment.select(F.col("node").alias("src"), F.col("part").alias("part_src"))
    b = assignment.select(F.col("node").alias("dst"), F.col("part").alias("part_dst"))
    return edges.join(a, "src").join(b, "dst")


def edge_cut(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: ``total_edges, edge_cut, ratio`` (two decimals, cut off; null without edges)."""
    found = _sided(edges, assignment).agg(F.count(F.lit(1)).alias("total_edges"), F.count_if(F.col("part_src") != F.col("part_dst")).alias("edge_cut"))
    return found.withColumn("ratio", F.floor(F.lit(100.0) * F.col("edge_cut") / F.expr("nullif(total_edges, 0)")) / F.lit(100.0))


def cross_edge_score(nodes: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``node, cross_edges``: entries of a node's row that lead out of its part."""
    found = _sided(edges, assignment).groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("part_src") != F.col("part_dst")).alias("n"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("cross_edges"))


def part_csr(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``part, src, dst``: rows of each part's nodes, with global ids."""
    return edges.join(assignment.select(F.col("node").alias("src"), "part"), "src").select("part", "src", "dst")


def super_batch_csr(edges: DataFrame, assignment: DataFrame, groups: DataFrame) -> DataFrame:
    """``super_batch, src, dst``: the rows of a super-batch's parts, put together."""
    return part_csr(edges, assignment).join(F.broadcast(groups), "part").select("super_batch", "src", "dst")


def first_level_mapping(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``part, local, node``: members first, by id; then foreign neighbours in
    the order in which the members' sorted rows first name them."""
    members = assignment.select("part", "node", (F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).cast("long").alias("local"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    entries = edges.withColumn("nbr_pos", place).join(members.select("part", F.col("node").alias("src"), F.col("local").alias("member_pos")), "src")
    foreign = entries.join(members.select("part", F.col("node").alias("dst")), ["part", "dst"], "left_anti")
    first = foreign.groupBy("part", F.col("dst").alias("node")).agg(F.min(F.struct("member_pos", "nbr_pos")).alias("first"))
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    found = first.withColumn("rank", rank).join(sizes, "part").select("part", (F.col("m") + F.col("rank")).cast("long").alias("local"), "node")
    return members.select("part", "local", "node").unionByName(found)


def first_level_relabel(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """``part, src_local, dst_local``: each part's rows in its own numbers."""
    mapping = first_level_mapping(edges, assignment)
    rows = part_csr(edges, assignment)
    rows = rows.join(mapping.select("part", F.col("node").alias("src"), F.col("local").alias("src_local")), ["part", "src"])
    return rows.join(mapping.select("part", F.col("node").alias("dst"), F.col("local").alias("dst_local")), ["part", "dst"]).select("part", "src_local", "dst_local")
