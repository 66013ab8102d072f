"""Graphs over the given tables, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators.ingest import undirected


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def co_purchase(spark: SparkSession, sf_dir: str, by_src: bool = False) -> DataFrame:
    """Parts bought in one order, both directions. An order's distinct parts are
    paired in its own group, so that lines are shuffled once by order; orders
    are short by their nature. ``by_src``: the pairs of a ``src`` lie together, for
    operators that take them so and needn't shuffle them again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    rows = lines.select(F.explode("parts").alias("src"), "parts")
    if by_src:
        rows = rows.repartition("src")
    return rows.select("src", F.explode("parts").alias("dst")).where("src <> dst").distinct()


def part_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier, in one direction; suppliers are numbered after the parts."""
    n = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).distinct()


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    n = table(spark, sf_dir, "part").count()
    nodes = part_nodes(spark, sf_dir).union(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + n).alias("node")))
    return nodes, undirected(part_supplier_pairs(spark, sf_dir))


def customer_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): customers, numbered after the parts, and what they bought."""
    n = table(spark, sf_dir, "part").count()
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("src"), (F.col("o_custkey") + n).alias("dst"))
    nodes = part_nodes(spark, sf_dir).union(table(spark, sf_dir, "customer").select((F.col("c_custkey") + n).alias("node")))
    return nodes, undirected(pairs)


def features(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """``node, feat, label``: the vector whose id is the node's modulo their number."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    found = nodes.withColumn("vec_id", F.col("node") % n).join(vectors, "vec_id")
    return found.select("node", F.col("embedding").alias("feat"), F.col("label").cast("int").alias("label"))


def splits(nodes: DataFrame) -> DataFrame:
    """Six of ten nodes train, two validate, two test."""
    k = F.col("node") % 10
    return nodes.select("node", F.when(k < 6, "train").when(k < 8, "valid").otherwise("test").alias("split"))


def hashed_parts(nodes: DataFrame, parts: int) -> DataFrame:
    return nodes.select("node", (F.col("node") % parts).cast("int").alias("part"))
