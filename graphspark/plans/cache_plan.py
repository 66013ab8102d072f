"""How a byte budget is divided between embeddings and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.operators.ingest import ranged


def ranked(values: DataFrame, value: str) -> DataFrame:
    """``node, value, rank (1..), upto`` by descending value, then id: the rank
    and the sum of the values up to it. Rows are dealt to ranges of value and id,
    so that many equal values are several ranges; only the ranges' sums meet in
    one task."""
    rows = values.select("node", F.col(value).cast("double").alias("value"))
    rows = ranged(rows, [F.col("value").desc(), F.col("node").asc()]).withColumnRenamed("_range", "range")
    sums = rows.groupBy("range").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    order = Window.partitionBy("range").orderBy(F.col("value").desc(), "node")
    rows = rows.withColumn("r", F.row_number().over(order)).withColumn("s", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(F.broadcast(sums), "range").select("node", "value", (F.col("n0") + F.col("r")).alias("rank"), (F.col("s0") + F.col("s")).alias("upto"))


def alpha_search(io: DataFrame, freq: DataFrame, budget: int, hidden: int, num_features: int) -> DataFrame:
    """One row ``alpha, n_emb, n_feat, benefit``: of 0.01..0.99, the share of the
    budget for embeddings with the most benefit, the smallest on ties. ``io(node,
    io)`` and ``freq(node, freq)`` cover all nodes. Without any benefit alpha is 0."""
    spark = io.sparkSession
    n = io.count()
    grid = []
    for a in range(1, 100):
        n_emb = min(max(int((budget * a / 100.0 - 8 * n) / (4 * hidden + 4)), 0), n)
        n_feat = min(max(int((budget * (1 - a / 100.0) - 4 * n) / (4 * num_features)), 0), n)
        grid.append((a / 100.0, n_emb, n_feat))
    plan = F.broadcast(spark.createDataFrame(grid, "alpha double, n_emb long, n_feat long"))
    e = ranked(io, "io").select(F.col("rank").alias("n_emb"), F.col("upto").alias("b_emb"))
    f = ranked(freq, "freq").select(F.col("rank").alias("n_feat"), F.col("upto").alias("b_feat"))
    # only the 99 places of the grid are looked up, from the side of the long tables
    e = F.broadcast(e.join(plan.select("n_emb").distinct(), "n_emb", "left_semi"))
    f = F.broadcast(f.join(plan.select("n_feat").distinct(), "n_feat", "left_semi"))
    found = plan.join(e, "n_emb", "left").join(f, "n_feat", "left")
    found = found.select("alpha", "n_emb", "n_feat", (F.coalesce("b_emb", F.lit(0.0)) + F.coalesce("b_feat", F.lit(0.0))).alias("benefit"))
    best = found.where("benefit > 0").orderBy(F.col("benefit").desc(), "alpha").limit(1)
    none = spark.createDataFrame([(0.0, 0, 0, 0.0)], "alpha double, n_emb long, n_feat long, benefit double")
    return best.union(none).orderBy(F.col("benefit").desc()).limit(1)


def candidates(values: DataFrame, value: str, count: int) -> DataFrame:
    """``node, slot`` of the ``count`` nodes with the largest values, then ids."""
    return ranked(values, value).where(F.col("rank") <= count).select("node", (F.col("rank") - 1).alias("slot"))
