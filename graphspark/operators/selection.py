"""Splits, masks and selection by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_masks(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """``node, is_train, is_valid, is_test``; all false for nodes of no split."""
    found = nodes.select("node").join(splits, "node", "left")
    return found.select("node", *(F.coalesce(F.col("split") == x, F.lit(False)).alias(f"is_{x}") for x in ("train", "valid", "test")))


def splits_from_masks(masks: DataFrame) -> DataFrame:
    """``node, split`` from boolean columns ``is_train, is_valid, is_test``."""
    name = F.when(F.col("is_train"), "train").when(F.col("is_valid"), "valid").when(F.col("is_test"), "test")
    return masks.select("node", name.alias("split")).where("split IS NOT NULL")


def fetch_split_nodes(assignment: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """``part, node`` of the nodes of a split."""
    return assignment.join(splits.where(F.col("split") == split), "node", "left_semi").select("part", "node")


def index_select(ids: DataFrame, values: DataFrame, key: str = "node") -> DataFrame:
    """Rows of ``values`` for each id, in the ids' own rows: repeats stay."""
    return ids.join(values, key, "left")
