"""Graphs as Parquet tables: sources, sinks and checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators.ingest import degrees, graph_meta, undirected
from graphspark.operators.selection import splits_from_masks


@dataclass
class Graph:
    """Nodes are dense ids from 0. ``nodes(node)``, ``edges(src, dst)``: both
    directions, each once; ``features(node, feat)``, ``labels(node, label)``,
    ``splits(node, split)``."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame
    labels: DataFrame
    splits: DataFrame

    TABLES = ("nodes", "edges", "features", "labels", "splits")

    @classmethod
    def from_edges(cls, edges: DataFrame, num_nodes: int, features: DataFrame, labels: DataFrame, splits: DataFrame) -> "Graph":
        """From a list of edges in one direction or both, with repeats."""
        nodes = edges.sparkSession.range(num_nodes).withColumnRenamed("id", "node")
        return cls(nodes, undirected(edges), features, clean_labels(labels), splits)

    def meta(self) -> DataFrame:
        return graph_meta(self.nodes, self.edges, self.features, self.labels)

    def degrees(self) -> DataFrame:
        return degrees(self.nodes, self.edges)

    def save(self, path: str) -> None:
        """Writes all tables. Edges are bucketed by range of their source, so
        that a reader of some nodes skips the other files."""
        for name in self.TABLES:
            df = getattr(self, name)
            if name == "edges":
                df = df.repartitionByRange("src").sortWithinPartitions("src", "dst")
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.meta().write.mode("overwrite").parquet(f"{path}/graph_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Graph":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))


def clean_labels(labels: DataFrame) -> DataFrame:
    """``node, label`` as integers; labels that are no number become null."""
    x = F.col("label").cast("double")
    return labels.select("node", F.when(~F.isnan(x), x.cast("int")).alias("label"))


def read_masked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, splits) of a node table with ``label`` and boolean masks."""
    table = spark.read.parquet(path)
    return clean_labels(table), splits_from_masks(table)


#: Records that one row of a raw file's pieces holds.
PIECE = 1 << 16


def _pieces(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``pos, part``: a raw file's records of ``size`` bytes, many in a row, with
    the place of the first. The file is split like any other; only the number of
    records of each split goes to the driver."""
    records = spark.sparkContext.binaryRecords(path, size)
    counts = dict(records.mapPartitionsWithIndex(lambda k, rows: [(k, sum(1 for _ in rows))]).collect())
    first = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))

    def pieces(k: int, rows: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        at = first[k]
        while part := list(islice(rows, PIECE)):
            yield at, b"".join(part)
            at += len(part)

    return spark.createDataFrame(records.mapPartitionsWithIndex(pieces), "pos long, part binary")


def load_int64(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value`` of a raw little-endian int64 array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pos, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + len(values))), pa.array(values)], ["pos", "value"])

    return _pieces(spark, path, 8).mapInArrow(run, "pos long, value long")


def load_float32(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``node, feat``: rows of ``width`` numbers of a raw little-endian float32 matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pos, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, "<f4")
                n = len(values) // width
                feat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + n)), feat], ["node", "feat"])

    return _pieces(spark, path, 4 * width).mapInArrow(run, "node long, feat array<float>")


def read_csr(spark: SparkSession, indptr: str, indices: str) -> DataFrame:
    """``src, dst`` from two raw little-endian int64 arrays: rows' starts and
    column ids, read in splits."""
    starts = load_int64(spark, indptr).withColumnRenamed("value", "start")
    ends = starts.select((F.col("pos") - 1).alias("pos"), F.col("start").alias("end"))
    rows = starts.join(ends, "pos").where("end > start").select(F.col("pos").alias("src"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return rows.join(load_int64(spark, indices).withColumnRenamed("value", "dst"), "pos").select("src", "dst")


def read_edge_lists(spark: SparkSession, path: str, num_nodes: int, features: str, width: int, labels: str, splits: dict[str, str]) -> Graph:
    """A graph from Parquet edges ``src, dst`` in any direction, raw float32
    ``features`` of ``width`` and ``labels``, and node lists (Parquet ``node``) by
    split, as public collections of graphs are laid out on disk."""
    own = None
    for name, place in splits.items():
        part = spark.read.parquet(place).select("node", F.lit(name).alias("split"))
        own = part if own is None else own.unionByName(part)
    told = load_float32(spark, labels, 1).select("node", F.element_at("feat", 1).alias("label"))
    return Graph.from_edges(spark.read.parquet(path).select("src", "dst"), num_nodes, load_float32(spark, features, width), told, own)


def save_partitioned(edges: DataFrame, assignment: DataFrame, splits: DataFrame, path: str) -> None:
    """Rows and members of each part, one folder per part: reading some parts
    reads their files alone."""
    from graphspark.operators.cuts import part_csr

    part_csr(edges, assignment).repartition("part").sortWithinPartitions("part", "src", "dst").write.mode("overwrite").partitionBy("part").parquet(f"{path}/edges")
    assignment.join(splits, "node", "left").select("part", "node", "split").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/members")


def load_parts(spark: SparkSession, path: str, parts: list[int]) -> tuple[DataFrame, DataFrame]:
    """(edges, members) of some parts."""
    return tuple(spark.read.parquet(f"{path}/{name}").where(F.col("part").isin(parts)) for name in ("edges", "members"))


def save_trace(levels: list[DataFrame], rows: list[DataFrame], path: str) -> None:
    """The sampled rows and node lists of all batches, by batch."""
    every = lambda tables: [x.withColumn("trace_layer", F.lit(k)) for k, x in enumerate(tables)]
    for name, tables in (("rows", every(rows)), ("nids", every(levels))):
        whole = tables[0]
        for x in tables[1:]:
            whole = whole.unionByName(x)
        whole.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{path}/{name}")


def load_trace(spark: SparkSession, path: str, batches: list[int] | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, rows) of a saved trace; with ``batches`` only those folders are read."""
    out = []
    for name in ("nids", "rows"):
        whole = spark.read.parquet(f"{path}/{name}")
        whole = whole.withColumn("batch", F.col("batch").cast("long"))
        if batches is not None:
            whole = whole.where(F.col("batch").isin(batches))
        out.append(whole)
    n = out[0].agg(F.max("trace_layer")).first()[0] or 0
    return tuple([whole.where(F.col("trace_layer") == k).drop("trace_layer") for k in range(count)] for whole, count in zip(out, (n + 1, n)))


def save_neighbor_cache(cache: DataFrame, words: DataFrame, size: int, path: str) -> None:
    """The cache's address table and words, in order, and its size in bytes."""
    cache.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/table")
    words.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/words")
    cache.sparkSession.range(1).select(F.lit(size).cast("long").alias("bytes")).write.mode("overwrite").parquet(f"{path}/conf")


def load_neighbor_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(``node, address``; ``pos, word``; bytes) of a saved cache."""
    return spark.read.parquet(f"{path}/table"), spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/conf").first().bytes


def cached_rows(table: DataFrame, words: DataFrame) -> DataFrame:
    """``node, dst``: the neighbours that a cache holds for its nodes."""
    rows = table.join(words, F.col("address") == F.col("pos")).select("node", F.explode(F.expr("CASE WHEN word > 0 THEN sequence(address + 1, address + word) END")).alias("pos"))
    return rows.join(words, "pos").select("node", F.col("word").alias("dst"))
