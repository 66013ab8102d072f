"""One query per graph operator, over the graphs of ``sources.graphs``.

All take (spark, sf_dir). Parameters are those of the module; the SQL of each
is in ``oracle``. Results are scalar columns; floats are rounded to 6 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators import batching, caches, cuts, gather, ingest, partition, profiling, sage, sampling, selection
from graphspark.plans import cache_plan
from graphspark.session import settled, settled_dir
from graphspark.sources import graphs, store
from graphspark.sources.store import Graph

SEED, PARTS, PARTITION_BATCH, BATCH = 7, 20, 4, 100
SIZES = [3, 2, 2]
STALENESS = 3
BETA = 0.5
#: Bytes of the caches, per node, and widths of the model.
NEIGHBOR_BYTES, PLAN_BYTES, HIDDEN = 60, 200, 16
CLASSES = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Setting:
    """The co-purchase graph with a hashed assignment, splits and batches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.nodes = graphs.part_nodes(spark, sf_dir)
        self.edges = graphs.co_purchase(spark, sf_dir)
        self.splits = graphs.splits(self.nodes)
        self.assignment = graphs.hashed_parts(self.nodes, PARTS)

    def settle(self) -> "Setting":
        self.edges = settled(self.edges, "edges")
        return self

    @property
    def n(self) -> int:
        return self.nodes.count()

    def features(self) -> DataFrame:
        return graphs.features(self.spark, self.dir, self.nodes)

    def batches(self) -> DataFrame:
        return batching.mini_batches(self.assignment, self.splits, BATCH, PARTITION_BATCH, SEED)

    def khop(self, layers: int, **options):
        self.settle()
        return sampling.sample_khop(self.batches(), self.edges, SIZES[:layers], SEED, **options)

    def score(self) -> DataFrame:
        return cuts.cross_edge_score(self.nodes, self.edges, self.assignment)

    def access(self) -> DataFrame:
        """Nodes that the batches gather, after one layer."""
        return self.khop(1)[0][1].select("batch", "node", "idx")

    def profile(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(freq, before, after) over two layers."""
        levels, rows = self.khop(2)
        return profiling.access_freq(levels[-1]), profiling.neigh_size_before(levels, rows), profiling.neigh_size_after(levels, rows)

    def candidates(self) -> DataFrame:
        """A fifth of the nodes, those with the largest degree, by slot."""
        return cache_plan.candidates(ingest.degrees(self.nodes, self.edges), "deg", self.n // 5)

    def actions(self) -> DataFrame:
        onehop = self.khop(1)[0][1]
        return caches.embedding_actions(onehop.join(self.candidates().select("node"), "node", "left_semi"), STALENESS)


def exploded(rows: DataFrame, keys: list[str], array: str, out: str = "value") -> DataFrame:
    """A row per entry, rounded."""
    return rows.select(*keys, F.posexplode(array).alias("pos", out)).select(*keys, F.col("pos").cast("long").alias("pos"), F.round(F.col(out).cast("double"), 6).alias(out))


def layered(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """All layers' tables, with the number of the layer."""
    out = None
    for k, x in enumerate(tables):
        x = x.selectExpr(*columns).withColumn("block", F.lit(k).cast("long"))
        out = x if out is None else out.unionByName(x)
    return out


ROW = ["batch", "src", "dst", "idx", "CAST(r AS LONG) AS r"]

# ingest and selection


@query
def undirected_edges(spark, sf_dir):
    return graphs.part_supplier(spark, sf_dir)[1]


@query
def customer_part_edges(spark, sf_dir):
    return graphs.customer_part(spark, sf_dir)[1]


@query
def csr_indptr(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return ingest.csr_indptr(s.nodes, s.edges)


@query
def csr_indices(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return ingest.csr_indices(s.nodes, s.edges)


@query
def csc_indptr(spark, sf_dir):
    nodes, _ = graphs.part_supplier(spark, sf_dir)
    return ingest.csr_indptr(nodes, ingest.transposed(graphs.part_supplier_pairs(spark, sf_dir)))


@query
def degrees(spark, sf_dir):
    nodes, edges = graphs.customer_part(spark, sf_dir)
    return ingest.degrees(nodes, edges)


@query
def graph_meta(spark, sf_dir):
    s = Setting(spark, sf_dir)
    found = s.features()
    return ingest.graph_meta(s.nodes, s.edges, found, found)


@query
def split_masks(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return selection.split_masks(s.nodes, s.splits)


@query
def mask_splits(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return selection.splits_from_masks(selection.split_masks(s.nodes, s.splits))


@query
def fetch_split_nodes(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return selection.fetch_split_nodes(s.assignment, s.splits, "valid")


def _folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{settled_dir(spark)}/saved-{uuid.uuid4().hex}"


@query
def edge_source_roundtrip(spark, sf_dir):
    s, path = Setting(spark, sf_dir), _folder(spark)
    known = s.features()
    Graph(s.nodes, s.edges, known.select("node", "feat"), known.select("node", "label"), s.splits).save(path)
    return Graph.load(spark, path).edges


@query
def part_folders(spark, sf_dir):
    """Partition folders, written and then read for some parts only."""
    s, path = Setting(spark, sf_dir), _folder(spark)
    store.save_partitioned(s.edges, s.assignment, s.splits, path)
    edges, members = store.load_parts(spark, path, [1, 5, 12])
    rows = members.where("split = 'train'").select("part", "node").join(edges.select(F.col("src").alias("node"), "dst"), "node")
    return rows.select(F.col("part").cast("long").alias("part"), "node", "dst")


@query
def batch_labels(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return selection.index_select(s.batches(), s.features().select("node", "label")).select("batch", "idx", "node", "label")


@query
def super_batches(spark, sf_dir):
    return batching.super_batches(Setting(spark, sf_dir).assignment, PARTITION_BATCH, SEED)


@query
def mini_batches(spark, sf_dir):
    return Setting(spark, sf_dir).batches()


# partitions


@query
def edge_cut(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return cuts.edge_cut(s.edges, s.assignment)


@query
def cross_edge_score(spark, sf_dir):
    return Setting(spark, sf_dir).score()


@query
def part_csr(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return cuts.part_csr(s.edges, s.assignment)


@query
def super_batch_csr(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return cuts.super_batch_csr(s.edges, s.assignment, batching.super_batches(s.assignment, PARTITION_BATCH, SEED))


@query
def first_level_relabel(spark, sf_dir):
    s = Setting(spark, sf_dir).settle()
    return cuts.first_level_relabel(s.edges, s.assignment)


def _train(s: Setting) -> DataFrame:
    return s.splits.where(F.col("split") == "train").select("node")


def _longs(df: DataFrame) -> DataFrame:
    return df.select("node", *(F.col(x).cast("long").alias(x) for x in df.columns if x != "node"))


def _one_level(spark, sf_dir, **options) -> DataFrame:
    s = Setting(spark, sf_dir)
    return _longs(partition.fennel(s.nodes, graphs.co_purchase(spark, sf_dir, by_src=True), _train(s), PARTS // 2, imbalance=1.3, **options))


@query
def fennel(spark, sf_dir):
    return _one_level(spark, sf_dir)


@query
def fennel_refine(spark, sf_dir):
    return _one_level(spark, sf_dir, rounds=2)


@query
def fennel_bloom(spark, sf_dir):
    return _one_level(spark, sf_dir, membership="bloom")


@query
def fennel_two_level(spark, sf_dir):
    s = Setting(spark, sf_dir).settle()
    return _longs(partition.fennel_two_level(s.nodes, s.edges, _train(s), PARTS, 4, imbalance=1.3))


# sampling


@query
def sample_full(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return sampling.sample_layer(s.batches(), s.edges, -1, SEED, 0).selectExpr(*ROW)


@query
def sample_k(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return sampling.sample_layer(s.batches(), s.edges, 10, SEED, 0).selectExpr(*ROW)


@query
def sample_replace(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return sampling.sample_layer(s.batches(), s.edges, 5, SEED, 0, replace=True).selectExpr(*ROW)


@query
def sample_khop3(spark, sf_dir):
    return layered(Setting(spark, sf_dir).khop(3)[1], ROW)


@query
def trace_roundtrip(spark, sf_dir):
    """Sampled rows, written as a trace and read again for the first batches."""
    levels, rows = Setting(spark, sf_dir).khop(2)
    path = _folder(spark)
    store.save_trace(levels, rows, path)
    return layered(store.load_trace(spark, path, [0, 1, 2])[1], ROW)


@query
def sample_valid_mode(spark, sf_dir):
    """Batches of the nodes for validation."""
    s = Setting(spark, sf_dir)
    seeds = batching.mini_batches(s.assignment, s.splits, BATCH, PARTITION_BATCH, SEED, split="valid")
    return sampling.sample_layer(seeds, s.edges, 10, SEED, 0).selectExpr(*ROW)


@query
def sample_nid_relabel(spark, sf_dir):
    levels, rows = Setting(spark, sf_dir).khop(2)
    return sampling.blocks(levels[2], rows[1]).select("batch", "dst_node", "src_node", "dst_local", "src_local")


@query
def sample_profiling_first_discovery(spark, sf_dir):
    levels, rows = Setting(spark, sf_dir).khop(2)
    return layered([sampling.discoveries(t, r) for t, r in zip(levels, rows)], ROW)


@query
def sample_reuse_rows(spark, sf_dir):
    return layered(Setting(spark, sf_dir).khop(3, reuse=True)[1], ROW)


@query
def sample_prune(spark, sf_dir):
    s = Setting(spark, sf_dir).settle()
    _, rows, _ = sampling.sample_pruned(s.batches(), s.edges, s.candidates(), SIZES, STALENESS, SEED)
    return layered(rows, ROW)


@query
def sample_tiers(spark, sf_dir):
    s = Setting(spark, sf_dir).settle()
    groups = batching.super_batches(s.assignment, PARTITION_BATCH, SEED)
    seeds = s.batches()
    home = seeds.join(s.assignment, "node").join(groups, "part").select("batch", "super_batch").distinct()
    cached = caches.neighbor_cache(s.score(), ingest.degrees(s.nodes, s.edges), NEIGHBOR_BYTES * s.n, s.n)
    rows = sampling.tiers(sampling.sample_layer(seeds, s.edges, 3, SEED, 0), s.assignment, groups, home, cached)
    return rows.groupBy("batch", "tier").agg(F.count(F.lit(1)).alias("n"))


# profiling and plans


@query
def access_freq(spark, sf_dir):
    return Setting(spark, sf_dir).profile()[0]


@query
def neigh_size_before(spark, sf_dir):
    return Setting(spark, sf_dir).profile()[1]


@query
def neigh_size_after(spark, sf_dir):
    return Setting(spark, sf_dir).profile()[2]


@query
def spmm_sum(spark, sf_dir):
    levels, rows = Setting(spark, sf_dir).khop(1)
    ones = levels[1].select("batch", "node", F.col("idx").alias("value"))
    return profiling.spmm_sum(rows[0], ones)


def _node_io(s: Setting) -> tuple[DataFrame, DataFrame]:
    freq, before, after = s.profile()
    every = s.nodes.join(freq, "node", "left").select("node", F.coalesce("freq", F.lit(0)).alias("freq"))
    return settled(profiling.node_io(s.nodes, before, after, BETA), "io"), settled(every, "freq")


@query
def node_io_prefix(spark, sf_dir):
    return cache_plan.ranked(_node_io(Setting(spark, sf_dir))[0], "io").select("node", F.col("value").alias("io"), F.col("rank").cast("long").alias("rank"), "upto")


@query
def alpha_search(spark, sf_dir):
    s = Setting(spark, sf_dir)
    io, freq = _node_io(s)
    return cache_plan.alpha_search(io, freq, PLAN_BYTES * s.n, HIDDEN, 64)


@query
def cache_candidates(spark, sf_dir):
    s = Setting(spark, sf_dir)
    io, freq = _node_io(s)
    n_emb, n_feat = cache_plan.alpha_search(io, freq, PLAN_BYTES * s.n, HIDDEN, 64).select("n_emb", "n_feat").first()
    parts = [("emb", cache_plan.candidates(io, "io", n_emb)), ("feat", cache_plan.candidates(freq, "freq", n_feat))]
    a, b = (x.select(F.lit(kind).alias("kind"), F.col("slot").cast("long").alias("slot"), "node") for kind, x in parts)
    return a.unionByName(b)


# caches and gathers


def _neighbor_cache(s: Setting) -> DataFrame:
    s.settle()
    return caches.neighbor_cache(s.score(), ingest.degrees(s.nodes, s.edges), NEIGHBOR_BYTES * s.n, s.n)


@query
def neighbor_cache(spark, sf_dir):
    return _neighbor_cache(Setting(spark, sf_dir))


@query
def neighbor_cache_fill(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return caches.neighbor_cache_fill(settled(_neighbor_cache(s), "cache"), s.edges)


@query
def neighbor_cache_roundtrip(spark, sf_dir):
    """The cache as written, and the neighbours that its words name."""
    s, path = Setting(spark, sf_dir), _folder(spark)
    cache = settled(_neighbor_cache(s), "cache")
    store.save_neighbor_cache(cache, caches.neighbor_cache_fill(cache, s.edges), NEIGHBOR_BYTES * s.n, path)
    return store.cached_rows(*store.load_neighbor_cache(spark, path)[:2])


@query
def feature_gather_zerocopy(spark, sf_dir):
    """Hits by slot and misses by row, and both put together again, per access."""
    s = Setting(spark, sf_dir)
    access = s.access()
    known, chosen = s.features(), s.candidates()
    misses, hits, _ = gather.gather_parts(access, known, chosen)
    both = gather.merged(misses, hits, gather.gather(chosen, known).select("slot", "feat"))
    return both.select("batch", "idx", F.round(F.expr("aggregate(feat, CAST(0 AS DOUBLE), (a, x) -> a + x)"), 6).alias("total"))


@query
def feature_gather(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return exploded(gather.gather(s.batches(), s.features()), ["batch", "idx", "node"], "feat")


@query
def feature_gather_cached(spark, sf_dir):
    s = Setting(spark, sf_dir)
    access = s.access()
    found = gather.gather_cached(access, s.features(), s.candidates())
    return found.select("batch", "idx", "node", "hit", F.coalesce(F.col("slot").cast("long"), F.lit(-1)).alias("slot"), F.round(F.expr("aggregate(feat, CAST(0 AS DOUBLE), (a, x) -> a + x)"), 6).alias("total"))


@query
def feature_cache_table(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return caches.feature_cache_table(s.nodes, s.candidates()).select("node", F.col("state").cast("long").alias("state"), F.coalesce(F.col("slot").cast("long"), F.lit(-1)).alias("slot"))


@query
def embedding_table(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return caches.embedding_table(s.nodes, s.candidates()).select("node", F.col("state").cast("long").alias("state"), F.coalesce(F.col("slot").cast("long"), F.lit(-1)).alias("slot"))


@query
def feature_cache_hits(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return caches.feature_cache_hits(s.access().select("batch", "node"), s.candidates())


@query
def emb_cache_actions(spark, sf_dir):
    return Setting(spark, sf_dir).actions()


@query
def emb_pull_locf(spark, sf_dir):
    return caches.embedding_sources(Setting(spark, sf_dir).actions())


# model


def _states(s: Setting, ids: DataFrame) -> DataFrame:
    return gather.gather(ids, s.features()).select("batch", "node", F.col("feat").alias("x"))


@query
def sage_mean(spark, sf_dir):
    s = Setting(spark, sf_dir)
    levels, rows = s.khop(1)
    return exploded(sage.mean_aggregate(rows[0], _states(s, levels[1])), ["batch", "node"], "mean")


def _first_layer(s: Setting) -> DataFrame:
    levels, rows = s.khop(1)
    left, right = sage.weights(CLASSES, 64, 1), sage.weights(CLASSES, 64, 2)
    return sage.sage_layer(levels[0], rows[0], _states(s, levels[1]), left, sage.weights(CLASSES, 1, 3)[:, 0], right, last=True)


@query
def sage_layer(spark, sf_dir):
    return exploded(_first_layer(Setting(spark, sf_dir)), ["batch", "node"], "x")


@query
def sage_forward(spark, sf_dir):
    """Two layers: the first over all one-hop nodes, cut off at zero; the second over the seeds."""
    s = Setting(spark, sf_dir)
    levels, rows = s.khop(2)
    bias = sage.weights(HIDDEN, 1, 3)[:, 0]
    inner = sage.sage_layer(levels[1], rows[1], _states(s, levels[2]), sage.weights(HIDDEN, 64, 1), bias, sage.weights(HIDDEN, 64, 2))
    out = sage.sage_layer(levels[0], rows[0], settled(inner, "hidden"), sage.weights(CLASSES, HIDDEN, 4), sage.weights(CLASSES, 1, 6)[:, 0], sage.weights(CLASSES, HIDDEN, 5), last=True)
    return exploded(out.withColumn("x", sage.log_softmax(F.col("x"))), ["batch", "node"], "x")


@query
def emb_pull_values(spark, sf_dir):
    """What each pull reads: the mean over the node's row in the batch that pushed it."""
    s = Setting(spark, sf_dir).settle()
    levels, rows = sampling.sample_khop(s.batches(), s.edges, SIZES[:2], SEED)
    actions = settled(caches.embedding_actions(levels[1].join(s.candidates().select("node"), "node", "left_semi").select("batch", "node"), STALENESS), "actions")
    vectors = sage.mean_aggregate(rows[1], _states(s, levels[2])).withColumnRenamed("mean", "vec")
    pushed = vectors.join(actions.where("action = 'push'").select("batch", "node"), ["batch", "node"])
    return exploded(caches.pulled_embeddings(actions, pushed), ["batch", "node"], "vec")


@query
def relu(spark, sf_dir):
    return exploded(_first_layer(Setting(spark, sf_dir)).withColumn("x", sage.relu("x")), ["batch", "node"], "x")


def _predicted(s: Setting) -> DataFrame:
    return _first_layer(s).select("batch", "node", sage.log_softmax(F.col("x")).alias("logp"))


@query
def log_softmax(spark, sf_dir):
    return exploded(_predicted(Setting(spark, sf_dir)), ["batch", "node"], "logp")


@query
def nll_loss(spark, sf_dir):
    s = Setting(spark, sf_dir)
    return sage.nll_loss(_predicted(s), s.features().select("node", "label")).select("batch", F.round("loss", 6).alias("loss"))


@query
def accuracy(spark, sf_dir):
    s = Setting(spark, sf_dir)
    found = sage.accuracy(_predicted(s), s.features().select("node", "label"))
    return found.select("correct", "total", F.round("accuracy", 6).alias("accuracy"))
