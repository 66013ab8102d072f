"""Programs over a graph's folder: prepare, partition, cache, profile, train.

    python -m graphspark.programs prepare --graph G --edges E --num-nodes N ...
    python -m graphspark.programs partition --graph G --parts 10000 --first-level 100

Each reads what the ones before have written below ``--graph`` and adds tables
of its own: ``assignment``, ``parts``, ``score``, ``neighbor_cache``, ``plan``,
``candidates_emb``, ``candidates_feat``. Paths are any that Spark reads.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators import batching, caches, cuts, ingest, partition, profiling, sampling
from graphspark.operators.training import train as train_model
from graphspark.plans import cache_plan
from graphspark.session import drop_settled, settled
from graphspark.sources import store
from graphspark.sources.store import Graph


def _write(df: DataFrame, args: argparse.Namespace, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{args.graph}/{name}")


def _read(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame:
    return spark.read.parquet(f"{args.graph}/{name}")


def prepare(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A folder of tables from edges, raw features and labels, and splits: node
    lists by split, or masks in a node table (``--masked``), which then has the labels."""
    if args.masked:
        labels, splits = store.read_masked(spark, args.masked)
        features = store.load_float32(spark, args.features, args.num_features)
        graph = Graph.from_edges(spark.read.parquet(args.edges).select("src", "dst"), args.num_nodes, features, labels, splits)
    else:
        graph = store.read_edge_lists(spark, args.edges, args.num_nodes, args.features, args.num_features, args.labels, dict(x.split("=", 1) for x in args.split))
    graph.save(args.graph)
    return _read(spark, args, "graph_meta").first().asDict()


def partition_graph(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The assignment, a folder per part and the cross edges of each node; returns the cut."""
    graph = Graph.load(spark, args.graph)
    train = graph.splits.where("split = 'train'").select("node")
    options = {"imbalance": args.imbalance_ratio, "gamma": args.gamma, "rounds": args.num_rounds, "patience": args.patience, "membership": args.membership}
    if args.first_level:
        found = partition.fennel_two_level(graph.nodes, graph.edges, train, args.parts, args.first_level, **options)
    else:
        found = partition.fennel(graph.nodes, graph.edges, train, args.parts, **options)
    _write(found, args, "assignment")
    assignment = _read(spark, args, "assignment")
    store.save_partitioned(graph.edges, assignment, graph.splits, f"{args.graph}/parts")
    _write(cuts.cross_edge_score(graph.nodes, graph.edges, assignment), args, "score")
    return cuts.edge_cut(graph.edges, assignment).first().asDict()


def cache(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The neighbour cache of ``--neigh-cache-size`` bytes; returns its number of nodes."""
    graph = Graph.load(spark, args.graph)
    n = graph.nodes.count()
    found = settled(caches.neighbor_cache(_read(spark, args, "score"), graph.degrees(), int(args.neigh_cache_size), n), "cache")
    store.save_neighbor_cache(found, caches.neighbor_cache_fill(found, graph.edges), int(args.neigh_cache_size), f"{args.graph}/neighbor_cache")
    return {"nodes": found.count()}


def _sampled(spark: SparkSession, args: argparse.Namespace, graph: Graph, epoch: int = 0):
    seeds = batching.mini_batches(_read(spark, args, "assignment").select("node", "part"), graph.splits, args.batch_size, args.partition_batch, args.seed, epoch)
    return settled(seeds, "seeds"), [int(x) for x in args.sizes.split(",")]


def profile(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Access counts and subtree sizes over one epoch, and the split of the
    budget that follows from them; returns the plan."""
    graph = Graph.load(spark, args.graph)
    seeds, sizes = _sampled(spark, args, graph)
    levels, rows = sampling.sample_khop(seeds, graph.edges, sizes, args.seed)
    io = settled(profiling.node_io(graph.nodes, profiling.neigh_size_before(levels, rows), profiling.neigh_size_after(levels, rows), args.beta), "io")
    freq = graph.nodes.join(profiling.access_freq(levels[-1]), "node", "left").select("node", F.coalesce("freq", F.lit(0)).alias("freq"))
    freq = settled(freq, "freq")
    width = _read(spark, args, "graph_meta").first().num_features
    _write(cache_plan.alpha_search(io, freq, int(args.feature_cache_size), args.num_hiddens, width), args, "plan")
    plan = _read(spark, args, "plan").first()
    _write(cache_plan.candidates(io, "io", plan.n_emb), args, "candidates_emb")
    _write(cache_plan.candidates(freq, "freq", plan.n_feat), args, "candidates_feat")
    return plan.asDict()


def train(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Trains with historical embeddings of the plan's candidates; returns each
    epoch's loss and accuracy."""
    graph = Graph.load(spark, args.graph)
    seeds, sizes = _sampled(spark, args, graph)
    levels, rows, actions = sampling.sample_pruned(seeds, graph.edges, _read(spark, args, "candidates_emb"), sizes, args.staleness_threshold, args.seed)
    classes = int(graph.labels.agg(F.max("label")).first()[0]) + 1
    _, curve = train_model(levels, rows, graph.features, graph.labels, args.num_hiddens, classes, epochs=args.num_epochs, seed=args.seed, actions=actions)
    return {"curve": curve}


PROGRAMS = {"prepare": prepare, "partition": partition_graph, "cache": cache, "profile": profile, "train": train}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="graphspark", description="Programs over a graph's folder.")
    programs = made.add_subparsers(dest="program", required=True)
    own = {name: programs.add_parser(name) for name in PROGRAMS}
    for x in own.values():
        x.add_argument("--graph", required=True)
    x = own["prepare"]
    x.add_argument("--edges", required=True)
    x.add_argument("--num-nodes", type=int, required=True)
    x.add_argument("--features", required=True)
    x.add_argument("--num-features", type=int, required=True)
    x.add_argument("--labels")
    x.add_argument("--split", action="append", default=[], metavar="NAME=PATH")
    x.add_argument("--masked")
    x = own["partition"]
    x.add_argument("--parts", type=int, default=10000)
    x.add_argument("--first-level", type=int, default=100, help="0: one level")
    x.add_argument("--imbalance-ratio", type=float, default=1.1)
    x.add_argument("--gamma", type=float, default=2.0)
    x.add_argument("--num-rounds", type=int, default=1)
    x.add_argument("--patience", type=int, default=3)
    x.add_argument("--membership", choices=("exact", "bloom"), default="exact")
    own["cache"].add_argument("--neigh-cache-size", type=float, default=1e10)
    for x in (own["profile"], own["train"]):
        x.add_argument("--batch-size", type=int, default=1000)
        x.add_argument("--num-hiddens", type=int, default=256)
        x.add_argument("--sizes", default="10,10,10")
        x.add_argument("--partition-batch", type=int, default=20)
        x.add_argument("--seed", type=int, default=0)
    own["profile"].add_argument("--feature-cache-size", type=float, default=3e10)
    own["profile"].add_argument("--beta", type=float, default=1.0)
    own["train"].add_argument("--staleness-threshold", type=int, default=100)
    own["train"].add_argument("--num-epochs", type=int, default=1)
    return made


def run(spark: SparkSession, arguments: list[str]) -> dict:
    args = parser().parse_args(arguments)
    try:
        return PROGRAMS[args.program](spark, args)
    finally:
        drop_settled(spark)


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.appName("graphspark").getOrCreate(), sys.argv[1:]))
