"""Layered neighbour sampling for mini-batches.

A layer's targets are ``batch, node, idx``; a sampled row is ``batch, layer,
src (target), dst (neighbour), idx (the target's), r (rank in its row)``. All
batches are sampled in one plan. The choice of a row's neighbours is a rank by
hash, taken within the stored row, before anything is shuffled; the rows of
hubs are stored in pieces, whose best are ranked once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.keys import draw, order_key
from graphspark.session import settled

ROW = ["batch", "layer", "src", "dst", "idx", "r"]
#: Neighbours that a piece of a stored row holds, on average, at most.
PIECE = 4096


def stored_rows(edges: DataFrame) -> DataFrame:
    """``src, nbrs, pieces``: each node's neighbours in one array, those of hubs in
    several, dealt by hash."""
    hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > PIECE).select(F.col("src").alias("hub"), F.ceil(F.col("deg") / PIECE).cast("int").alias("n"))
    dealt = edges.join(settled(hubs, "hubs"), F.col("src") == F.col("hub"), "left").withColumn("pieces", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("dst"), F.col("pieces")))
    return dealt.groupBy("src", "piece", "pieces").agg(F.collect_list("dst").alias("nbrs")).select("src", "nbrs", "pieces")


def sample_layer(targets: DataFrame, edges: DataFrame, k: int, seed: int, layer: int, replace: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Rows of all targets: ``k`` distinct neighbours of each, all if it has
    fewer or if ``k`` is negative; with ``replace``, ``k`` independent draws
    (``r`` is the draw). A target without neighbours has no row. ``stored``:
    ``stored_rows(edges)``, if they are at hand."""
    if replace and k >= 0:
        order = Window.partitionBy("src").orderBy("dst")
        placed = edges.withColumn("at", F.row_number().over(order) - 1)
        degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
        draws = targets.join(degree, "node").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(k)))) if k else targets.join(degree, "node").withColumn("r", F.lit(0)).where("false")
        draws = draws.withColumn("at", draw(order_key(seed, "batch", layer, "node", "r"), F.col("deg")))
        rows = draws.join(placed, (draws["node"] == placed["src"]) & (draws["at"] == placed["at"]))
        return rows.select("batch", F.lit(layer).alias("layer"), "src", "dst", "idx", F.col("r").cast("int").alias("r"))
    stored = stored_rows(edges) if stored is None else stored
    keyed = F.sort_array(F.transform("nbrs", lambda d: F.struct(order_key(seed, "batch", layer, "src", d).alias("key"), d.alias("dst"))))
    best = keyed if k < 0 else F.slice(keyed, 1, k)

    def chosen(rows: DataFrame) -> DataFrame:
        found = targets.select("batch", "node", "idx").join(rows, F.col("node") == F.col("src"))
        return found.select("batch", F.lit(layer).alias("layer"), "src", "idx", F.posexplode(best).alias("at", "x")).select("batch", "layer", "src", "x.dst", "x.key", "idx", (F.col("at") + 1).alias("r"))

    order = Window.partitionBy("batch", "src").orderBy("key", "dst")
    hubs = chosen(stored.where("pieces > 1")).withColumn("r", F.row_number().over(order))
    hubs = hubs if k < 0 else hubs.where(F.col("r") <= k)
    return chosen(stored.where("pieces = 1")).select(*ROW).union(hubs.select(*ROW))


def discoveries(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that meet a node for the first time: the least (idx, r) of each
    neighbour that isn't a target of its batch."""
    known = targets.select("batch", F.col("node").alias("dst"))
    new = rows.join(known, ["batch", "dst"], "left_anti")
    return new.groupBy("batch", "dst").agg(F.min(F.struct("idx", "r", "src", "layer")).alias("f")).select("batch", "f.layer", "f.src", "dst", "f.idx", "f.r")


def next_targets(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """The targets and, numbered after them in order of discovery, the nodes that
    the rows bring in."""
    first = discoveries(targets, rows)
    sizes = targets.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("batch").orderBy("idx", "r")
    found = first.withColumn("k", F.row_number().over(order) - 1).join(sizes, "batch").select("batch", F.col("dst").alias("node"), (F.col("n") + F.col("k")).cast("long").alias("idx"))
    return targets.select("batch", "node", "idx").unionByName(found)


def blocks(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with both ends as numbers of the batch: ``batch, layer, dst_node,
    src_node, dst_local, src_local``; messages flow from the neighbour (src) to the target (dst)."""
    names = targets.select("batch", F.col("node").alias("dst"), F.col("idx").alias("src_local"))
    return rows.join(names, ["batch", "dst"]).select("batch", "layer", F.col("src").alias("dst_node"), F.col("dst").alias("src_node"), F.col("idx").alias("dst_local"), "src_local")


def sample_khop(targets: DataFrame, edges: DataFrame, sizes: list[int], seed: int, reuse: bool = False, replace: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """(targets of layers 0..L, rows of layers 0..L-1).

    The targets of a layer are all nodes so far. With ``reuse`` a target that
    the layer before had already keeps its row; else all rows are drawn again.
    """
    levels, rows = [settled(targets.select("batch", "node", "idx"), "targets")], []
    stored = settled(stored_rows(edges), "stored")
    for layer, k in enumerate(sizes):
        if reuse and layer:
            new = levels[layer].join(levels[layer - 1].select("batch", "node"), ["batch", "node"], "left_anti")
            made = rows[-1].unionByName(sample_layer(new, edges, k, seed, layer, replace, stored))
        else:
            made = sample_layer(levels[layer], edges, k, seed, layer, replace, stored)
        rows.append(settled(made, "rows"))
        levels.append(settled(next_targets(levels[layer], rows[-1]), "targets"))
    return levels, rows


def sample_pruned(targets: DataFrame, edges: DataFrame, candidates: DataFrame, sizes: list[int], staleness: int, seed: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Sampling with row reuse in which historical embeddings replace subtrees.

    Returns the targets, the rows and the actions (``batch, node, action``).
    Layer 0 is sampled for all batches; its one-hop nodes among ``candidates``
    give the actions. From layer 1 on, a node that this batch pulls has no row,
    unless a row of a layer from 1 on has named it: then it is needed lower
    down and sampled afresh.
    """
    from graphspark.operators.caches import embedding_actions

    levels = [settled(targets.select("batch", "node", "idx"), "targets")]
    stored = settled(stored_rows(edges), "stored")
    rows = [settled(sample_layer(levels[0], edges, sizes[0], seed, 0, stored=stored), "rows")]
    levels.append(settled(next_targets(levels[0], rows[0]), "targets"))
    actions = settled(embedding_actions(levels[1].join(candidates.select("node"), "node", "left_semi").select("batch", "node"), staleness), "actions")
    pulled = actions.where("action = 'pull'").select("batch", "node")
    for layer in range(1, len(sizes)):
        named = rows[-1].where("layer >= 1").select("batch", F.col("dst").alias("node"))
        done = rows[-1].select("batch", F.col("src").alias("node"))
        again = pulled.join(named, ["batch", "node"], "left_semi")
        if layer > 1:
            again = again.join(done, ["batch", "node"], "left_anti")
        kept = rows[-1].join(pulled.select("batch", F.col("node").alias("src")), ["batch", "src"], "left_anti").select(*ROW)
        new = levels[layer].join(levels[layer - 1].select("batch", "node"), ["batch", "node"], "left_anti").join(pulled, ["batch", "node"], "left_anti")
        fresh = new.select("batch", "node", "idx").unionByName(levels[layer].join(again, ["batch", "node"], "left_semi").select("batch", "node", "idx"))
        rows.append(settled(kept.unionByName(sample_layer(fresh, edges, sizes[layer], seed, layer, stored=stored)), "rows"))
        levels.append(settled(next_targets(levels[layer], rows[-1]), "targets"))
    return levels, rows, actions


def tiers(rows: DataFrame, assignment: DataFrame, groups: DataFrame, batches: DataFrame, cached: DataFrame) -> DataFrame:
    """Adds ``tier`` to rows: where a target's neighbours are read: ``cache``,
    ``super_batch`` (its part is loaded) or ``graph``. ``batches``: ``batch,
    super_batch``; ``cached``: ``node``."""
    home = assignment.join(F.broadcast(groups), "part").select(F.col("node").alias("src"), F.col("super_batch").alias("home"))
    out = rows.join(home, "src", "left").join(F.broadcast(batches), "batch", "left").join(cached.select(F.col("node").alias("src"), F.lit(True).alias("hit")), "src", "left")
    tier = F.when(F.col("hit"), "cache").when(F.col("home") == F.col("super_batch"), "super_batch").otherwise("graph")
    return out.select(*ROW, tier.alias("tier"))
