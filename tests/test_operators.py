"""Operators on graphs that fit on a page, and invariants on random ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.functions.bloom import BloomFilter, bloom_size
from graphspark.operators import batching, caches, cuts, gather, ingest, partition, profiling, sage, sampling, selection
from graphspark.operators.training import Block, Sage, train
from graphspark.plans import cache_plan
from graphspark.session import settled


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def both(pairs):
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return both((rng.randrange(n), rng.randrange(n)) for _ in range(m))


# ingest


def test_no_edges(spark):
    none = edges(spark, [])
    assert rows(ingest.degrees(nodes(spark, 3), none)) == [(0, 0), (1, 0), (2, 0)]
    assert rows(ingest.csr_indptr(nodes(spark, 3), none)) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert rows(ingest.csr_indices(nodes(spark, 3), none)) == []
    cut = cuts.edge_cut(none, spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node long, part int")).first()
    assert (cut.total_edges, cut.edge_cut, cut.ratio) == (0, 0, None)


def test_loops_repeats_and_reversed_edges(spark):
    e = ingest.undirected(edges(spark, [(0, 0), (0, 1), (0, 1), (1, 0), (2, 1)]))
    assert rows(e) == [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(ingest.csr_indices(nodes(spark, 4), e)) == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 2), (4, 2, 1)]
    assert rows(ingest.csr_indptr(nodes(spark, 4), e)) == [(0, 0), (1, 2), (2, 4), (3, 5), (4, 5)]
    assert rows(ingest.transposed(edges(spark, [(1, 2)]))) == [(2, 1)]
    assert ingest.adjacency(e).where("node = 1").first().nbrs == [0, 2]


def test_running_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ingest, "RANGE", 3)
    e = random_graph(40, 120, 1)
    got = dict(rows(ingest.csr_indptr(nodes(spark, 40), edges(spark, e))))
    at = 0
    for k in range(40):
        assert got[k] == at
        at += sum(a == k for a, _ in e)
    assert got[40] == at == len(e)


def test_splits(spark):
    splits = spark.createDataFrame([(0, "train"), (1, "valid"), (2, "test")], "node long, split string")
    masks = selection.split_masks(nodes(spark, 4), splits)
    assert rows(masks) == [(0, True, False, False), (1, False, True, False), (2, False, False, True), (3, False, False, False)]
    assert rows(selection.splits_from_masks(masks)) == rows(splits)
    ids = spark.createDataFrame([(0, 2), (1, 2), (2, 9)], "pos int, node long")
    assert sorted(tuple(x) for x in selection.index_select(ids, splits).select("pos", "split").collect()) == [(0, "test"), (1, "test"), (2, None)]


# partitions


def plain_fennel(n, e, train, parts, imbalance=1.1, gamma=2.0, rounds=1, patience=3, total_train=None):
    """The rule, written plainly."""
    near = [[b for a, b in e if a == k] for k in range(n)]
    alpha = parts ** (gamma - 1) * len(e) / n**gamma
    cap, tcap = n / parts * imbalance, (len(train) if total_train is None else total_train) / parts * imbalance
    place, size, tsize = [None] * n, [0] * parts, [0] * parts

    def best(k, seen):
        top, choice = -math.inf, None
        for p in range(parts):
            if size[p] + 1 > int(cap) or (k in train and tsize[p] + 1 > int(tcap)):
                continue
            s = sum(b >= 0 and seen[b] == p for b in near[k]) - alpha * gamma * size[p] ** (gamma - 1) - tsize[p] ** 0.5
            if s > top:
                top, choice = s, p
        assert choice is not None
        return choice

    for k in range(n):
        place[k] = best(k, place)
        size[place[k]] += 1
        tsize[place[k]] += k in train
    score = lambda: sum(place[a] == place[b] for a, b in e)
    top = score()
    for _ in range(1, rounds):
        seen = list(place)
        for k in range(n):
            p = best(k, seen)
            size[place[k]] -= 1
            tsize[place[k]] -= k in train
            size[p] += 1
            tsize[p] += k in train
            place[k] = p
        now = score()
        if now > top:
            top = now
        else:
            patience -= 1
            if patience <= 0:
                break
    return place


def ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "node long")


@pytest.mark.parametrize("rounds", [1, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_fennel_follows_the_rule(spark, rounds, seed):
    n, e = 48, random_graph(48, 150, seed)
    train_ids = {k for k in range(n) if k % 3 == 0}
    found = partition.fennel(nodes(spark, n), edges(spark, e), ids(spark, train_ids), 4, imbalance=1.4, rounds=rounds)
    assert [p for _, p in rows(found)] == plain_fennel(n, e, train_ids, 4, 1.4, rounds=rounds)


def test_two_cliques_and_a_bridge(spark):
    clique = lambda a: [(a + i, a + j) for i in range(4) for j in range(4) if i != j]
    e = both(clique(0) + clique(4) + [(3, 4)])
    found = partition.fennel(nodes(spark, 8), edges(spark, e), ids(spark, []), 2)
    place = [p for _, p in rows(found)]
    assert place == plain_fennel(8, e, set(), 2)
    score = dict(rows(cuts.cross_edge_score(nodes(spark, 8), edges(spark, e), found)))
    assert score == {k: sum(place[b] != place[k] for a, b in e if a == k) for k in range(8)}
    cut = cuts.edge_cut(edges(spark, e), found).first()
    assert cut.edge_cut == sum(score.values()) and cut.ratio == math.floor(100 * cut.edge_cut / len(e)) / 100


def test_infeasible_is_an_error(spark):
    with pytest.raises(Exception, match="no part has room"):
        partition.fennel(nodes(spark, 6), edges(spark, both([(0, 1)])), ids(spark, []), 4).collect()
    with pytest.raises(Exception, match="no part has room"):
        partition.fennel(nodes(spark, 6), edges(spark, []), ids(spark, range(6)), 4, imbalance=1.2).collect()
    with pytest.raises(ValueError):
        partition.fennel(nodes(spark, 6), edges(spark, []), ids(spark, []), 2, membership="other")


def test_two_levels(spark):
    n, e = 60, random_graph(60, 200, 5)
    train_ids = {k for k in range(n) if k % 2}
    found = rows(partition.fennel_two_level(nodes(spark, n), edges(spark, e), ids(spark, train_ids), 6, 2, imbalance=1.5))
    first = plain_fennel(n, e, train_ids, 2, 1.5)
    assert [(k, p) for k, p, _ in found] == list(enumerate(first))
    for p in (0, 1):
        members = [k for k in range(n) if first[k] == p]
        local = {k: j for j, k in enumerate(members)}
        # neighbours elsewhere count as entries, not as members
        own = [(local[a], local.get(b, -1)) for a, b in e if a in local]
        want = plain_fennel(len(members), own, {local[k] for k in train_ids if k in local}, 3, 1.5, total_train=len(train_ids))
        assert any(b < 0 for _, b in own)
        assert [x - 3 * p for _, q, x in found if q == p] == want
        sizes = np.bincount([x - 3 * p for _, q, x in found if q == p], minlength=3)
        assert sizes.max() <= int(len(members) / 3 * 1.5)


def test_bloom_membership_places_all(spark):
    n, e = 60, random_graph(60, 200, 6)
    found = rows(partition.fennel(nodes(spark, n), edges(spark, e), ids(spark, []), 4, membership="bloom", bloom_rate=1e-6))
    assert [p for _, p in found] == plain_fennel(n, e, set(), 4)
    assert [k for k, _ in found] == list(range(n))


def plain_bloom_fennel(n, e, parts, imbalance, rate):
    """The rule with a filter of each part, asked one by one."""
    filters = [BloomFilter(-(-n // parts), rate) for _ in range(parts)]
    alpha, size, place = parts * len(e) / n**2, [0] * parts, []
    for k in range(n):
        near = np.array([b for a, b in e if a == k], np.int64)
        scores = [(int(f.contains(near).sum()) if len(near) else 0) - alpha * 2 * m if m + 1 <= int(n / parts * imbalance) else -math.inf for f, m in zip(filters, size)]
        place.append(int(np.argmax(scores)))
        filters[place[-1]].insert(k)
        size[place[-1]] += 1
    return place


def test_bloom_membership_at_the_usual_rate(spark):
    n, e = 120, random_graph(120, 500, 8)
    for parts in (4, 70):
        found = rows(partition.fennel(nodes(spark, n), edges(spark, e), ids(spark, []), parts, membership="bloom", imbalance=1.6))
        assert [p for _, p in found] == plain_bloom_fennel(n, e, parts, 1.6, 0.1)
    assert plain_bloom_fennel(n, e, 4, 1.6, 0.1) != plain_fennel(n, e, set(), 4, 1.6)


def test_fennel_with_rows_in_many_pieces(spark):
    n, e = 40, random_graph(40, 300, 9)
    train_ids = {k for k in range(n) if k % 3}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = partition.fennel(nodes(spark, n), edges(spark, [*e, (3, 40), (-1, 2)]), ids(spark, train_ids), 4, imbalance=1.5)
        assert [p for _, p in rows(found)] == plain_fennel(n, e, train_ids, 4, 1.5)
        found = partition.fennel(nodes(spark, n), edges(spark, [*e, (3, 40), (-1, 2)]), ids(spark, []), 4, imbalance=1.5, membership="bloom")
        assert [p for _, p in rows(found)] == plain_bloom_fennel(n, e, 4, 1.5, 0.1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fennel_sends_no_edges_by_way_of_the_driver(spark, tmp_path):
    """Edges made by pairing look as small to Spark as the file that they are made from."""
    e = random_graph(48, 150, 1)
    spark.createDataFrame([(a, [y for x, y in e if x == a]) for a in range(48)], "src long, near array<long>").write.parquet(f"{tmp_path}/near")
    pairs = spark.read.parquet(f"{tmp_path}/near").select("src", F.explode("near").alias("dst"))
    every, flags = ids(spark, range(48)), ids(spark, range(0, 48, 3))

    def sent(run) -> bool:
        state, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()

        def plans() -> dict[int, str]:
            bus.waitUntilEmpty()
            found = state.executionsList()
            return {x.executionId(): x.physicalPlanDescription() for x in (found.apply(k) for k in range(found.size()))}

        before = plans()
        run().collect()
        return any("BroadcastExchange" in plan for k, plan in plans().items() if k not in before)

    assert sent(lambda: pairs.join(every.withColumnRenamed("node", "src"), "src"))
    assert not sent(lambda: partition.fennel(every, pairs, flags, 4, imbalance=1.6))
    assert not sent(lambda: partition.fennel(every, pairs, flags, 4, imbalance=1.6, membership="bloom"))
    assert not sent(lambda: partition.fennel_two_level(every, pairs, flags, 6, 2, imbalance=1.6))


def test_first_level_numbers(spark):
    e = both([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (1, 4)])
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "node long, part int")
    mapping = rows(cuts.first_level_mapping(edges(spark, e), parts))
    assert mapping == [(0, 0, 0), (0, 1, 1), (0, 2, 4), (0, 3, 2), (1, 0, 2), (1, 1, 3), (1, 2, 4), (1, 3, 1), (1, 4, 0)]
    back = {(p, l): k for p, l, k in mapping}
    again = sorted((back[p, a], back[p, b]) for p, a, b in rows(cuts.first_level_relabel(edges(spark, e), parts)))
    assert again == e


# sampling


def batches(spark, n, size):
    return spark.createDataFrame([(k // size, k, k % size) for k in range(n)], "batch long, node long, idx long")


def test_star_and_fan_out(spark):
    e = edges(spark, both([(0, k) for k in range(1, 31)]))
    t = batches(spark, 31, 31)
    got = sampling.sample_layer(t, e, 5, 1, 0).collect()
    assert sum(x.src == 0 for x in got) == 5 and len({x.dst for x in got if x.src == 0}) == 5
    assert sum(x.src != 0 for x in got) == 30
    assert sampling.sample_layer(t, e, -1, 1, 0).count() == 60
    drawn = sampling.sample_layer(t, e, 50, 1, 0, replace=True).collect()
    assert sum(x.src == 0 for x in drawn) == 50 and {x.dst for x in drawn if x.src == 5} == {0}
    assert sampling.sample_layer(t, edges(spark, []), 3, 1, 0).collect() == []


def test_hubs_in_pieces_are_sampled_alike(spark, monkeypatch):
    e = edges(spark, both([(0, k) for k in range(1, 120)] + [(1, k) for k in range(40, 90)] + [(200, 201)]))
    t = batches(spark, 202, 60)
    whole = {k: rows(sampling.sample_layer(t, e, k, 3, 1)) for k in (-1, 0, 4, 70)}
    monkeypatch.setattr(sampling, "PIECE", 8)
    assert sampling.stored_rows(e).where("pieces > 1").count() > 10
    for k, want in whole.items():
        assert rows(sampling.sample_layer(t, e, k, 3, 1)) == want


def test_layers_number_and_reuse(spark):
    n, e = 80, random_graph(80, 300, 9)
    for reuse in (False, True):
        levels, made = sampling.sample_khop(batches(spark, 40, 10), edges(spark, e), [3, 2, 2], 4, reuse=reuse)
        for k in range(3):
            now, after, drawn = (x.collect() for x in (levels[k], levels[k + 1], made[k]))
            for batch in {x.batch for x in now}:
                a = {x.node: x.idx for x in now if x.batch == batch}
                b = {x.node: x.idx for x in after if x.batch == batch}
                own = [x for x in drawn if x.batch == batch]
                assert a.items() <= b.items() and sorted(b.values()) == list(range(len(b)))
                assert set(b) == set(a) | {x.dst for x in own} and all((x.src, x.dst) in set(e) for x in own)
            first = sampling.discoveries(levels[k], made[k]).collect()
            assert len({(x.batch, x.dst) for x in first}) == len(first) == len(after) - len(now)
            if reuse and k:
                before = {(x.batch, x.src, x.dst) for x in made[k - 1].collect()}
                assert before <= {(x.batch, x.src, x.dst) for x in drawn}


def test_the_draw_does_not_depend_on_partitions(spark):
    e = edges(spark, random_graph(50, 200, 3))
    one = rows(sampling.sample_layer(batches(spark, 50, 10).coalesce(1), e.coalesce(1), 3, 5, 0))
    many = rows(sampling.sample_layer(batches(spark, 50, 10).repartition(7), e.repartition(9), 3, 5, 0))
    assert one == many


def test_the_draw_is_uniform(spark):
    e = edges(spark, [(0, k) for k in range(1, 21)])
    t = spark.createDataFrame([(b, 0, 0) for b in range(3000)], "batch long, node long, idx long")
    counts = np.bincount([x.dst for x in sampling.sample_layer(t, e, 5, 2, 0).collect()], minlength=21)[1:]
    assert ((counts - 750) ** 2 / 750).sum() < 50  # 19 degrees of freedom


def test_batches_cover_the_split(spark):
    parts = nodes(spark, 95).selectExpr("node", "CAST(node % 10 AS INT) AS part")
    splits = nodes(spark, 95).selectExpr("node", "CASE WHEN node < 70 THEN 'train' ELSE 'test' END AS split")
    got = batching.mini_batches(parts, splits, 8, 3, 1).collect()
    assert sorted(x.node for x in got) == list(range(70))
    groups = {x.part: x.super_batch for x in batching.super_batches(parts, 3, 1).collect()}
    for batch in {x.batch for x in got}:
        own = [x for x in got if x.batch == batch]
        assert sorted(x.idx for x in own) == list(range(len(own))) and len(own) <= 8
        assert len({groups[x.node % 10] for x in own}) == 1
    assert sorted({x.batch for x in got}) == list(range(len({x.batch for x in got})))


def test_pruning_rules(spark):
    n, e = 60, random_graph(60, 200, 13)
    candidates = nodes(spark, 60).where("node % 2 = 0")
    levels, made, actions = sampling.sample_pruned(batches(spark, 50, 10), edges(spark, e), candidates, [3, 2, 2], 3, 4)
    pulled = {(x.batch, x.node) for x in actions.collect() if x.action == "pull"}
    assert pulled
    assert not pulled & {(x.batch, x.src) for x in made[1].collect()}
    named = {(x.batch, x.dst) for x in made[1].collect() if x.layer >= 1}
    degree = {a for a, _ in e}
    expanded = {(x.batch, x.src) for x in made[2].collect()}
    assert pulled & expanded == {x for x in pulled & named if x[1] in degree}


# profiles, plans and caches


def test_subtrees_of_a_path(spark):
    e = edges(spark, both([(k, k + 1) for k in range(5)]))
    seeds = spark.createDataFrame([(0, 0, 0)], "batch long, node long, idx long")
    levels, made = sampling.sample_khop(seeds, e, [-1, -1, -1], 1)
    assert dict(rows(profiling.neigh_size_before(levels, made))) == {0: 1 * (2 + 1), 1: (1 + 1) + (2 + 1)}
    assert dict(rows(profiling.access_freq(levels[-1]))) == {0: 1, 1: 1, 2: 1, 3: 1}
    one, drawn = sampling.sample_khop(seeds, e, [-1], 1)
    assert dict(rows(profiling.neigh_size_before(one, drawn))) == {0: 1, 1: 1}


def test_actions_in_order(spark):
    onehop = spark.createDataFrame([(b, 1) for b in range(5)] + [(0, 2), (4, 2), (1, 3), (3, 3)], "batch long, node long")
    got = {(x.node, x.batch): x.action for x in caches.embedding_actions(onehop, 3).collect()}
    assert [got[1, b] for b in range(5)] == ["push", "pull", "pull", "push", "pull"]
    assert (got[2, 0], got[2, 4], got[3, 1], got[3, 3]) == ("push", "push", "push", "pull")
    sources = rows(caches.embedding_sources(caches.embedding_actions(onehop, 3)))
    assert sources == [(1, 1, 0), (2, 1, 0), (3, 3, 1), (4, 1, 3)]
    pushed = spark.createDataFrame([(0, 1, [0.5]), (3, 1, [0.7]), (1, 3, [0.9])], "batch long, node long, vec array<double>")
    assert {(x.batch, x.node): x.vec[0] for x in caches.pulled_embeddings(caches.embedding_actions(onehop, 3), pushed).collect()} == {(1, 1): 0.5, (2, 1): 0.5, (4, 1): 0.7, (3, 3): 0.9}


def test_neighbor_cache_prefix(spark):
    e = edges(spark, both([(0, k) for k in range(1, 5)]))
    score = spark.createDataFrame([(k, 1) for k in range(5)], "node long, cross_edges long")
    deg = ingest.degrees(nodes(spark, 5), e)
    assert rows(caches.neighbor_cache(score, deg, 8 * 5 + 8 * 8, 5)) == [(0, 0), (1, 5)]
    cache = caches.neighbor_cache(score, deg, 8 * 5 + 8 * 9, 5)
    assert rows(cache) == [(0, 0), (1, 5), (2, 7)]
    assert rows(caches.neighbor_cache_fill(cache, e)) == [(0, 4), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 0), (7, 1), (8, 0)]
    assert rows(caches.neighbor_cache(score, deg, 8 * 5, 5)) == []
    with pytest.raises(ValueError):
        caches.neighbor_capacity(8, 5)
    assert caches.feature_capacity(4 * 10 + 4 * 3 * 7, 10, 3) == 7
    with pytest.raises(ValueError):
        caches.feature_capacity(1e12, 10, 1)


def test_feature_cache_and_gather(spark):
    access = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1)], "batch long, node long, idx long")
    slots = spark.createDataFrame([(1, 0), (3, 1)], "node long, slot long")
    assert rows(caches.feature_cache_hits(access, slots)) == [(0, 2, 0), (1, 2, 1), (2, 2, 1)]
    feats = spark.createDataFrame([(k, [float(k)]) for k in range(5)], "node long, feat array<float>")
    misses, hits, counts = gather.gather_parts(access, feats, slots)
    assert rows(counts) == [(0, 0), (1, 1), (2, 1)]
    whole = gather.merged(misses, hits, spark.createDataFrame([(0, [1.0]), (1, [3.0])], "slot long, feat array<float>"))
    assert sorted((x.batch, x.idx, x.feat[0]) for x in whole.collect()) == sorted((x.batch, x.idx, float(x.node)) for x in access.collect())
    assert rows(caches.feature_cache_table(nodes(spark, 3), slots).select("node", "state")) == [(0, -2), (1, -1), (2, -2)]


def test_ranks_and_plan(spark):
    rng = random.Random(2)
    values = [(k, float(rng.choice([0, 0, 0, 1, 1, 2, 5, 9]))) for k in range(400)]
    got = rows(cache_plan.ranked(spark.createDataFrame(values, "node long, v double"), "v").select("rank", "node", "upto"))
    order = sorted(values, key=lambda x: (-x[1], x[0]))
    assert got == [(k + 1, node, sum(v for _, v in order[: k + 1])) for k, (node, _) in enumerate(order)]
    zero = spark.createDataFrame([(k, 0.0) for k in range(9)], "node long, io double")
    nothing = cache_plan.alpha_search(zero, zero.withColumnRenamed("io", "freq"), 10**6, 4, 4).first()
    assert tuple(nothing) == (0.0, 0, 0, 0.0)


# model


def test_layers_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = {k: rng.normal(size=3) for k in range(5)}
    states = spark.createDataFrame([(0, k, v.tolist()) for k, v in x.items()], "batch long, node long, x array<double>")
    drawn = spark.createDataFrame([(0, 0, 0, 1, 0, 1), (0, 0, 0, 2, 0, 2), (0, 0, 1, 0, 1, 1)], "batch long, layer int, src long, dst long, idx long, r int")
    targets = spark.createDataFrame([(0, k, k) for k in range(3)], "batch long, node long, idx long")
    left, right, bias = rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    got = {r.node: r.x for r in sage.sage_layer(targets, drawn, states, left, bias, right).collect()}
    means = {0: (x[1] + x[2]) / 2, 1: x[0], 2: np.zeros(3)}
    for k in range(3):
        assert got[k] == pytest.approx(np.maximum(left @ means[k] + bias + right @ x[k], 0))
    logp = spark.createDataFrame([(0, 0, [1000.0, 1000.0])], "batch long, node long, x array<double>").select("batch", "node", sage.log_softmax("x").alias("logp"))
    assert logp.first().logp == pytest.approx([math.log(0.5)] * 2)
    labels = spark.createDataFrame([(0, 1), (1, None)], "node long, label int")
    assert sage.nll_loss(logp, labels).first().loss == pytest.approx(math.log(2))
    assert tuple(sage.accuracy(logp, labels).first()) == (0, 1, 0.0)


def test_dropout(spark):
    df = spark.createDataFrame([(0, k, [1.0] * 200) for k in range(10)], "batch long, node long, x array<double>")
    out = [v for r in sage.dropout(df, 0.5, 3).collect() for v in r.x]
    assert set(out) == {0.0, 2.0} and 0.45 < out.count(0.0) / len(out) < 0.55
    assert sage.dropout(df, 0.5, 3, training=False) is df


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    blocks = [Block(4, np.array([0, 0, 1, 3]), np.array([4, 5, 2, 5])), Block(2, np.array([0, 1, 1]), np.array([3, 2, 3]))]
    x, labels, known = rng.normal(size=(6, 3)), np.array([1]), np.array([False, True])
    model = Sage([3, 4, 2], 1)
    logp, tape = model.forward(x, blocks)
    grads = model.backward(logp, labels, known, tape, blocks)
    for k, w in enumerate(model.weights):
        for name in w:
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            eps, kept, values = 1e-6, w[name][at], []
            for sign in (1, -1):
                w[name][at] = kept + sign * eps
                values.append(-model.forward(x, blocks)[0][1, 1])
            w[name][at] = kept
            assert grads[k][name][at] == pytest.approx((values[0] - values[1]) / (2 * eps), abs=1e-6)


def test_training_learns(spark):
    n = 60
    e = both([(k, (k + 2 * j) % n) for k in range(n) for j in range(1, 4)])
    levels, made, actions = sampling.sample_pruned(batches(spark, 40, 20), edges(spark, e), nodes(spark, n), [3, 3], 2, 4)
    feats = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(n)], "node long, feat array<float>")
    labels = spark.createDataFrame([(k, k % 2) for k in range(39)], "node long, label int")
    settled_actions = settled(actions, "actions")
    _, curve = train(levels, made, feats, labels, hidden=8, classes=2, epochs=4, rate=0.05, dropout=0.0, actions=settled_actions)
    assert curve[-1][0] < curve[0][0] and curve[-1][1] > 0.9


def test_bloom_filters():
    k, size = bloom_size(1000, 0.1)
    assert k == 3 and 4.7 < size / 1000 < 4.9
    a, b = BloomFilter(500, 0.01), BloomFilter(500, 0.01)
    a.insert(np.arange(0, 500))
    b.insert(np.arange(400, 900))
    assert a.contains(np.arange(500)).all() and a.contains(np.arange(10_000, 20_000)).mean() < 0.03
    assert (a | b).contains(np.arange(900)).all() and (a & b).contains(np.arange(400, 500)).all()
    assert 0 < a.effective_rate() < 0.02
    assert a.compressed().contains(np.arange(500)).all() and a.compressed().size == a.size // 2
    assert ((a ^ a).bits == 0).all()
    with pytest.raises(ValueError):
        a | BloomFilter(500, 0.2)
