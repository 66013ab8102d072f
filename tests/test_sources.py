"""Stores, raw arrays and streams."""

from __future__ import annotations

import numpy as np

from graphspark import programs
from graphspark.operators import ingest, sampling
from graphspark.sources import store
from graphspark.streaming.degrees import streamed_degrees, windowed_degrees

PAIRS = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3), (0, 1)]


def graph(spark):
    e = spark.createDataFrame(PAIRS, "src long, dst long")
    feats = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "node long, feat array<float>")
    labels = spark.createDataFrame([(k, float("nan") if k == 4 else float(k % 2)) for k in range(5)], "node long, label double")
    splits = spark.createDataFrame([(0, "train"), (1, "valid")], "node long, split string")
    return store.Graph.from_edges(e, 5, feats, labels, splits)


def test_round_trip(spark, tmp_path):
    g = graph(spark)
    g.save(str(tmp_path / "g"))
    h = store.Graph.load(spark, str(tmp_path / "g"))
    for name in store.Graph.TABLES:
        assert sorted(map(str, getattr(g, name).collect())) == sorted(map(str, getattr(h, name).collect()))
    assert tuple(h.meta().first()) == (5, 9, 2, 2)
    assert {x.node: x.label for x in h.labels.collect()}[4] is None
    assert spark.read.parquet(str(tmp_path / "g" / "graph_meta")).count() == 1


def test_raw_arrays(spark, tmp_path):
    indptr, indices = np.array([0, 2, 2, 5], "<i8"), np.array([1, 70_000_000_000, 0, 1, 2], "<i8")
    indptr.tofile(tmp_path / "indptr.dat")
    indices.tofile(tmp_path / "indices.dat")
    got = sorted(tuple(x) for x in store.read_csr(spark, str(tmp_path / "indptr.dat"), str(tmp_path / "indices.dat")).collect())
    assert got == [(0, 1), (0, 70_000_000_000), (2, 0), (2, 1), (2, 2)]


def test_raw_arrays_of_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PIECE", 1000)
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 400_000)
    values.astype("<i8").tofile(tmp_path / "x.dat")
    got = store.load_int64(spark, str(tmp_path / "x.dat")).toPandas().sort_values("pos")
    assert (got["pos"].to_numpy() == np.arange(len(values))).all() and (got["value"].to_numpy() == values).all()
    matrix = np.random.default_rng(2).random((5000, 7)).astype("<f4")
    matrix.tofile(tmp_path / "f.dat")
    got = store.load_float32(spark, str(tmp_path / "f.dat"), 7).toPandas().sort_values("node")
    assert (got["node"].to_numpy() == np.arange(5000)).all() and (np.stack(got["feat"].to_numpy()) == matrix).all()
    (tmp_path / "none.dat").write_bytes(b"")
    assert store.load_int64(spark, str(tmp_path / "none.dat")).collect() == []


def test_programs_one_after_another(spark, tmp_path):
    """From raw files to a trained model, each program on what the ones before wrote."""
    rng, n = np.random.default_rng(5), 60
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (300, 2))]
    spark.createDataFrame(pairs, "src long, dst long").write.parquet(str(tmp_path / "edges"))
    rng.random((n, 4)).astype("<f4").tofile(tmp_path / "features.dat")
    (np.arange(n) % 3).astype("<f4").tofile(tmp_path / "labels.dat")
    for name, rest in (("train", {0, 1, 2}), ("valid", {3}), ("test", {4})):
        spark.createDataFrame([(k,) for k in range(n) if k % 5 in rest], "node long").write.parquet(str(tmp_path / name))
    call = lambda *x: programs.run(spark, [x[0], "--graph", str(tmp_path / "g"), *map(str, x[1:])])
    splits = [y for name in ("train", "valid", "test") for y in ("--split", f"{name}={tmp_path / name}")]
    meta = call("prepare", "--edges", tmp_path / "edges", "--num-nodes", n, "--features", tmp_path / "features.dat", "--num-features", 4, "--labels", tmp_path / "labels.dat", *splits)
    assert meta["num_nodes"] == n and meta["num_features"] == 4 and meta["num_classes"] == 3
    cut = call("partition", "--parts", 6, "--first-level", 2, "--imbalance-ratio", 1.5)
    assert 0 < cut["edge_cut"] <= cut["total_edges"] == meta["num_edges"]
    assert call("cache", "--neigh-cache-size", 8 * n + 800)["nodes"] > 0
    table, words, size = store.load_neighbor_cache(spark, str(tmp_path / "g" / "neighbor_cache"))
    near = {(x.src, x.dst) for x in spark.read.parquet(str(tmp_path / "g" / "edges")).collect()}
    held = {x.node for x in table.collect()}
    assert size == 8 * n + 800 and {(x.node, x.dst) for x in store.cached_rows(table, words).collect()} == {x for x in near if x[0] in held}
    sampled = ("--batch-size", 10, "--sizes", "3,2", "--partition-batch", 2, "--num-hiddens", 5)
    plan = call("profile", *sampled, "--feature-cache-size", 3000)
    assert spark.read.parquet(str(tmp_path / "g" / "candidates_emb")).count() == plan["n_emb"]
    curve = call("train", *sampled, "--num-epochs", 2, "--staleness-threshold", 3)["curve"]
    assert len(curve) == 2 and all(np.isfinite(loss) and 0 <= share <= 1 for loss, share in curve)


def test_parts_are_read_alone(spark, tmp_path):
    g = graph(spark)
    parts = g.nodes.selectExpr("node", "CAST(node % 2 AS INT) AS part")
    store.save_partitioned(g.edges, parts, g.splits, str(tmp_path / "p"))
    e, members = store.load_parts(spark, str(tmp_path / "p"), [1])
    assert {x.src for x in e.collect()} == {1, 3} and {x.node for x in members.collect()} == {1, 3}
    assert "PartitionFilters: [isnotnull(part" in e._jdf.queryExecution().toString()


def test_masks_and_trace(spark, tmp_path):
    masks = spark.createDataFrame([(0, 1.0, True, False, False), (1, 0.0, False, True, False), (2, 1.0, False, False, False)], "node long, label double, is_train boolean, is_valid boolean, is_test boolean")
    masks.write.parquet(str(tmp_path / "m"))
    labels, splits = store.read_masked(spark, str(tmp_path / "m"))
    assert sorted(tuple(x) for x in splits.collect()) == [(0, "train"), (1, "valid")] and labels.count() == 3
    g = graph(spark)
    seeds = spark.createDataFrame([(0, 0, 0), (1, 2, 0)], "batch long, node long, idx long")
    levels, rows = sampling.sample_khop(seeds, g.edges, [2, 2], 1)
    store.save_trace(levels, rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "nids")).where("batch = 1").count() == sum(x.where("batch = 1").count() for x in levels)
    for batches in (None, [1]):
        again = store.load_trace(spark, str(tmp_path / "t"), batches)
        for old, new in zip((*levels, *rows), (*again[0], *again[1]), strict=True):
            old = old if batches is None else old.where("batch = 1")
            assert sorted(map(str, new.select(old.columns).collect())) == sorted(map(str, old.collect()))


def test_streamed_degrees(spark, tmp_path):
    rows = [(k, a, b) for k, (a, b) in enumerate(PAIRS) if a != b]
    spark.createDataFrame(rows, "k int, src long, dst long").selectExpr("timestamp_seconds(k) AS ts", "src", "dst").write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema("ts timestamp, src long, dst long").parquet(str(tmp_path / "e"))
    for name, df, mode in (("deg", streamed_degrees(stream()), "complete"), ("win", windowed_degrees(stream()), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    whole = ingest.degrees(spark.range(4).withColumnRenamed("id", "node"), ingest.undirected(spark.createDataFrame([x[1:] for x in rows], "src long, dst long")))
    assert sorted(tuple(x) for x in spark.table("deg").collect()) == sorted(tuple(x) for x in whole.collect())
    assert sum(x.deg for x in spark.table("win").collect()) == len(rows)
