"""DuckDB SQL for the queries of ``queries``, over the same tables.

Every statement is a list of common tables, of which a query names those that
it needs, and a last SELECT.
"""

from __future__ import annotations

import re

SIZES = (3, 2, 2)


def _key(*parts: str) -> str:
    return "md5('7|' || " + " || '|' || ".join(parts) + ")"


def _sample(layer: int, targets: str, k: int) -> str:
    key = _key("t.batch", f"'{layer}'", "e.src", "e.dst")
    keep = f"WHERE r <= {k}" if k >= 0 else ""
    return f"SELECT batch, src, dst, idx, r FROM (SELECT t.batch, e.src, e.dst, t.idx, row_number() OVER (PARTITION BY t.batch, e.src ORDER BY {key}, e.dst) AS r FROM {targets} t JOIN edges e ON e.src = t.node) {keep}"


def _first(targets: str, rows: str) -> str:
    return f"SELECT batch, src, dst, idx, r FROM (SELECT x.batch, x.src, x.dst, x.idx, x.r, row_number() OVER (PARTITION BY x.batch, x.dst ORDER BY x.idx, x.r) AS q FROM {rows} x LEFT JOIN {targets} t ON t.batch = x.batch AND t.node = x.dst WHERE t.node IS NULL) WHERE q = 1"


def _next(targets: str, first: str) -> str:
    return f"SELECT batch, node, idx FROM {targets} UNION ALL SELECT f.batch, f.dst, n.n + row_number() OVER (PARTITION BY f.batch ORDER BY f.idx, f.r) - 1 FROM {first} f JOIN (SELECT batch, count(*) AS n FROM {targets} GROUP BY batch) n ON n.batch = f.batch"


def _weight(o: str, i: str, salt: int) -> str:
    return f"((({i} * 31 + {o} * 17 + {salt * 7}) % 13 - 6) / 104.0)"


COMMON: dict[str, str] = {
    "nodes": "SELECT p_partkey AS node FROM part",
    "lines": "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem",
    "edges": "SELECT DISTINCT a.p AS src, b.p AS dst FROM lines a JOIN lines b ON a.o = b.o AND a.p <> b.p",
    "n_parts": "SELECT count(*) AS n FROM part",
    "supply_pairs": "SELECT DISTINCT l_partkey AS src, l_suppkey + n AS dst FROM lineitem, n_parts",
    "supply_edges": "SELECT src, dst FROM supply_pairs UNION SELECT dst, src FROM supply_pairs",
    "supply_nodes": "SELECT node FROM nodes UNION ALL SELECT s_suppkey + n FROM supplier, n_parts",
    "bought": "SELECT l_partkey AS src, o_custkey + n AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey, n_parts",
    "bought_edges": "SELECT src, dst FROM bought UNION SELECT dst, src FROM bought",
    "bought_nodes": "SELECT node FROM nodes UNION ALL SELECT c_custkey + n FROM customer, n_parts",
    "deg": "SELECT node, count(dst) AS deg FROM nodes LEFT JOIN edges ON src = node GROUP BY node",
    "splits": "SELECT node, CASE WHEN node % 10 < 6 THEN 'train' WHEN node % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM nodes",
    "assignment": "SELECT node, CAST(node % 20 AS INTEGER) AS part FROM nodes",
    "sided": "SELECT e.src, e.dst, a.part AS part_src, b.part AS part_dst FROM edges e JOIN assignment a ON a.node = e.src JOIN assignment b ON b.node = e.dst",
    "features": "SELECT n.node, e.embedding, CAST(e.label AS INTEGER) AS label FROM nodes n JOIN embeddings e ON e.vec_id = n.node % (SELECT count(*) FROM embeddings)",
    "entries": "SELECT node, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM features",
    "sbs": f"SELECT part, CAST(floor((row_number() OVER (ORDER BY {_key("'0'", "'part'", 'part')}, part) - 1) / 4) AS BIGINT) AS super_batch FROM (SELECT DISTINCT part FROM assignment)",
    "seeds": f"SELECT b.super_batch, a.node, row_number() OVER (PARTITION BY b.super_batch ORDER BY {_key("'0'", "'node'", 'a.node')}, a.node) - 1 AS pos FROM assignment a JOIN splits s ON s.node = a.node AND s.split = 'train' JOIN sbs b ON b.part = a.part",
    "firsts": "SELECT super_batch, coalesce(sum(n) OVER (ORDER BY super_batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT super_batch, ceil(count(*) / 100) AS n FROM seeds GROUP BY super_batch)",
    "t0": "SELECT CAST(f.first + s.pos // 100 AS BIGINT) AS batch, s.node, s.pos % 100 AS idx FROM seeds s JOIN firsts f ON f.super_batch = s.super_batch",
    "v_seeds": f"SELECT b.super_batch, a.node, row_number() OVER (PARTITION BY b.super_batch ORDER BY {_key("'0'", "'node'", 'a.node')}, a.node) - 1 AS pos FROM assignment a JOIN splits s ON s.node = a.node AND s.split = 'valid' JOIN sbs b ON b.part = a.part",
    "v_firsts": "SELECT super_batch, coalesce(sum(n) OVER (ORDER BY super_batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT super_batch, ceil(count(*) / 100) AS n FROM v_seeds GROUP BY super_batch)",
    "v0": "SELECT CAST(f.first + s.pos // 100 AS BIGINT) AS batch, s.node, s.pos % 100 AS idx FROM v_seeds s JOIN v_firsts f ON f.super_batch = s.super_batch",
    "r0": _sample(0, "t0", SIZES[0]),
    "f0": _first("t0", "r0"),
    "t1": _next("t0", "f0"),
    "r1": _sample(1, "t1", SIZES[1]),
    "f1": _first("t1", "r1"),
    "t2": _next("t1", "f1"),
    "r2": _sample(2, "t2", SIZES[2]),
    # row reuse: only the targets that are new are sampled
    "new1": "SELECT * FROM t1 WHERE (batch, node) NOT IN (SELECT (batch, node) FROM t0)",
    "s1": _sample(1, "new1", SIZES[1]),
    "u1": "SELECT * FROM r0 UNION ALL SELECT * FROM s1",
    "uf1": _first("t1", "u1"),
    "u_t2": _next("t1", "uf1"),
    "new2": "SELECT * FROM u_t2 WHERE (batch, node) NOT IN (SELECT (batch, node) FROM t1)",
    "s2": _sample(2, "new2", SIZES[2]),
    "u2": "SELECT * FROM u1 UNION ALL SELECT * FROM s2",
    # caches
    "score": "SELECT n.node, count(*) FILTER (WHERE part_src <> part_dst) AS cross_edges FROM nodes n LEFT JOIN sided s ON s.src = n.node GROUP BY n.node",
    "cache_words": "SELECT d.node, d.deg, sum(d.deg + 1) OVER (ORDER BY s.cross_edges DESC, d.node ROWS UNBOUNDED PRECEDING) AS upto FROM deg d JOIN score s ON s.node = d.node",
    "cache": "SELECT node, CAST(upto - deg - 1 AS BIGINT) AS address FROM cache_words WHERE upto <= (SELECT (60 * count(*) - 8 * count(*)) // 8 FROM nodes)",
    "candidates": "SELECT node, slot FROM (SELECT node, row_number() OVER (ORDER BY deg DESC, node) - 1 AS slot FROM deg) WHERE slot < (SELECT count(*) // 5 FROM nodes)",
    "access": "SELECT a.batch, a.idx, a.node, c.slot, c.slot IS NOT NULL AND row_number() OVER (PARTITION BY a.node ORDER BY a.batch) > 1 AS hit FROM t1 a LEFT JOIN candidates c ON c.node = a.node",
    "onehop": "SELECT t.node, t.batch, row_number() OVER (PARTITION BY t.node ORDER BY t.batch) AS k FROM t1 t JOIN candidates c ON c.node = t.node",
    "fold": "SELECT node, batch, k, batch AS last, 'push' AS action FROM onehop WHERE k = 1 UNION ALL SELECT o.node, o.batch, o.k, CASE WHEN o.batch - f.last < 3 THEN f.last ELSE o.batch END, CASE WHEN o.batch - f.last < 3 THEN 'pull' ELSE 'push' END FROM fold f JOIN onehop o ON o.node = f.node AND o.k = f.k + 1",
    # pruning: a pulled node has no row unless a row drawn after layer 0 names it
    "pulled": "SELECT batch, node FROM fold WHERE action = 'pull'",
    "p_new1": "SELECT * FROM new1 WHERE (batch, node) NOT IN (SELECT (batch, node) FROM pulled)",
    "p_s1": _sample(1, "p_new1", SIZES[1]),
    "p1": "SELECT * FROM r0 WHERE (batch, src) NOT IN (SELECT (batch, node) FROM pulled) UNION ALL SELECT * FROM p_s1",
    "pf1": _first("t1", "p1"),
    "p_t2": _next("t1", "pf1"),
    "p_new2": "SELECT * FROM p_t2 WHERE (batch, node) NOT IN (SELECT (batch, node) FROM t1) UNION ALL SELECT * FROM t1 WHERE (batch, node) IN (SELECT (batch, node) FROM pulled) AND (batch, node) IN (SELECT (batch, dst) FROM p_s1)",
    "p_s2": _sample(2, "p_new2", SIZES[2]),
    "p2": "SELECT * FROM p1 UNION ALL SELECT * FROM p_s2",
    # profile over two layers
    "freq": "SELECT node, count(DISTINCT batch) AS freq FROM t2 GROUP BY node",
    "sums_before": "SELECT batch, src AS node, count(*) AS v FROM r1 GROUP BY batch, src",
    "sums_after": "SELECT batch, src AS node, count(*) AS v FROM f1 GROUP BY batch, src",
    "before": "SELECT t.node, CAST(sum(coalesce(v, 0)) AS BIGINT) AS size FROM t1 t LEFT JOIN sums_before s ON s.batch = t.batch AND s.node = t.node GROUP BY t.node",
    "after": "SELECT t.node, CAST(sum(coalesce(v, 0)) AS BIGINT) AS size FROM t1 t LEFT JOIN sums_after s ON s.batch = t.batch AND s.node = t.node GROUP BY t.node",
    "io": "SELECT n.node, CAST(coalesce(b.size, 0) AS DOUBLE) * 0.5 + coalesce(a.size, 0) AS io FROM nodes n LEFT JOIN before b ON b.node = n.node LEFT JOIN after a ON a.node = n.node",
    "io_ranks": "SELECT node, io, row_number() OVER (ORDER BY io DESC, node) AS rank, sum(io) OVER (ORDER BY io DESC, node ROWS UNBOUNDED PRECEDING) AS upto FROM io",
    "freq_ranks": "SELECT n.node, row_number() OVER (ORDER BY coalesce(freq, 0) DESC, n.node) AS rank, sum(CAST(coalesce(freq, 0) AS DOUBLE)) OVER (ORDER BY coalesce(freq, 0) DESC, n.node ROWS UNBOUNDED PRECEDING) AS upto FROM nodes n LEFT JOIN freq f ON f.node = n.node",
    "grid": "SELECT CAST(a AS DOUBLE) / 100 AS alpha, least(greatest(CAST(trunc((CAST(200 * n * a AS DOUBLE) / 100 - 8 * n) / 68) AS BIGINT), 0), n) AS n_emb, least(greatest(CAST(trunc((200 * n * (1 - CAST(a AS DOUBLE) / 100) - 4 * n) / 256) AS BIGINT), 0), n) AS n_feat FROM range(1, 100) g(a), n_parts",
    "benefits": "SELECT g.*, coalesce(i.upto, 0) + coalesce(f.upto, 0) AS benefit FROM grid g LEFT JOIN io_ranks i ON i.rank = g.n_emb LEFT JOIN freq_ranks f ON f.rank = g.n_feat",
    "plan": "SELECT alpha, n_emb, n_feat, benefit FROM (SELECT * FROM benefits WHERE benefit > 0 UNION ALL SELECT 0.0, 0, 0, 0.0) ORDER BY benefit DESC, alpha LIMIT 1",
    # model
    "means": "SELECT r.batch, r.src AS node, x.pos, avg(x.x) AS mean FROM r0 r JOIN entries x ON x.node = r.dst GROUP BY r.batch, r.src, x.pos",
    "outputs": "SELECT unnest(range(0, 10)) AS o",
    "layer": f"SELECT t.batch, t.node, o.o AS pos, sum({_weight('o.o', 'x.pos', 1)} * coalesce(m.mean, 0) + {_weight('o.o', 'x.pos', 2)} * x.x) + {_weight('o.o', '0', 3)} AS y FROM t0 t JOIN entries x ON x.node = t.node LEFT JOIN means m ON m.batch = t.batch AND m.node = t.node AND m.pos = x.pos CROSS JOIN outputs o GROUP BY t.batch, t.node, o.o",
    "inner_means": "SELECT r.batch, r.src AS node, x.pos, avg(x.x) AS mean FROM r1 r JOIN entries x ON x.node = r.dst GROUP BY r.batch, r.src, x.pos",
    "inner_layer": f"SELECT t.batch, t.node, o.o AS pos, greatest(0.0, sum({_weight('o.o', 'x.pos', 1)} * coalesce(m.mean, 0) + {_weight('o.o', 'x.pos', 2)} * x.x) + {_weight('o.o', '0', 3)}) AS x FROM t1 t JOIN entries x ON x.node = t.node LEFT JOIN inner_means m ON m.batch = t.batch AND m.node = t.node AND m.pos = x.pos CROSS JOIN (SELECT unnest(range(0, 16)) AS o) o GROUP BY t.batch, t.node, o.o",
    "outer_means": "SELECT r.batch, r.src AS node, x.pos, avg(x.x) AS mean FROM r0 r JOIN inner_layer x ON x.batch = r.batch AND x.node = r.dst GROUP BY r.batch, r.src, x.pos",
    "outer_layer": f"SELECT t.batch, t.node, o.o AS pos, sum({_weight('o.o', 'x.pos', 4)} * coalesce(m.mean, 0) + {_weight('o.o', 'x.pos', 5)} * x.x) + {_weight('o.o', '0', 6)} AS y FROM t0 t JOIN inner_layer x ON x.batch = t.batch AND x.node = t.node LEFT JOIN outer_means m ON m.batch = t.batch AND m.node = t.node AND m.pos = x.pos CROSS JOIN outputs o GROUP BY t.batch, t.node, o.o",
    "logp": "SELECT batch, node, pos, y - max(y) OVER w - ln(sum(exp(y)) OVER w / exp(max(y) OVER w)) AS logp FROM layer WINDOW w AS (PARTITION BY batch, node)",
    "best": "SELECT batch, node, min(pos) AS pos FROM (SELECT *, max(logp) OVER (PARTITION BY batch, node) AS top FROM logp) WHERE logp = top GROUP BY batch, node",
}


def _placed(name: str, parts: int, imbalance: float, rows: str, trained: str) -> str:
    """Tables that end in ``name(grp, step, live, ...)``: placements of the nodes of
    each group, one per step, with the state in lists. ``rows`` are the nodes
    ``grp, local, train, nbrs`` (negative: outside), ``trained`` the number of
    training nodes that the cap follows from."""
    each = lambda x: f"list_transform(range(0, {parts}), lambda q: {x})"
    return f"""{name}_rows AS MATERIALIZED ({rows}),
    {name}_totals AS MATERIALIZED (SELECT grp, count(*) AS n, CAST({parts} AS DOUBLE) * sum(len(nbrs)) / (count(*) * count(*)) AS alpha, CAST(floor(CAST(count(*) AS DOUBLE) / {parts} * {imbalance}) AS BIGINT) AS cap, CAST(floor(CAST(({trained}) AS DOUBLE) / {parts} * {imbalance}) AS BIGINT) AS tcap FROM {name}_rows GROUP BY grp),
    {name} AS (SELECT grp, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS live, {each("CAST(0 AS BIGINT)")} AS sizes, {each("CAST(0 AS BIGINT)")} AS tsizes FROM {name}_totals UNION ALL
      SELECT grp, step + 1, list_append(live, p), {each("sizes[q + 1] + CASE WHEN q = p THEN 1 ELSE 0 END")}, {each("tsizes[q + 1] + CASE WHEN q = p AND train THEN 1 ELSE 0 END")}
      FROM (SELECT *, list_position(s, list_max(s)) - 1 AS p FROM (SELECT *, {each(_SCORE)} AS s FROM (
        SELECT f.*, r.train, t.alpha, t.cap, t.tcap, list_transform(r.nbrs, lambda d: f.live[d + 1]) AS near FROM {name} f JOIN {name}_rows r ON r.grp = f.grp AND r.local = f.step JOIN {name}_totals t ON t.grp = f.grp))))"""


_SCORE = "CASE WHEN sizes[q + 1] + 1 <= cap AND (NOT train OR tsizes[q + 1] + 1 <= tcap) THEN len(list_filter(near, lambda x: x = q)) - alpha * 2.0 * sizes[q + 1] - sqrt(tsizes[q + 1]) ELSE CAST('-Infinity' AS DOUBLE) END"
_TRAINED = "SELECT count(*) FROM nodes WHERE node % 10 < 6"
_WHOLE = "SELECT CAST(0 AS BIGINT) AS grp, n.node AS local, n.node % 10 < 6 AS train, coalesce(list(e.dst) FILTER (WHERE e.dst IS NOT NULL), []) AS nbrs FROM nodes n LEFT JOIN edges e ON e.src = n.node GROUP BY n.node"


def _fennel(rounds: int) -> str:
    """The whole graph in ten parts, and a second round that moves nodes by the parts of the first."""
    sql, last = _placed("one", 10, 1.3, _WHOLE, _TRAINED), "one"
    if rounds == 2:
        each = lambda x: f"list_transform(range(0, 10), lambda q: {x})"
        change = "CASE WHEN p <> now AND q = p THEN {0} WHEN p <> now AND q = now THEN -{0} ELSE 0 END"
        sql += f""",
    two AS (SELECT CAST(0 AS BIGINT) AS grp, CAST(0 AS BIGINT) AS step, live, live AS seen, sizes, tsizes FROM one WHERE step = (SELECT n FROM one_totals) UNION ALL
      SELECT grp, step + 1, list_concat(list_append(live[1:step], p), live[step + 2:]), seen, {each("sizes[q + 1] + " + change.format("1"))}, {each("tsizes[q + 1] + " + change.format("CASE WHEN train THEN 1 ELSE 0 END"))}
      FROM (SELECT *, list_position(s, list_max(s)) - 1 AS p, live[step + 1] AS now FROM (SELECT *, {each(_SCORE)} AS s FROM (
        SELECT f.*, r.train, t.alpha, t.cap, t.tcap, list_transform(r.nbrs, lambda d: f.seen[d + 1]) AS near FROM two f JOIN one_rows r ON r.local = f.step CROSS JOIN one_totals t))))"""
        last = "two"
    return f"WITH RECURSIVE {_needed('SELECT * FROM nodes, edges')}, {sql}\nSELECT CAST(unnest(range(0, len(live))) AS BIGINT) AS node, unnest(live) AS part FROM {last} WHERE step = (SELECT n FROM one_totals)"


def _fennel_two_level() -> str:
    """Four parts, each of which is split into five; neighbours elsewhere count as entries."""
    inner = """SELECT a.grp, a.local, a.train, coalesce(list(CASE WHEN b.grp = a.grp THEN b.local ELSE -1 END) FILTER (WHERE e.dst IS NOT NULL), []) AS nbrs
      FROM members a LEFT JOIN edges e ON e.src = a.node LEFT JOIN members b ON b.node = e.dst GROUP BY a.grp, a.local, a.train"""
    members = "SELECT node, grp, row_number() OVER (PARTITION BY grp ORDER BY node) - 1 AS local, node % 10 < 6 AS train FROM (SELECT CAST(unnest(range(0, len(live))) AS BIGINT) AS node, unnest(live) AS grp FROM one WHERE step = (SELECT n FROM one_totals))"
    return f"""WITH RECURSIVE {_needed('SELECT * FROM nodes, edges')}, {_placed("one", 4, 1.3, _WHOLE, _TRAINED)},
    members AS MATERIALIZED ({members}), {_placed("two", 5, 1.3, inner, _TRAINED)},
    ends AS (SELECT two.grp, two.live FROM two JOIN two_totals t ON t.grp = two.grp AND t.n = two.step),
    split AS (SELECT grp, CAST(unnest(range(0, len(live))) AS BIGINT) AS local, unnest(live) AS part FROM ends)
SELECT m.node, m.grp AS part1, m.grp * 5 + s.part AS part FROM members m JOIN split s ON s.grp = m.grp AND s.local = m.local"""


def _needed(select: str) -> str:
    """The common tables that a statement names, and those that they name."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in COMMON:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                wanted.append(name)
                add(COMMON[name])

    add(select)
    return ",\n".join(f"{name} AS ({text})" for name, text in COMMON.items() if name in wanted)


def _blocks(*rows: str) -> str:
    return " UNION ALL ".join(f"SELECT batch, src, dst, idx, r, CAST({k} AS BIGINT) AS block FROM {x}" for k, x in enumerate(rows))


STATEMENTS: dict[str, str] = {
    "undirected_edges": "SELECT src, dst FROM supply_edges",
    "customer_part_edges": "SELECT src, dst FROM bought_edges",
    "csr_indptr": "SELECT node, CAST(sum(deg) OVER (ORDER BY node) - deg AS BIGINT) AS indptr FROM deg UNION ALL SELECT max(node) + 1, CAST(sum(deg) AS BIGINT) FROM deg",
    "csr_indices": "SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM edges",
    "csc_indptr": "SELECT node, CAST(sum(d) OVER (ORDER BY node) - d AS BIGINT) AS indptr FROM (SELECT node, count(dst) AS d FROM supply_nodes LEFT JOIN supply_pairs ON dst = node GROUP BY node) UNION ALL SELECT (SELECT max(node) + 1 FROM supply_nodes), (SELECT count(*) FROM supply_pairs)",
    "degrees": "SELECT node, count(dst) AS deg FROM bought_nodes LEFT JOIN bought_edges ON src = node GROUP BY node",
    "graph_meta": "SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges, (SELECT CAST(max(len(embedding)) AS BIGINT) FROM features) AS num_features, (SELECT count(DISTINCT label) FROM features) AS num_classes",
    "split_masks": "SELECT node, split = 'train' AS is_train, split = 'valid' AS is_valid, split = 'test' AS is_test FROM splits",
    "mask_splits": "SELECT node, split FROM splits",
    "fetch_split_nodes": "SELECT a.part, a.node FROM assignment a JOIN splits s ON s.node = a.node WHERE s.split = 'valid'",
    "edge_source_roundtrip": "SELECT src, dst FROM edges",
    "batch_labels": "SELECT t.batch, t.idx, t.node, f.label FROM t0 t LEFT JOIN features f ON f.node = t.node",
    "super_batches": "SELECT part, super_batch FROM sbs",
    "mini_batches": "SELECT batch, node, idx FROM t0",
    "edge_cut": "SELECT count(*) AS total_edges, count(*) FILTER (WHERE part_src <> part_dst) AS edge_cut, floor(100.0 * count(*) FILTER (WHERE part_src <> part_dst) / nullif(count(*), 0)) / 100.0 AS ratio FROM sided",
    "cross_edge_score": "SELECT node, cross_edges FROM score",
    "part_csr": "SELECT part_src AS part, src, dst FROM sided",
    "super_batch_csr": "SELECT b.super_batch, s.src, s.dst FROM sided s JOIN sbs b ON b.part = s.part_src",
    "first_level_relabel": """SELECT e.part_src AS part, m.local AS src_local, coalesce(n.local, f.local) AS dst_local FROM sided e
      JOIN (SELECT node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS local FROM assignment) m ON m.node = e.src
      LEFT JOIN (SELECT part, node, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS local FROM assignment) n ON n.node = e.dst AND n.part = e.part_src
      LEFT JOIN (SELECT part, node, size + row_number() OVER (PARTITION BY part ORDER BY src, dst) - 1 AS local FROM (
        SELECT part_src AS part, dst AS node, arg_min(src, src * 1000000000 + dst) AS src, arg_min(dst, src * 1000000000 + dst) AS dst FROM sided WHERE part_src <> part_dst GROUP BY part_src, dst)
        JOIN (SELECT part AS p, count(*) AS size FROM assignment GROUP BY part) ON p = part) f ON f.part = e.part_src AND f.node = e.dst AND e.part_src <> e.part_dst""",
    "sample_full": f"SELECT batch, src, dst, idx, r FROM ({_sample(0, 't0', -1)})",
    "sample_k": f"SELECT batch, src, dst, idx, r FROM ({_sample(0, 't0', 10)})",
    "sample_replace": f"SELECT d.batch, d.node AS src, e.dst, d.idx, d.r FROM (SELECT t.batch, t.node, t.idx, j.r, CAST('0x' || substr({_key('t.batch', "'0'", 't.node', 'j.r')}, 1, 8) AS BIGINT) % g.deg AS at FROM t0 t JOIN deg g ON g.node = t.node AND g.deg > 0 CROSS JOIN range(1, 6) j(r)) d JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS at FROM edges) e ON e.src = d.node AND e.at = d.at",
    "trace_roundtrip": f"SELECT * FROM ({_blocks('r0', 'r1')}) WHERE batch < 3",
    "sample_valid_mode": f"SELECT batch, src, dst, idx, r FROM ({_sample(0, 'v0', 10)})",
    "part_folders": "SELECT CAST(a.part AS BIGINT) AS part, a.node, e.dst FROM assignment a JOIN splits s ON s.node = a.node AND s.split = 'train' JOIN edges e ON e.src = a.node WHERE a.part IN (1, 5, 12)",
    "sample_khop3": _blocks("r0", "r1", "r2"),
    "sample_nid_relabel": "SELECT r.batch, r.src AS dst_node, r.dst AS src_node, r.idx AS dst_local, t.idx AS src_local FROM r1 r JOIN t2 t ON t.batch = r.batch AND t.node = r.dst",
    "sample_profiling_first_discovery": _blocks("f0", "f1"),
    "sample_reuse_rows": _blocks("r0", "u1", "u2"),
    "sample_prune": _blocks("r0", "p1", "p2"),
    "sample_tiers": "SELECT r.batch, CASE WHEN c.node IS NOT NULL THEN 'cache' WHEN b.super_batch = h.super_batch THEN 'super_batch' ELSE 'graph' END AS tier, count(*) AS n FROM r0 r JOIN assignment a ON a.node = r.src JOIN sbs b ON b.part = a.part JOIN (SELECT DISTINCT t.batch, x.super_batch FROM t0 t JOIN assignment y ON y.node = t.node JOIN sbs x ON x.part = y.part) h ON h.batch = r.batch LEFT JOIN cache c ON c.node = r.src GROUP BY ALL",
    "access_freq": "SELECT node, freq FROM freq",
    "neigh_size_before": "SELECT node, size FROM before",
    "neigh_size_after": "SELECT node, size FROM after",
    "spmm_sum": "SELECT r.batch, r.src AS node, CAST(sum(t.idx) AS BIGINT) AS total FROM r0 r JOIN t1 t ON t.batch = r.batch AND t.node = r.dst GROUP BY r.batch, r.src",
    "node_io_prefix": "SELECT node, io, rank, upto FROM io_ranks",
    "alpha_search": "SELECT alpha, n_emb, n_feat, benefit FROM plan",
    "cache_candidates": "SELECT 'emb' AS kind, rank - 1 AS slot, node FROM io_ranks WHERE rank <= (SELECT n_emb FROM plan) UNION ALL SELECT 'feat', rank - 1, node FROM freq_ranks WHERE rank <= (SELECT n_feat FROM plan)",
    "neighbor_cache": "SELECT node, address FROM cache",
    "neighbor_cache_fill": "SELECT c.address AS pos, d.deg AS word FROM cache c JOIN deg d ON d.node = c.node UNION ALL SELECT c.address + row_number() OVER (PARTITION BY c.node ORDER BY e.dst), e.dst FROM cache c JOIN edges e ON e.src = c.node",
    "neighbor_cache_roundtrip": "SELECT c.node, e.dst FROM cache c JOIN edges e ON e.src = c.node",
    "feature_gather_zerocopy": "SELECT a.batch, a.idx, round(sum(x.x), 6) AS total FROM access a JOIN entries x ON x.node = a.node GROUP BY a.batch, a.idx",
    "sage_forward": "SELECT batch, node, pos, round(y - max(y) OVER w - ln(sum(exp(y)) OVER w / exp(max(y) OVER w)), 6) AS value FROM outer_layer WINDOW w AS (PARTITION BY batch, node)",
    "emb_pull_values": "SELECT f.batch, f.node, x.pos, round(avg(x.x), 6) AS value FROM fold f JOIN r1 r ON r.batch = f.last AND r.src = f.node JOIN entries x ON x.node = r.dst WHERE f.action = 'pull' GROUP BY f.batch, f.node, x.pos",
    "feature_gather": "SELECT t.batch, t.idx, t.node, x.pos, round(x.x, 6) AS value FROM t0 t JOIN entries x ON x.node = t.node",
    "feature_gather_cached": "SELECT a.batch, a.idx, a.node, a.hit, CASE WHEN a.hit THEN a.slot ELSE -1 END AS slot, round(sum(x.x), 6) AS total FROM access a JOIN entries x ON x.node = a.node GROUP BY ALL",
    "feature_cache_table": "SELECT n.node, CAST(CASE WHEN c.slot IS NULL THEN -2 ELSE -1 END AS BIGINT) AS state, coalesce(c.slot, -1) AS slot FROM nodes n LEFT JOIN candidates c ON c.node = n.node",
    "embedding_table": "SELECT n.node, CAST(CASE WHEN c.slot IS NULL THEN -3 ELSE -2 END AS BIGINT) AS state, coalesce(c.slot, -1) AS slot FROM nodes n LEFT JOIN candidates c ON c.node = n.node",
    "feature_cache_hits": "SELECT batch, count(*) AS accesses, count(*) FILTER (WHERE hit) AS hits FROM access GROUP BY batch",
    "emb_cache_actions": "SELECT batch, node, action FROM fold",
    "emb_pull_locf": "SELECT batch, node, last AS source FROM fold WHERE action = 'pull'",
    "sage_mean": "SELECT batch, node, pos, round(mean, 6) AS value FROM means",
    "sage_layer": "SELECT batch, node, pos, round(y, 6) AS value FROM layer",
    "relu": "SELECT batch, node, pos, round(greatest(y, 0.0), 6) AS value FROM layer",
    "log_softmax": "SELECT batch, node, pos, round(logp, 6) AS value FROM logp",
    "nll_loss": "SELECT p.batch, round(avg(-p.logp), 6) AS loss FROM logp p JOIN features f ON f.node = p.node AND f.label = p.pos GROUP BY p.batch",
    "accuracy": "SELECT count(*) FILTER (WHERE b.pos = f.label) AS correct, count(*) AS total, round(count(*) FILTER (WHERE b.pos = f.label) / nullif(count(*), 0), 6) AS accuracy FROM best b JOIN features f ON f.node = b.node",
}


def oracle_sql() -> dict[str, str]:
    found = {name: f"WITH RECURSIVE {_needed(text)}\n{text}" for name, text in STATEMENTS.items()}
    return found | {"fennel": _fennel(1), "fennel_refine": _fennel(2), "fennel_two_level": _fennel_two_level()}
