"""Wu-Manber search against brute force over all windows."""

from __future__ import annotations

import random
import re

import numpy as np

from graphspark.llm.decontamination import WuManber, decontaminate, uncontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        m = min(10, len(own))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else set()
        for k in range(len(w) - m + 1 if m else 0):
            if tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found) if True else None


def test_engine_finds_every_occurrence():
    rng = np.random.default_rng(2)
    for length in (1, 2, 3, 10):
        patterns = np.unique(rng.integers(1, 4, (30, length)).astype(np.int32), axis=0)
        text = rng.integers(0, 4, 3000).astype(np.int32)
        counts = np.array([700, 0, 5, 1295, 1000])
        starts = np.cumsum(counts) - counts
        got = sorted(zip(*(x.tolist() for x in WuManber(patterns, 3).search(text, starts, counts))))
        want = sorted((e, p) for s, c in zip(starts, counts) for e in range(s + length - 1, s + c) for p in range(len(patterns)) if (text[e - length + 1 : e + 1] == patterns[p]).all())
        assert got == want


def test_equals_brute_force_in_one_block_and_in_many(spark, make_docs, odd, prose):
    rng = random.Random(1)
    items = [(k, " ".join(prose(rng.choice([1, 3, 9, 10, 14, 30]), k, 30))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (None, "lost"), (3, "same id again here"), (15, "ÉTÉ école")]
    texts = odd + [" ".join(prose(60, 100 + k, 30)) for k in range(20)]
    texts += [f"{' '.join(prose(8, k))}, {rng.choice(items[:12])[1].upper()}! {' '.join(prose(8, k))}" for k in range(30)] + ["École ÉTÉ école", "x ÉTÉ école y"]
    texts.append(" ".join(prose(5000, 4, 30)))
    docs = make_docs(texts, clash=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    for limit in (1 << 20, 200):
        rows = {x.doc_id: x for x in decontaminate(docs, benchmark, limit=limit).collect()}
        assert len(rows) == len(texts)
        for k, text in enumerate(texts):
            assert (rows[k].n_words, rows[k].n_hit, rows[k]["items"]) == brute(text, known), text
            assert rows[k].contaminated == (rows[k].n_hit > 0) and rows[k].n_items == len(rows[k]["items"])


def test_more_blocks_than_kept_tables_in_one_stage(spark, make_docs, prose):
    """Twelve blocks: one Python stage; rows without an id are judged by their text."""
    items = [(k, " ".join(prose(12, 900 + k, 3000))) for k in range(40)]
    texts = [f"a b {items[k % 40][1]} c" if k % 3 else " ".join(prose(30, k, 3000)) for k in range(60)]
    docs = make_docs([(None if k % 5 == 0 else k, t) for k, t in enumerate(texts)], clash=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    limit = sum(len(t) for _, t in items) // 12
    found = decontaminate(docs, benchmark, limit=limit)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((x.n_words, x.n_hit, tuple(x["items"])) for x in found.collect()) == sorted((n, h, tuple(i)) for n, h, i in (brute(t, items) for t in texts))
    kept = uncontaminated(docs, benchmark, limit=limit)
    assert kept.columns == docs.columns
    assert sorted(x.text for x in kept.collect()) == sorted(t for t in texts if not brute(t, items)[1])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(make_docs([]), none).collect() == []
    assert [x.n_hit for x in decontaminate(make_docs(["a b", None]), none).collect()] == [0, 0]
