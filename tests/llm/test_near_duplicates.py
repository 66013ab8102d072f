"""Components against all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np

import corpus_pipeline
from graphspark.llm import near_duplicates as nd
from graphspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def brute(rows, percent=85):
    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if a is not None and b is not None and both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(s), find(k)) for k, s in sets if k is not None}


def edited(words, share, rng):
    return [rng.choice("abcdefgh") + x if rng.random() < share else x for x in words]


def test_equal_to_all_pairs(make_docs, odd, prose):
    rng = random.Random(11)
    texts = odd + ["one two", "One Two", "one two three", "a b c d e", "A b c d E"]
    for g in range(12):
        base = prose(rng.randint(30, 160), 200 + g, 2000)
        texts += [" ".join(edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]), rng)) for _ in range(rng.randint(2, 12))]
    # one large group whose members are often just too far apart
    base = prose(150, 77, 2000)
    texts += [" ".join(edited(base, rng.uniform(0.005, 0.03), rng)) for _ in range(150)] + [" ".join(base)] * 20
    passage = " ".join(prose(60, 78, 2000))
    texts += [f"{' '.join(prose(rng.randint(5, 60), 300 + k, 2000))} {passage} {' '.join(prose(rng.randint(5, 60), 500 + k, 2000))}" for k in range(60)]
    rng.shuffle(texts)
    want = brute(list(enumerate(texts)))
    got = {x.doc_id: x for x in nd.near_duplicates(make_docs(texts, clash=True)).collect()}
    assert len(got) == len(texts)
    assert {k: (x.n_shingles, x.component_id) for k, x in got.items()} == want
    assert all(x.kept == (k == x.component_id) for k, x in got.items())


def test_blocks_equal_all_pairs(make_docs, prose, monkeypatch):
    """With tiny blocks, many blocks of a bucket are compared."""
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 7)
    rng = random.Random(12)
    base = prose(120, 5, 2000)
    texts = [" ".join(edited(base, rng.uniform(0.01, 0.05), rng)) for _ in range(90)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nd.near_duplicates(make_docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_estimates_and_bounds():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    x, y = np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))
    mins = nd.minima(np.concatenate([x, y]), np.array([0, len(x)]))
    words = nd.packed(mins)
    assert abs(nd.estimates(words[:1], words[1:])[0] - 0.75) < 0.13
    maps = [np.frombuffer(nd.bitmap(z), np.uint64)[None] for z in (x, y)]
    assert 900 <= nd.most_shared(*maps, np.array([len(x)]), np.array([len(y)]))[0] <= len(x)


def test_null_ids_repeats_and_empty_table(make_docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, "")]
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in nd.near_duplicates(make_docs(rows)).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 8, True), (9, 9, True)]
    assert nd.near_duplicates(make_docs([])).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(1, 1), (2, 1), (1, 2)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 7 for k in range(200, 260)) and got[7] == 7
    assert all(got[300 + k] == 300 for k in range(9)) and got[2] == got[1] == 1
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stage_links_from_four_fifths_on(spark, make_docs, prose):
    """Pairs around 0.80; those of 0.80 to 0.85 are near duplicates of the stage, not of op6."""
    texts, linked, between = [], set(), set()
    for k in range(120):
        words = prose(200, 900 + k, 20000)
        # a changed word takes five shingles from either text
        other = [f"changed{k}" if n % 40 == 20 and n // 40 < 3 + k % 3 else x for n, x in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
        x, y = map(shingles, texts[-2:])
        if 100 * len(x & y) >= 80 * len(x | y):
            linked.add(2 * k + 1)
        if 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y):
            between.add(2 * k + 1)
    assert 30 < len(between) and len(linked) < 120
    docs = make_docs(texts)
    assert {x.doc_id for x in nd.near_duplicates(docs, 80).collect() if not x.kept} == linked
    assert {x.doc_id for x in nd.near_duplicates(docs).collect() if not x.kept} == linked - between
    assert {x.doc_id for x in corpus_pipeline.near_duplicate(spark, docs, "").collect()} == set(range(240)) - linked


def test_an_id_with_several_texts_links_their_classes(make_docs, prose):
    """5 has A and B; so 7, which has A, and 3, which has B, are one component."""
    one, two, three = (" ".join(prose(40, 700 + k, 4000)) for k in range(3))
    rows = [(5, one), (7, one), (3, two), (5, two), (9, three), (9, None), (11, three)]
    got = {(x.doc_id, x.component_id, x.kept) for x in nd.near_duplicates(make_docs(rows)).collect()}
    assert got == {(5, 3, False), (7, 3, False), (3, 3, True), (9, 9, True), (11, 9, False)}


def test_very_long_texts(make_docs, prose):
    """Some megabytes each: a copy in other case, one changed word, and another text."""
    words = prose(400_000, 4, 50_000)
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words[:1000], "changed", *words[1001:]]), " ".join(prose(400_000, 5, 50_000)), "short text"]
    got = {x.doc_id: x.component_id for x in nd.near_duplicates(make_docs(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
