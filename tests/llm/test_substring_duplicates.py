"""Repeated windows against a count of all windows; the index against plain search."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from graphspark.llm import substring_duplicates as sd
from graphspark.llm.fm_index import FMIndex, WaveletTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(docs):
    return sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in sd.without_repeats(docs).collect()), key=str)


def cases(odd, prose):
    rng = random.Random(21)
    passages = [prose(rng.randint(30, 90), k, 3000) for k in range(12)]
    rows = list(odd)
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += prose(rng.randint(0, 60), 1000 + rng.randint(0, 10**6), 3000)
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                parts += p[a : len(p) - rng.randint(0, 10)]
        rows.append(rng.choice([" ", "\n", "  "]).join(parts))
    rows += ["go " * 34, "go " * 35, "go " * 36, "la li " * 40, " ".join(passages[0]), " ".join(passages[0])] + [rows[-1]] * 30
    return list(enumerate(rows))


def test_equal_to_brute_force(make_docs, odd, prose):
    rows = cases(odd, prose)
    assert result(make_docs(rows, clash=True)) == brute(rows)


def test_split_anchors_and_many_shards(make_docs, odd, prose, monkeypatch):
    monkeypatch.setattr(sd, "SPLIT_SEGMENTS", 3)
    monkeypatch.setattr(sd, "SHARD_PLACES", 500)
    rows = cases(odd, prose)
    assert result(make_docs(rows)) == brute(rows)


def test_repeated_rows_null_ids_and_empty(make_docs, prose):
    text = " ".join(prose(50, 1, 3000))
    rows = [(1, text), (1, text), (None, text), (2, " ".join(prose(80, 2, 3000))), (2, "short"), (None, None)]
    assert result(make_docs(rows)) == brute(rows)
    alone = [(1, text), (2, None)]
    assert [x[2] for x in result(make_docs(alone))] == [0, 0]
    assert result(make_docs([])) == []


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 6, 3000)
    text[::50] = 0
    weights = np.repeat(rng.integers(1, 3, 60), 50)  # one weight per string
    index = FMIndex(text, 6, 7, weights)
    weight_of = Counter()
    for k in range(len(text)):
        for n in range(1, 8):
            if k + n <= len(text) and (text[k : k + n] > 0).all():
                weight_of[tuple(text[k : k + n])] += weights[k]
    for least in (2, 3):
        want = [max([n for n in range(1, 8) if k - n + 1 >= 0 and (text[k - n + 1 : k + 1] > 0).all() and weight_of[tuple(text[k - n + 1 : k + 1])] >= least], default=0) for k in range(len(text))]
        assert index.matching_statistics(text, np.arange(len(text)), 7, least).tolist() == want
    tree = WaveletTree(text, 6)
    at = rng.integers(0, len(text) + 1, 200)
    symbol = rng.integers(0, 6, 200)
    assert tree.rank(at, symbol).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, symbol)]


def test_a_very_long_text(make_docs, prose):
    """Some megabytes with a passage twice, once in another document."""
    words, passage = prose(300_000, 6, 50_000), prose(40, 7, 3000)
    text = " ".join([*words[:1000], *passage, *words[1000:], *passage])
    rows = [(1, text), (2, "x " + " ".join(passage) + " y")]
    assert result(make_docs(rows)) == brute(rows)
