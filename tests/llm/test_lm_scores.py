"""Losses against a plain model, and the direction of the score."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from graphspark.llm import lm_scores as scores
from graphspark.llm.lm_scores import INNER, lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, good, entries):
    split = [(k, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for k, t in rows]
    total = sum(len(w) for _, w in split)
    every = Counter(x for _, w in split for x in w)
    vocabulary = {x for x, n in every.items() if n * entries >= total and len(x.encode()) <= 48}
    pairs = Counter(p for _, w in split for p in zip(w, w[1:]) if p[0] in vocabulary and p[1] in vocabulary)
    pairs = {p for p, n in pairs.items() if n * entries >= total}
    losses = []
    for own in ([w for k, w in split if k in good], [w for _, w in split]):
        size = sum(map(len, own))
        one = Counter(x if x in vocabulary else None for w in own for x in w)
        two = Counter(p for w in own for p in zip(w, w[1:]))
        single = lambda x: (one[x if x in vocabulary else None] + 1) / (size + len(vocabulary) + 1)  # noqa: B023, E731

        def loss(w):
            out = []
            for k, x in enumerate(w):
                p = single(x) * (1 if k == 0 else 1 - INNER)  # noqa: B023
                if k and (w[k - 1], x) in pairs and one[w[k - 1]]:  # noqa: B023
                    p += INNER * two[w[k - 1], x] / one[w[k - 1]]  # noqa: B023
                out.append(-math.log(p))
            return sum(out) / len(out) if out else None

        losses.append([loss(w) for _, w in split])
    return {k: (len(w), a, b) for (k, w), a, b in zip(split, *losses)}


@pytest.mark.parametrize("entries", [1 << 20, 300, 40])
def test_equal_to_a_plain_model(spark, make_docs, odd, prose, entries):
    texts = odd + [" ".join(prose(80, k, 60)) for k in range(40)] + ["Word " * 500, "x" * 100 + " y"]
    good = {k for k in range(len(odd), len(odd) + 20)}
    targets = spark.createDataFrame([(k,) for k in [*good, *good]] + [(None,), (10**6,)], "doc_id long")
    want = brute(list(enumerate(texts)), good, entries)
    rows = lm_scores(make_docs(texts, clash=True), targets, entries).collect()
    assert len(rows) == len(texts)
    for x in rows:
        n, a, b = want[x.doc_id]
        assert x.n_words == n
        if n:
            assert x.target_loss == pytest.approx(a, abs=1e-9) and x.background_loss == pytest.approx(b, abs=1e-9) and x.score == pytest.approx(a - b, abs=1e-9)
        else:
            assert x.target_loss is None and x.score is None


def test_target_like_texts_score_lower(spark, make_docs, prose):
    good, bad = [" ".join(prose(60, k, 30)) for k in range(30)], [" ".join(prose(60, 1000 + k, 3000)) for k in range(30)]
    docs = make_docs(good + bad)
    rows = {x.doc_id: x.score for x in lm_scores(docs, spark.createDataFrame([(k,) for k in range(15)], "doc_id long")).collect()}
    assert max(rows[k] for k in range(15)) < min(rows[k] for k in range(30, 60))


def test_no_targets_and_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scores(make_docs([]), none).collect() == []
    assert [x.n_words for x in lm_scores(make_docs(["a b", None]), none).collect()] == [2, 0]


def test_rare_words_and_bigrams_belong_to_the_model(spark, make_docs, odd, prose, monkeypatch):
    """Few words are frequent here; losses are those of the model that is not cut."""
    monkeypatch.setattr(scores, "ENTRIES", 60)
    texts = odd + [" ".join(prose(80, k % 30, 60) + prose(20, 7, 9000)[k % 20 :]) for k in range(40)] + ["Word " * 500, "x" * 100 + " y", "once"]
    good = {k for k in range(len(odd), len(odd) + 20)}
    rows = list(enumerate(texts))
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    one, two = Counter(x for w in words for x in w), Counter(p for w in words for p in zip(w, w[1:]))
    own, own_two = Counter(x for k in good for x in words[k]), Counter(p for k in good for p in zip(words[k], words[k][1:]))

    def loss(w, n, pairs):
        p = [(n[x] + 1) / (n.total() + len(one) + 1) for x in w]
        p[1:] = [(1 - INNER) * q + (INNER * pairs[a, b] / n[a] if n[a] else 0) for q, a, b in zip(p[1:], w, w[1:])]
        return sum(-math.log(q) for q in p) / len(w)

    targets = spark.createDataFrame([(k,) for k in good], "doc_id long")
    found = lm_scores(make_docs([*rows, rows[20]], clash=True), targets).collect()
    one, two = one + Counter(words[20]), two + Counter(zip(words[20], words[20][1:]))
    own, own_two = own + Counter(words[20]), own_two + Counter(zip(words[20], words[20][1:]))
    assert sorted(x.doc_id for x in found) == sorted([*range(len(texts)), 20])
    for x in found:
        w = words[x.doc_id]
        assert x.n_words == len(w)
        if w:
            assert x.target_loss == pytest.approx(loss(w, own, own_two), abs=1e-9) and x.background_loss == pytest.approx(loss(w, one, two), abs=1e-9)
        else:
            assert x.target_loss is None and x.score is None
