"""Held-out accuracy, rejection and odd texts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from graphspark.llm.language import CENTROIDS, ROUNDS, SLACK, UNKNOWN, drawn, fit, has_letter, identify, rejecting

SYLLABLES = {"aa": ["the", "ing", "and", "tion", "er"], "bb": ["der", "sch", "ung", "ein", "keit"], "cc": ["ción", "que", "los", "mente", "ña"]}


def corpus(n=240):
    rng, rows, langs = random.Random(9), [], {}
    for k in range(n):
        lang = rng.choice([*SYLLABLES])
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 120)))
        rows.append((k, text))
        langs[k] = lang
    return rows, langs


def test_held_out_accuracy(make_docs):
    rows, langs = corpus()
    docs = make_docs(rows, langs, clash=True)
    found = identify(docs, fit(docs)).collect()
    assert len(found) == len(rows)
    held = [x for x in found if x.held_out]
    assert {x.doc_id for x in held} == {k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(x.lang_pred == langs[x.doc_id] for x in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in found)
    assert sum(x.rejected for x in found) <= 0.01 * len(found)


def test_label_source_and_id_are_no_inputs(make_docs):
    rows, langs = corpus(120)
    model = fit(make_docs(rows, langs))
    first = {x.doc_id: x.lang_pred for x in identify(make_docs(rows, langs), model).collect()}
    moved = {x.doc_id - 1000: x.lang_pred for x in identify(make_docs([(k + 1000, t) for k, t in rows]), model).collect()}
    assert first == moved


def test_unknown_rejected_and_far_texts(make_docs, odd):
    rows, langs = corpus(120)
    model = fit(make_docs(rows, langs))
    far = "zzxq " * 300
    texts = odd + [far, rows[0][1]]
    found = {x.doc_id: x for x in identify(make_docs(texts), model).collect()}
    for k, text in enumerate(texts):
        letter = any(c.isalpha() for c in text or "")
        assert has_letter((text or "").encode()) == letter
        assert (found[k].lang_pred == UNKNOWN) == (not letter)
        assert found[k].rejected or letter
    assert found[len(odd)].rejected and not found[len(odd) + 1].rejected
    docs = make_docs(texts, clash=True)
    kept = rejecting(docs, model)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, x in found.items() if not x.rejected}


def test_without_labels_and_empty(make_docs):
    assert fit(make_docs([(1, "a b"), (None, "c")])) is None
    assert {x.lang_pred for x in identify(make_docs(["abc", None]), None).collect()} == {UNKNOWN}
    assert identify(make_docs([]), None).collect() == []


def grams(text):
    """Counts of the hashed letter trigrams of a text."""
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    raw = b" " + b" ".join(bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in raw).split()) + b" "
    return Counter(((a * 65536 + b * 256 + c) * 2654435761 % 2**32) >> 19 for a, b, c in zip(raw, raw[1:], raw[2:]))


def plain_classifier(train):
    """Nearest centroids over dictionaries: what a text's language, cosine and rejection are. ``train``: (id, lang, text)."""
    known = [(lang, doc, grams(t)) for doc, lang, t in sorted(train, key=lambda x: (x[1], x[0])) if any(c.isalpha() for c in t)]
    langs = sorted({x[0] for x in known})
    own = {a: [g for x, _, g in known if x == a] for a in langs}
    share = Counter()
    for made in own.values():
        for g in made:
            for d in g:
                share[d] += 1 / len(made)
    idf = lambda d: np.log(1 + len(langs) / (share[d] + 1 / 600))

    def unit(x):
        size = sum(v * v for v in x.values()) ** 0.5
        return {d: v / size for d, v in x.items()} if size else {}

    vector = lambda g: unit({d: n**0.5 * idf(d) for d, n in g.items()})
    dot = lambda x, y: sum(v * y.get(d, 0.0) for d, v in x.items())
    add = lambda xs: {d: v for d, v in sum(map(Counter, xs), Counter()).items()}
    centroids, seen = [], []
    for a in langs:
        vs = [vector(g) for g in own[a]]
        mean = add(vs)
        chosen = [max(range(len(vs)), key=lambda k: dot(vs[k], mean))]  # noqa: B023
        while len(chosen) < min(CENTROIDS, len(vs)):
            chosen.append(min(range(len(vs)), key=lambda k: max(dot(vs[k], vs[c]) for c in chosen)))  # noqa: B023
        made = [vs[k] for k in chosen]
        for _ in range(ROUNDS):
            place = [max(range(len(made)), key=lambda j: dot(v, made[j])) for v in vs]
            made = [unit(add([v for v, p in zip(vs, place) if p == j])) if j in place else made[j] for j in range(len(made))]
        centroids += [(a, c) for c in made]
        seen += [(int(np.log2(sum(g.values()) + 1)), max(dot(v, c) for c in made)) for g, v in zip(own[a], vs)]
    least = [0.0]
    for size in range(1, 40):
        found = [x for n, x in seen if n == size]
        least.append(SLACK * min(found) if len(found) >= 20 else least[-1])

    def predict(text):
        g = grams(text or "")
        if not any(c.isalpha() for c in text or ""):
            return UNKNOWN, 0.0, 0.0, True
        v = vector(g)
        cosines = sorted(((dot(v, c), a) for a, c in centroids), reverse=True)
        best = {a: max(x for x, b in cosines if b == a) for a in langs}
        top = max(best.values())
        margin = top - max([x for a, x in best.items() if x < top] or [0.0])
        bound = least[min(int(np.log2(sum(g.values()) + 1)), 39)]
        return max(best, key=best.get), top, min(margin, abs(top - bound)), top < bound

    return predict


def test_equals_a_plain_classifier(make_docs, odd):
    rows, langs = corpus(150)
    rows = [*rows, *((1000 + k, t) for k, t in enumerate(odd))]
    docs = make_docs(rows, langs)
    predict = plain_classifier([(k, langs[k], t) for k, t in rows if k in langs and zlib.crc32(str(k).encode()) % 3 != 1])
    text, close = dict(rows), 0
    for x in identify(docs, fit(docs)).collect():
        lang, cosine, margin, rejected = predict(text[x.doc_id])
        assert abs(x.score - cosine) < 1e-4
        close += margin < 1e-4 and lang != UNKNOWN
        assert margin < 1e-4 or (x.lang_pred, x.rejected) == (lang, rejected)
    assert close <= 3


def test_ties_of_cosines_go_to_the_first_language(make_docs):
    """Two languages of the same texts have the same centroids."""
    texts = [" ".join(["abc", "def", "ghi", "jkl"][k % 4 :]) for k in range(12)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts])]
    docs = make_docs(rows, {k: "zz" if k < 12 else "aa" for k, _ in rows})
    model = fit(make_docs([(3 * 10**6 + k, t) for k, t in rows], {3 * 10**6 + k: "zz" if k < 12 else "aa" for k, _ in rows}))
    model.centroids[CENTROIDS:] = model.centroids[:CENTROIDS]
    assert {x.lang_pred for x in identify(docs, model).collect()} == {"aa"}


def test_sample_is_bounded_with_one_hot_language_and_id(make_docs):
    """Most rows have one language, and most of those one id; rare languages beyond the bound aren't learned."""
    rows = [(k, f"word number {chr(97 + k % 26)} {chr(98 + k % 11) * 3}") for k in range(900)] + [(5, "word number again")] * 500 + [(2000 + k, "other words here") for k in range(30)] + [(3000, "alone")]
    langs = {k: "hot" if k < 1000 else "few" if k < 3000 else "one" for k, _ in rows}
    known = make_docs(rows, langs).select("doc_id", "lang", "text")
    found = drawn(known, 40, 2).collect()
    assert Counter(x.lang for x in found) == {"hot": 40, "few": 30}
    assert len({x.doc_id for x in found}) == 70
    assert sorted(map(tuple, found)) == sorted(map(tuple, drawn(known.repartition(7), 40, 2).collect()))


def test_very_long_texts(make_docs):
    """Ten megabytes of one language, and of marks with one letter at the end."""
    rows, langs = corpus(120)
    model = fit(make_docs(rows, langs))
    own = " ".join(t for k, t in rows if langs[k] == "aa") + " "
    found = {x.doc_id: x for x in identify(make_docs([own * (10_000_000 // len(own)), "1 . " * 2_500_000 + "z"]), model).collect()}
    assert found[0].lang_pred == "aa" and not found[0].rejected
    assert found[1].lang_pred != UNKNOWN and 0 <= found[1].score <= 1
