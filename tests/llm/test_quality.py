"""The ledger against a plain count of each measure."""

from __future__ import annotations

import random
import re
from collections import Counter

from graphspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_exclamations": text.count("!")}


def texts(odd, prose):
    rng = random.Random(3)
    made = odd + [" ".join(prose(rng.randint(1, 400), k, rng.choice([5, 40, 3000]))) for k in range(60)]
    made += ["\n".join(rng.choice(["a b c", "a b c ", "", " \r", "x # y"]) for _ in range(40)), "go " * 5000, "one two three one two three", "a a a", "a a a a", "!! " * 60, "$$ *** " * 80]
    return made


def test_measures_equal_plain_counts(make_docs, odd, prose, monkeypatch):
    made = texts(odd, prose)
    docs = make_docs(made, clash=True)
    for bits in (20, 6):  # with few bits for places, the slower way for long texts runs too
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        rows = {x.doc_id: x for x in quality.ledger(docs).collect()}
        assert len(rows) == len(made)
        for k, text in enumerate(made):
            assert {x: rows[k][x] for x in quality.MEASURES} == brute(text), (bits, text)


def test_policies_and_ablations(make_docs, odd, prose):
    entries = quality.ledger(make_docs(texts(odd, prose)))
    rows = entries.collect()
    for policy in quality.POLICIES:
        kept = {x.doc_id for x in quality.apply_policy(entries, policy).where("kept").collect()}
        assert kept == {x.doc_id for x in rows if not x.failed & quality.mask(policy)}
        names = [name for name, _ in quality.RULES]
        for x in quality.ablations(entries, policy).collect():
            bit = 1 << names.index(x.rule)
            assert x.n_failed == sum(bool(y.failed & bit) for y in rows)
            assert x.n_only == sum(y.failed & quality.mask(policy) == bit for y in rows)


def test_clean_text_stays_and_empty_table(make_docs, prose):
    clean = ". ".join(" ".join(prose(12, k, 900)).capitalize() for k in range(20))
    assert [x.kept for x in quality.apply_policy(quality.ledger(make_docs([clean, clean]))).collect()] == [True, True]
    assert quality.ledger(make_docs([])).collect() == []
