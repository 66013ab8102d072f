"""Small tables of documents for the operators' tests."""

from __future__ import annotations

import random

import pytest

#: Columns as the operators make them inside, to see that they don't clash.
CLASHES = ("n_words", "band", "rep", "anchor", "target", "kept", "spans", "row_key", "value", "items")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, lang=None, clash=False):
        """Rows (doc_id, text) or texts; ids by place."""
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        rows = [(*x, (lang or {}).get(x[0]), "src", len(x[1] or "")) for x in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            for name in CLASHES:
                docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs

    return make


@pytest.fixture(scope="session")
def prose():
    def words(n, seed, size=400):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 9))) for _ in range(size)]
        return [rng.choice(vocabulary) for _ in range(n)]

    return words


#: Nulls, blanks, odd letters, control characters and ends of lines.
ODD = [None, "", " \t\n\r\x0b\x0c ", "x", "1234", "É é İ ß 漢字 🙂", "a\x1cb\x85c d", "<|im_end|><|endoftext|>", "\\ <\\| <| |>", "+", "@", "a@b", "...", "\n\n\na\n"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
