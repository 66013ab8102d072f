"""Token counts and packing against the library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphspark.llm.packing import combinations, nnls_counts, pack, pack_lengths
from graphspark.llm.token_counts import token_counts

COUNTS, PACKED = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(odd, prose):
    rng = random.Random(8)
    pieces = list("abAB éÉİıſŉ×÷.,!?'<|>\n\t  ΣςßŸ１٣漢🙂\x1c\x85") + ["<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", " the", " Hello.", "×.", "İ.", "é.", "é", " ́x", " ", "    "]
    made = odd + ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(800)]
    return made + [" ".join(prose(rng.randint(1, 300), k)) for k in range(60)] + [" ".join(prose(9000, 4)), "x" * 30_000, "word " * 4095]


def test_counts_equal_the_library(make_docs, texts):
    library = Tokenizer.from_file(COUNTS)
    rows = {x.doc_id: x for x in token_counts(make_docs(texts, clash=True), COUNTS).collect()}
    assert len(rows) == len(texts)
    for k, x in enumerate(texts):
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((x or "").encode()), n, n > 512), x
    assert token_counts(make_docs([]), COUNTS).collect() == []


def check_packing(rows, ids, window):
    """Every id in exactly one piece, sequences gapless and within the window."""
    seen, sequences = {}, {}
    for x in rows:
        own = ids[x.doc_id]
        assert x.doc_tokens == len(own) and 1 <= x.length <= window
        assert x.ids_crc32 == zlib.crc32(own[x.start : x.start + x.length].tobytes())
        seen.setdefault(x.doc_id, []).append((x.start, x.length))
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(seen) == set(ids)
    for k, spans in seen.items():
        assert [s for s, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) == len(ids[k])
    for spans in sequences.values():
        spans.sort()
        assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= window
    return len(sequences)


def test_packing_is_exact(make_docs, texts):
    library = Tokenizer.from_file(PACKED)
    ids = {k: np.array([*library.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for k, x in enumerate(texts)}
    docs = make_docs(texts, clash=True)
    n = check_packing(pack(docs, PACKED).collect(), ids, 4096)
    assert n == -(-sum(map(len, ids.values())) // 4096)
    check_packing(pack(docs, PACKED, group_docs=100).collect(), ids, 4096)
    assert pack(make_docs([]), PACKED).collect() == []
    assert len(pack(make_docs([(None, "a"), (1, "a"), (1, "a")]), PACKED).collect()) == 3


def test_lengths_pack_tightly():
    rng = np.random.default_rng(6)
    sizes = np.minimum(rng.lognormal(6, 1, 6000).astype(np.int64) + 1, 4096)
    sequence, offset = pack_lengths(sizes)
    used = np.bincount(sequence, weights=sizes)
    assert used.max() <= 4096 and len(used) <= 1.005 * sizes.sum() / 4096 + 1
    for s in range(0, len(used), 50):
        mine = np.argsort(offset[sequence == s])
        assert offset[sequence == s][mine].tolist() == np.cumsum([0, *sizes[sequence == s][mine]])[:-1].tolist()
    for same in (np.full(100, 4096), np.full(100, 1), np.full(100, 3000), np.empty(0, np.int64)):
        sequence, _ = pack_lengths(same)
        assert len(np.unique(sequence)) == (len(same) if len(same) and same[0] > 2048 else min(1, len(same)))


def test_least_squares_meets_a_histogram():
    lengths, counts = np.array([1000, 1024, 1500, 2072, 2596]), np.array([30, 40, 10, 10, 10])
    found = combinations(lengths, counts)
    assert found and all(sum(x) <= 4096 for x in found)
    x = nnls_counts(found, lengths, counts, passes=200)
    assert (x >= 0).all()
    made = np.zeros(5)
    for n, combination in zip(x, found):
        for length in combination:
            made[np.flatnonzero(lengths == length)[0]] += n
    assert np.abs(made - counts).sum() < counts.sum()
