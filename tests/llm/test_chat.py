"""Round trips of formatted conversations."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspark.llm.chat import END, START, Template, escape, escape_role, format_chats, read_back, unescape, unescape_role

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def template():
    return Template(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\n\nim_startend> aé"))
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def test_turn_masks_and_marks(template):
    ids, loss = template.turn("assistant", f"a{START}b{END}")
    assert list(np.flatnonzero(ids >= template.start)) == [0, int(np.flatnonzero(ids == template.end)[0])]
    assert unescape(template.encoding.decode(ids[loss == 1].tolist())) == f"a{START}b{END}"
    assert not template.turn("user", "hello")[1].any()
    assert list(template.read(ids)) == [("assistant", f"a{START}b{END}")]


def test_digests_equal_the_input(spark, odd):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|x"]), rng.choice(odd)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant", f"turn {t}") for t in range(700)] + [(None, 0, "user", "x"), (50, None, "user", "null turn"), (50, 1, "assistant", "z"), (50, 1, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS ids", "1 AS seq").repartition(5)
    got = {x.conv_id: x for x in read_back(format_chats(table, PATH), PATH).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(f"{START}{escape_role(r)}\n{escape(x)}{END}\n") for _, r, x in turns)
    assert format_chats(table.where("false"), PATH).collect() == []


def test_offsets_follow_one_another(spark):
    table = spark.createDataFrame([(1, t, "user", "word " * t) for t in range(6)], "conv_id long, turn long, role string, text string")
    rows = sorted(format_chats(table, PATH).collect(), key=lambda x: x.seq)
    assert [x.first_id for x in rows] == [sum(len(y.ids) for y in rows[:k]) for k in range(6)]
