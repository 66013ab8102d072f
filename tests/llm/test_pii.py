"""Personal data: the base against plain regular expressions, the method on planted contexts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from graphspark.llm.common import staged
from graphspark.llm.pii import entities, find_personal_data, masked, occurrences

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(x):
    return [int(c) for c in x if c in "0123456789"]


def passes(kind, x):
    d = digits(x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(y if k % 2 == 0 else sum(divmod(2 * y, 10)) for k, y in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, p in BASE.items() for m in p.finditer(text or "") if passes(kind, m.group())]


def spans(rows, column):
    return [[tuple(s) for s in x[column]] for x in rows]


def test_base_equals_plain_expressions(make_docs, odd):
    rng = random.Random(5)
    alphabet = list("ab.@-_+ ()\n") + [str(k) for k in range(10)] * 2 + ["4111 1111 1111 1111", "10.0.0.255", "256.1.1.1", "+1 (555) 123-4567", "x@y.z", "é", "🙂", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8"]
    texts = odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(600)] + ["9" * 30_000, "a." * 20_000, "1 " * 3000, "4111111111111111 " * 500]
    rows = {x.doc_id: x for x in find_personal_data(make_docs(texts, clash=True)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        assert [tuple(s) for s in rows[k].base] == brute(text), text


def test_contexts_lead_to_unseen_identifiers(make_docs, prose):
    texts = [f"{' '.join(prose(20, k))} reach me: user{k}@mail.org {' '.join(prose(9, k))}" for k in range(8)]
    texts += [f"{' '.join(prose(15, 50 + k))} Reach me: handle#77{k}1 and more" for k in range(3)]
    # the same words before plain words are no pattern
    texts += [f"lot number 5544{k} of the {x}" for k, x in enumerate(["user9@mail.org", "day", "week", "year", "house", "case55", "town", "river", "road", "sea"])]
    rows = {x.doc_id: x for x in find_personal_data(make_docs(texts)).collect()}
    for k in range(8, 11):
        at = texts[k].index("handle#")
        assert [tuple(s) for s in rows[k].added] == [("id", at, at + len("handle#771" if False else f"handle#77{k - 8}1"))]
    assert all(not rows[k].added for k in range(11, len(texts)))
    assert all(not rows[k].added and len(rows[k].base) == 1 for k in range(8))


def test_empty_table_repeats_and_null_ids(make_docs):
    assert find_personal_data(make_docs([])).collect() == []
    rows = find_personal_data(make_docs([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (1, "none")])).collect()
    assert sorted(len(x.base) for x in rows) == [0, 1, 1, 1]


def test_masking_keeps_columns_and_replaces_spans(make_docs):
    docs = make_docs(["write a@b.cd or +1 (555) 123-4567 now", None, "4111 1111 1111 1111", "clean", "+4111 1111 1111 1111 x"], clash=True)
    out = masked(docs, find_personal_data(docs))
    assert out.columns == docs.columns
    text = {x.doc_id: x.text for x in out.collect()}
    assert text[0] == "write <email> or <phone> now"
    assert text[1] is None and text[2] == "<card>" and text[3] == "clean"
    assert "1111" not in text[4]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_method(texts):
    """Added spans of each text, by the rule told in the module: dictionaries and one pass after another."""
    words = [[(m.start(), m.group()) for m in WORD.finditer(t or "")] for t in texts]
    seen = []  # (text, start, end, value, context, seed)
    for k, text in enumerate(texts):
        base = [(a, b) for _, a, b in brute(text)]
        tokens = [(a, a + len(w)) for a, w in words[k] if re.search("[0-9]", w) and len(w) >= 5 and not any(x < a + len(w) and a < y for x, y in base)]
        for (a, b), seed in [(x, True) for x in base] + [(x, False) for x in tokens]:
            j = max(n for n, (start, _) in enumerate(words[k]) if start <= a)
            if j >= 2:
                seen.append((k, a, b, text[a:b].lower(), (words[k][j - 2][1].lower(), words[k][j - 1][1].lower()), seed))
    edges = {}
    for *_, value, context, seed in seen:
        edges.setdefault(context, {})[value] = edges.get(context, {}).get(value, False) or seed
    slots = {c: x for c, x in edges.items() if len(x) >= 3}
    followed = lambda only: Counter((w[i][1].lower(), w[i + 1][1].lower()) for w, t in zip(words, texts) if not only or re.search("[0-9]", t or "") for i in range(len(w) - 2) if not re.search("[0-9]", w[i + 2][1]))
    near, every = followed(True), followed(False)
    slots = {c: x for c, x in slots.items() if len(x) >= 0.6 * (len(x) + near[c])}
    belief = {v: 0.0 for x in slots.values() for v in x}
    for x in slots.values():
        for v, seed in x.items():
            belief[v] = max(belief[v], float(seed))
    seeds = {v for v, b in belief.items() if b}
    score = {}
    for _ in range(3):
        score = {c: sum(belief[v] for v in x) / (len(x) + every[c]) if sum(belief[v] >= 0.6 for v in x) >= 3 else 0.0 for c, x in slots.items()}
        doubt = {}
        for c, x in slots.items():
            for v in x:
                doubt[v] = doubt.get(v, 0.0) + math.log(max(1 - score[c], 1e-9))
        belief = {v: 1.0 if v in seeds else 1 - math.exp(d) for v, d in doubt.items()}
    return [sorted({("id", a, b) for n, a, b, _, c, seed in seen if n == k and not seed and score.get(c, 0) >= 0.6}) for k in range(len(texts))]


def test_method_equals_a_plain_version(make_docs, odd, prose):
    rng = random.Random(8)
    kinds = [lambda: f"u{rng.randint(0, 40)}@mail.org", lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"acct{rng.randint(100, 160)}", lambda: f"{rng.randint(10000, 10050)}", lambda: rng.choice(["river", "stone", "(a9b8c,"]), lambda: "+1 555 123 45" + str(rng.randint(10, 30))]
    heads = ["write to:", "my account", "call 77123", "see 12345 67890", "Kept  at", "an old", "for the"]
    texts = list(odd)
    for k in range(160):
        text = " ".join(prose(rng.randint(0, 6), k, 50))
        for _ in range(rng.randint(1, 4)):
            head = rng.randrange(len(heads))
            kind = kinds[head % 4 if rng.random() < 0.8 else rng.randrange(len(kinds))]
            text += f"{rng.choice([' ', chr(10), '. '])}{heads[head]}{rng.choice([' ', '  ', ' x:', chr(9)])}{kind()}"
        texts.append(text)
    want = plain_method(texts)
    rows = {x.doc_id: x for x in find_personal_data(make_docs(texts)).collect()}
    assert {k: [tuple(s) for s in x.added] for k, x in rows.items()} == dict(enumerate(want))
    assert sum(map(len, want)) > 10


def test_two_words_before_an_identifier_are_its_context(make_docs):
    """Words with digits, long words and earlier matches are words like any other; a chain in one word has one context."""
    texts = ["my key 1234 5678 ABC99x", "call 1 22222 333333", f"a {'x' * 70} y 77881", f"{'z' * 90} y 77881", "one two 1.1.1.1,2.2.2.2,3.3.3.3", "ip 1.1.1.1", "mark ﷐ a1b2c3"]
    seen = occurrences(staged(entities(make_docs(texts)), "entities")).collect()
    spans = {(x.doc_id, texts[x.doc_id][x.start : x.end]): x.context for x in seen}
    assert set(spans) == {(0, "ABC99x"), (1, "22222"), (1, "333333"), (2, "77881"), (3, "77881"), (4, "1.1.1.1"), (4, "2.2.2.2"), (4, "3.3.3.3"), (6, "a1b2c3")}
    assert spans[2, "77881"] != spans[3, "77881"] and len({c for (k, _), c in spans.items() if k == 4}) == 1
    again = occurrences(staged(entities(make_docs(["other text 5678 ABC99x", "MY KEY 99999"])), "entities")).collect()
    assert {x.context for x in again if x.value == "abc99x"} != {spans[0, "ABC99x"]}


def test_masking_of_very_many_spans(make_docs):
    """More spans than one piece of text holds, some over each other."""
    rng = random.Random(3)
    text = "".join(rng.choice(["a@b.cd ", "10.1.1.1 ", "+4111 1111 1111 1111 ", "plain é ", "\n"]) for _ in range(3000))
    docs = make_docs([text, "é a@b.cd"])
    out, cut, last = {x.doc_id: x.text for x in masked(docs, find_personal_data(docs)).collect()}, [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in brute(text)):
        if max(a, last) < b:
            cut += [text[last : max(a, last)], f"<{kind}>"]
            last = b
    assert out == {0: "".join(cut) + text[last:], 1: "é <email>"}
