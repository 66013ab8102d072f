r"""Personal data: seed entities and bootstrapped contextual extraction.

Only DataFrame expressions are used. Seeds are the entities that four fixed
patterns find and a check confirms. The two words before the word in which a
seed begins are a lexical pattern; a pattern's slot is also filled by other
tokens that look like identifiers, and by plain words. Over the graph of patterns and fillers,
scores go back and forth for ``ROUNDS`` rounds, among patterns whose slots
identifiers can fill well enough at all: a pattern is as good as the share of
its slot that confident instances fill, an instance as good as its patterns
together. Identifiers in the slots of good patterns become spans of the kind
``id``; words that only sometimes precede an identifier never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256_hex, staged, table

#: The base patterns, of which the possessive forms and the
#: borders in front only keep long runs from being tried again and again.
SPACE = r"\x20\x09-\x0D"
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match that passes; saves the others the search.
NEEDED = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": "text rlike '[0-9]([ -]?[0-9]){15}'", "phone": "contains(text, '+')", "token": "text rlike '[0-9]'"}
#: A word with a digit.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
WORD = rf"[^{SPACE}]++"
SPANS = "ARRAY<STRUCT<start: INT, end: INT, m: STRING, context: BIGINT>>"
BYTE = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DIGITS = "regexp_replace(x.m, '[^0-9]+', '')"
#: What the matches of a kind (``x.m``) have to pass.
CHECKS = {
    "email": "true",
    "ip": rf"x.m RLIKE '^{BYTE}(\\.{BYTE}){{3}}$'",
    "card": f"CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substring({DIGITS}, -i, 1)) ELSE 2 * int(substring({DIGITS}, -i, 1)) - CASE WHEN int(substring({DIGITS}, -i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0 ELSE false END",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "token": "length(x.m) >= 5",
}
KINDS = ("email", "ip", "card", "phone")
#: A noncharacter that stands in front of matches while words are told apart, and what stands for a text's own.
MARK, OTHER = "\ufdd0", "\ufdd1"
#: Distinct fillers that a pattern needs, rounds, and the scores that patterns and instances need.
LEAST_FILLERS, ROUNDS, LEAST_SCORE = 3, 3, 0.6
#: Elements of an array that are folded, or cut out of one piece of text, at once.
CHUNK = 128
#: Patterns (a hash each) that may be broadcast, and rows of spans of at most so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: How two numbers from 0 on are folded.
FOLDS = {"sum": "{0} + {1}", "max": "greatest({0}, {1})"}


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def running(rows: DataFrame, columns: dict[str, str], fold: str) -> DataFrame:
    """Adds for each pair of ``columns`` (array of numbers, new name) the folds
    of each element and all before it; null for empty arrays.

    The folds are taken by chunks, so that many elements cost little more than
    in proportion. Expressions stand in separate selections and are asked for
    their size besides: an expression that is used once would be moved into the
    lambda that uses it and computed again for each element.
    """
    base, both = rows.columns, FOLDS[fold].format
    folded = lambda part: f"aggregate({part}, 0, (a, x) -> {both('a', 'x')})"
    part = lambda c: f"slice({c}, k * {CHUNK} + 1, {CHUNK})"
    upto = lambda c: f"slice({c}, i div {CHUNK} * {CHUNK} + 1, i % {CHUNK} + 1)"
    rows = rows.select(*base, *(F.expr(f"CASE WHEN size({c}) > 0 THEN transform(sequence(0, (size({c}) - 1) div {CHUNK}), k -> {folded(part(c))}) END").alias(f"c_{out}") for c, out in columns.items()))
    chunks = [f"c_{out}" for out in columns.values()]
    rows = rows.select(*base, *(F.expr(f"transform({c}, (y, k) -> {folded(f'slice({c}, 1, k)')})").alias(c) for c in chunks))
    return rows.select(*base, *(F.expr(f"CASE WHEN size(c_{out}) > 0 THEN transform({c}, (y, i) -> {both(f'c_{out}[i div {CHUNK}]', folded(upto(c)))}) END").alias(out) for c, out in columns.items()))


def _found(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds ``s_<kind>``: its matches (``start, end, m, context``), in order.

    A match's place is the sum of the lengths of all matches and gaps before
    it. ``context`` is the hash of the two whole words, in lower case, before
    the word in which the match begins, null if there are fewer.
    """
    made = lambda columns: rows.select(*rows.columns, *(F.expr(x).alias(name) for name, x in columns.items()))
    every = rows.columns
    rows = made({f"g_{k}": f"CASE WHEN {NEEDED[k]} THEN split(text, '{_escaped(p)}', -1) END" for k, p in kinds.items()} | {f"m_{k}": f"CASE WHEN {NEEDED[k]} THEN regexp_extract_all(text, '{_escaped(p)}', 0) END" for k, p in kinds.items()})
    rows = made({f"l_{k}": f"transform(m_{k}, (m, i) -> length(g_{k}[i]) + length(m))" for k in kinds})
    rows = running(rows, {f"l_{k}": f"e_{k}" for k in kinds}, "sum")
    spans = lambda k: f"transform(m_{k}, (m, i) -> named_struct('start', e_{k}[i] - length(m), 'end', e_{k}[i], 'm', m, 'i', i))"
    rows = made({f"p_{k}": f"CASE WHEN size(m_{k}) > 0 THEN filter({spans(k)}, x -> {CHECKS[k]}) END" for k in kinds})
    # the words of the text with a mark in front of each match; a word's marks are the matches that begin in it
    clean = lambda x: f"replace({x}, '{MARK}', '{OTHER}')"
    marked = lambda k: f"array_join(transform(g_{k}, (g, i) -> concat(CASE WHEN i > 0 THEN concat('{MARK}', {clean(f'm_{k}[i - 1]')}) ELSE '' END, {clean('g')})), '')"
    rows = made({f"w_{k}": f"CASE WHEN size(p_{k}) > 0 THEN regexp_extract_all({marked(k)}, '{_escaped(WORD)}', 0) END" for k in kinds})
    rows = made({f"j_{k}": f"filter(transform(w_{k}, (w, j) -> CASE WHEN contains(w, '{MARK}') THEN j END), j -> j IS NOT NULL)" for k in kinds})
    word = lambda k, j: f"lower(replace(w_{k}[{j}], '{MARK}', ''))"
    context = lambda k: f"CASE WHEN j >= 2 THEN xxhash64({word(k, 'j - 2')}, {word(k, 'j - 1')}) END"
    rows = made({f"x_{k}": f"flatten(transform(j_{k}, j -> array_repeat({context(k)}, length(w_{k}[j]) - length(replace(w_{k}[j], '{MARK}', '')))))" for k in kinds})
    told = lambda k: f"transform(p_{k}, x -> named_struct('start', x.start, 'end', x.end, 'm', x.m, 'context', x_{k}[x.i]))"
    return rows.select(*every, *(F.expr(f"CASE WHEN size(x_{k}) > 0 THEN {told(k)} ELSE CAST(array() AS {SPANS}) END").alias(f"s_{k}") for k in kinds))


def entities(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, row_key``, ``base`` (spans ``kind, start, end, m,
    context`` by kind, then start) and ``tokens``, other words with a digit."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = _found(rows, PATTERNS | {"token": TOKEN})
    base = ", ".join(f"transform(s_{k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, 'm', x.m, 'context', x.context))" for k in KINDS)
    rows = rows.select("doc_id", "row_key", F.expr(f"concat({base})").alias("base"), "s_token")
    # a token is free if no base span that begins before its end reaches beyond its start
    rows = rows.select("*", F.expr("array_sort(transform(base, x -> named_struct('start', x.start, 'end', x.end)))").alias("sorted"))
    rows = rows.select("*", F.expr("transform(sorted, x -> x.end)").alias("ends"))
    rows = running(rows, {"ends": "reached"}, "max")
    middle = "sorted[shiftright(a.low + a.high, 1)].start < t.end"
    step = f"CASE WHEN a.low >= a.high THEN a WHEN {middle} THEN named_struct('low', shiftright(a.low + a.high, 1) + 1, 'high', a.high) ELSE named_struct('low', a.low, 'high', shiftright(a.low + a.high, 1)) END"
    before = f"aggregate(sequence(1, int(ceil(log2(size(sorted) + 1)))), named_struct('low', 0, 'high', size(sorted)), (a, n) -> {step}, a -> a.low)"
    free = f"CASE WHEN size(reached) > 0 THEN filter(s_token, t -> coalesce(get(reached, {before} - 1), 0) <= t.start) ELSE s_token END"
    return rows.select("doc_id", "row_key", "base", F.expr(free).alias("tokens"))


def occurrences(found: DataFrame) -> DataFrame:
    """``doc_id, row_key, start, end, value, context, seed``: entities and tokens that two words precede."""
    part = lambda column, seed: found.select("doc_id", "row_key", F.explode(column).alias("x")).select("doc_id", "row_key", "x.start", "x.end", F.lower("x.m").alias("value"), F.col("x.context").alias("context"), F.lit(seed).alias("seed"))
    return part("base", True).union(part("tokens", False)).where("context IS NOT NULL")


def plain_fillers(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context, n_plain``: words without a digit that follow each context, over
    all texts. Beyond the bound of a broadcast, word pairs are counted before
    they are shuffled."""
    words = F.array_remove(F.split(F.lower(docs["text"].cast("string")), rf"[{SPACE}]+"), "")
    rows = docs.select(words.alias("w")).where(F.size("w") > 2)
    triples = rows.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i")).select(F.expr("xxhash64(w[i], w[i + 1])").alias("context"), F.expr("w[i + 2]").alias("word"))
    # words are looked at only where the context is one of those
    counted = lambda x: x.groupBy("context").agg(F.count_if(~F.col("word").rlike("[0-9]")).alias("n_plain"))
    if contexts.count() <= BROADCAST_ROWS:
        return counted(triples.join(F.broadcast(contexts), "context", "left_semi"))
    return counted(triples).join(contexts, "context", "left_semi")


def fuller(slots: DataFrame, docs: DataFrame) -> DataFrame:
    """The slots that identifiers could still fill well enough, given the plain
    words that ``docs`` put into them."""
    plain = plain_fillers(docs, slots.select("context"))
    rows = slots.join(plain, "context", "left").where(F.col("n_values") >= LEAST_SCORE * (F.col("n_values") + F.coalesce("n_plain", F.lit(0))))
    return staged(rows.drop("n_plain"), "slots")


def scored(edges: DataFrame, slots: DataFrame) -> DataFrame:
    """``context, score`` after the rounds, from ``edges(context, value, seed)``
    and ``slots(context, n)``, the fillers of each slot."""
    seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    belief = seeds.select("value", F.col("seed").cast("double").alias("belief"))
    for _ in range(ROUNDS):
        sums = edges.join(belief, "value").groupBy("context").agg(F.sum("belief").alias("mass"), F.count_if(F.col("belief") >= LEAST_SCORE).alias("sure"))
        patterns = staged(sums.join(slots, "context").select("context", F.when(F.col("sure") >= LEAST_FILLERS, F.col("mass") / F.col("n")).otherwise(F.lit(0.0)).alias("score")), "patterns")
        doubt = edges.join(patterns, "context").groupBy("value").agg(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("doubt"), F.max("seed").alias("seed"))
        belief = staged(doubt.select("value", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("doubt")).alias("belief")), "beliefs")
    return patterns


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, row_key, base, added`` (arrays of spans
    ``kind, start, end``; code points, end exclusive).

    Null and empty texts have no spans; ``base`` is empty, not null. Rows that
    repeat are judged each. Spans of one kind don't overlap; added ones overlap
    no base span. An empty table gives no rows; other columns are ignored.
    """
    found = staged(entities(docs), "entities")
    spans = F.expr("transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))").alias("base")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>)")
    seen = occurrences(found)
    edges = seen.groupBy("context", "value").agg(F.max("seed").alias("seed"))
    slots = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("seed").alias("n_seeds"))
    slots = staged(slots.where(F.col("n_values") >= LEAST_FILLERS), "slots")
    if slots.where("n_seeds > 0").isEmpty():
        return found.select("doc_id", "row_key", spans, none.alias("added"))
    # plain words count in full only where those of texts with a digit leave a chance
    slots = fuller(slots, docs.where(docs["text"].cast("string").rlike("[0-9]")))
    if slots.where("n_seeds > 0").isEmpty():
        return found.select("doc_id", "row_key", spans, none.alias("added"))
    plain = plain_fillers(docs, slots.select("context"))
    whole = staged(slots.join(plain, "context", "left").select("context", (F.col("n_values") + F.coalesce("n_plain", F.lit(0))).alias("n")), "whole")
    edges = staged(edges.join(whole.select("context"), "context", "left_semi"), "edges")
    good = scored(edges, whole).where(F.col("score") >= LEAST_SCORE).select("context")
    added = seen.where("NOT seed").join(good, "context", "left_semi").select("doc_id", "row_key", F.expr("named_struct('kind', 'id', 'start', start, 'end', end)").alias("span"))
    added = added.groupBy(F.col("doc_id").alias("added_id"), F.col("row_key").alias("added_key")).agg(F.sort_array(F.collect_set("span")).alias("added"))
    rows = found.select("doc_id", "row_key", spans).join(added, (F.col("row_key") == F.col("added_key")) & F.col("doc_id").eqNullSafe(F.col("added_id")), "left")
    return rows.select("doc_id", "row_key", "base", F.coalesce("added", none).alias("added"))


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each span of its ``text`` replaced by its kind in angle brackets; all columns stay."""
    columns = docs.columns
    # the row's own columns go into one, so that no name can clash
    keyed = docs.select(F.struct(*(docs[f"`{x}`"] for x in columns)).alias("row"), docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text"))
    keyed = keyed.withColumn("pii_key", F.xxhash64("doc", F.coalesce("text", F.lit(""))))
    spans = found.select(F.col("doc_id").alias("pii_id"), F.col("row_key").alias("pii_row"), F.concat("base", "added").alias("pii_spans")).where(F.size("pii_spans") > 0).dropDuplicates(["pii_id", "pii_row"])
    spans = spans.withColumn("pii_spans", F.expr("array_sort(transform(pii_spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"))
    # spans of different kinds may overlap: one that begins within an earlier one gives way to it
    spans = running(spans.withColumn("pii_ends", F.expr("transform(pii_spans, x -> x.end)")), {"pii_ends": "pii_reached"}, "max")
    clear = "CASE WHEN size(pii_reached) > 0 THEN filter(transform(pii_spans, (x, i) -> named_struct('start', CASE WHEN i = 0 THEN x.start ELSE greatest(x.start, pii_reached[i - 1]) END, 'end', x.end, 'kind', x.kind)), x -> x.start < x.end) END"
    spans = spans.select("pii_id", "pii_row", F.expr(clear).alias("pii_spans"))
    if spans.agg(F.coalesce(F.sum(16 + 24 * F.size("pii_spans")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    rows = keyed.join(spans, (F.col("pii_key") == F.col("pii_row")) & F.col("doc").eqNullSafe(F.col("pii_id")), "left")
    # cut from pieces of the text, as each cut counts characters from the piece's start
    before = lambda i: f"CASE WHEN {i} = 0 THEN 0 ELSE pii_spans[{i} - 1].end END"
    parts = f"transform(sequence(0, (size(pii_spans) - 1) div {CHUNK}), c -> named_struct('low', {before(f'c * {CHUNK}')}, 'text', substring(text, 1 + {before(f'c * {CHUNK}')}, pii_spans[least(size(pii_spans), (c + 1) * {CHUNK}) - 1].end - {before(f'c * {CHUNK}')})))"
    rows = rows.withColumn("pii_parts", F.expr(f"CASE WHEN size(pii_spans) > 0 THEN {parts} END"))
    part = f"pii_parts[i div {CHUNK}]"
    pieces = f"concat(array_join(transform(pii_spans, (x, i) -> concat(substring({part}.text, 1 + {before('i')} - {part}.low, x.start - {before('i')}), '<', x.kind, '>')), ''), substring(text, element_at(pii_spans, -1).end + 1))"
    made = F.expr(f"CASE WHEN size(pii_spans) > 0 THEN {pieces} ELSE text END")
    return rows.select(*(made.alias(x) if x == "text" else F.col("row").getField(x).alias(x) for x in columns))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    line = lambda column: F.expr(f"concat_ws(',', transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)))")
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, sha256_hex(line("base")).alias("base_sha256"), F.expr("concat_ws(',', transform(concat(base, added), x -> concat(x.kind, ':', x.start, ':', x.end)))").alias("spans"))
