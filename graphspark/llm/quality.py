"""Quality rules as a bitmask ledger, with DataFrame expressions only.

Each document is measured once and each rule evaluated once; the ledger keeps
the measurements and one failure bit per rule. A policy is a version of a mask:
applying it, or leaving one of its rules out, is arithmetic on the bits and
reads no text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

#: The rules in the order of their bits: name and condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("exclamations", "100 * n_exclamations > 60 * n_words"),
)
#: The rules of each policy version.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines", "exclamations"),
}
BASE_POLICY, POLICY = 1, 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")
#: Bits of a place in a packed long; texts with more words take the slower way.
PLACE_BITS = 20


def mask(policy: int) -> int:
    """The bits of a policy version."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(x) for x in POLICIES[policy])


def _count(chars: str) -> Column:
    """Characters of the class ``[chars]`` in the text."""
    return F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")


def _next_to_equal(order: str) -> Column:
    """Entries of the sorted packed array whose 3-word window has an equal neighbour."""
    bits, low = PLACE_BITS, (1 << PLACE_BITS) - 1
    same = lambda x, y: f"(shiftright({x}, {bits}) = shiftright({y}, {bits}) AND grams[CAST({x} & {low} AS INT)] = grams[CAST({y} & {low} AS INT)])"
    return F.expr(f"filter({order}, (x, k) -> (k > 0 AND {same('x', f'{order}[k - 1]')}) OR (k < size({order}) - 1 AND {same('x', f'{order}[k + 1]')}))")


def measured(docs: DataFrame) -> DataFrame:
    """The measurements of every row, one narrow stage without a shuffle.

    A window's words are compared by 64-bit hashes. Repeated windows are found
    by sorting (hash, place) packed in one long, and confirmed on whole hashes.
    """
    rows = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("!").alias("n_exclamations"),
        F.expr("CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("grams"),
    )
    rows = rows.withColumn("repeats", F.expr("size(grams) > size(array_distinct(grams))"))
    kept = [x for x in rows.columns if x not in ("grams", "repeats")]
    packed = f"CASE WHEN repeats AND size(grams) < {1 << PLACE_BITS} THEN sort_array(transform(grams, (x, i) -> (x & {-1 << PLACE_BITS}) | CAST(i AS BIGINT))) END"
    pairs = f"CASE WHEN repeats AND size(grams) >= {1 << PLACE_BITS} THEN sort_array(transform(grams, (x, i) -> struct(x AS gram, i AS place))) END"
    rows = rows.select(*kept, "grams", F.expr(packed).alias("packed"), F.expr(pairs).alias("pairs"))
    few = F.transform(_next_to_equal("packed"), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    many = F.expr("transform(filter(pairs, (x, k) -> (k > 0 AND x.gram = pairs[k - 1].gram) OR (k < size(pairs) - 1 AND x.gram = pairs[k + 1].gram)), x -> x.place)")
    rows = rows.select(*kept, F.sort_array(F.coalesce(few, many)).alias("places"))
    # each repeated window adds the words up to the next one, three at most
    steps = F.expr("aggregate(transform(sequence(1, size(places) - 1), k -> least(3, places[k] - places[k - 1])), 0, (a, x) -> a + x)")
    n_repeat = F.when(F.size("places") > 1, steps + 3).when(F.size("places") == 1, F.lit(3)).otherwise(F.lit(0))
    rows = rows.select(*kept, n_repeat.cast("long").alias("n_repeat_words"))
    # a filter on a measure must not be pushed below, where lambdas would compute it for each word
    return rows.select(F.inline(F.array(F.struct("doc_id", *MEASURES))))


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the measurements, ``failed`` (a bit per rule of RULES).

    Words are runs of other characters than ASCII white space. Null and empty
    texts have no words and fail ``few_words`` alone. Repeated rows are judged
    each, an empty table gives no rows, other columns are ignored.
    """
    failed = F.lit(0).cast("long")
    for bit, (_, condition) in enumerate(RULES):
        failed = failed + F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0))
    return measured(docs).withColumn("failed", failed)


def apply_policy(entries: DataFrame, policy: int = POLICY) -> DataFrame:
    """Adds ``kept``: whether a row fails none of the policy's rules."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: int = POLICY) -> DataFrame:
    """One row per rule of a policy: ``rule, n_failed, n_only`` (rows that this
    rule alone drops, so what leaving it out would keep). The ledger is summed
    by its bits once, which leaves a row per pattern of failures; a stored
    ledger (Parquet) is not evaluated again."""
    whole = mask(policy)
    names = [name for name, _ in RULES]
    chosen = [(name, 1 << names.index(name)) for name in POLICIES[policy]]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rules = entries.sparkSession.createDataFrame(chosen, "rule string, bit long")
    met = patterns.join(F.broadcast(rules), F.col("hit").bitwiseAND(F.col("bit")) != 0)
    sums = met.groupBy("rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(F.lit(0))).alias("n_only"))
    return F.broadcast(rules).join(sums, "rule", "left").select("rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_only", F.lit(0)).alias("n_only"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE_POLICY))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM words WHERE len(w) >= 3
), grams AS (SELECT doc_id, s, array_to_string(w[s : s + 2], ' ') AS g FROM starts
), twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (SELECT DISTINCT x.doc_id, unnest(range(s, s + 3)) AS p FROM grams x JOIN twice y ON x.doc_id = y.doc_id AND x.g = y.g
), repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs
), full_lines AS (SELECT doc_id, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM full_lines GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations
  FROM words w LEFT JOIN line_counts l ON l.doc_id = w.doc_id LEFT JOIN repeated r ON r.doc_id = w.doc_id
), bits AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_exclamations > 60 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed FROM bits
"""
