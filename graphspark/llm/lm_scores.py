"""Cross-entropy difference of matched bigram models.

A target model (documents labelled good and not toxic) and a background model
(all documents) have one vocabulary, one order and one smoothing. Counts are
taken over all documents and summed by shuffled aggregation. All words and
bigrams of the corpus belong to the model. Those with at least the share
``1 / ENTRIES`` of all occurrences are frequent: there are ``ENTRIES`` of either
at most whatever the corpus, so they are broadcast; the others are counted and
looked up in shards (``lm_shards``).

With ``entries`` the model is cut to the words and bigrams of that share
instead: other words are one unknown word, other bigrams back off to their word.

    p(w | v) = INNER * n(v, w) / n(v) + (1 - INNER) * p(w)
    p(w) = (n(w) + 1) / (n + words of the vocabulary + 1)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held, id_text, staged, table
from .lm_shards import LEAST_SHARDS, SHARD_WORDS, counted, counts_sent, finished, rare, rows_sent

#: Frequent words and bigrams at most; the least share of one is the reciprocal.
ENTRIES = 1 << 20
#: Longer words are unknown to a model that is cut.
WORD_BYTES = 48
INNER = 0.7
#: Words whose counts a task holds before it hands them on.
HELD_WORDS = 250_000
HELD_BIGRAMS = 2_000_000
#: Bytes of target ids that may be broadcast.
BROADCAST_BYTES = 16 << 20


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n, n_target`` over rows ``text, target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")
        sums: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush() -> pa.RecordBatch:
            words = [*{**sums[False], **sums[True]}]
            target = [sums[True][x] for x in words]
            n = [sums[False][x] + t for x, t in zip(words, target)]
            for x in sums.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(target, pa.int64())], ["word", "n", "n_target"])

        for part, raw in blocks(batches):
            for text, target in zip(raw, part.column(1).to_pylist()):
                sums[target].update(text.lower().split())
            if len(sums[False]) + len(sums[True]) > HELD_WORDS:
                yield flush()
        yield flush()

    made = rows.select("text", "target").mapInArrow(run, "word binary, n long, n_target long")
    return made.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return rare(word)


class Words:
    """The vocabulary: word to number; 0 is the unknown word."""

    def __init__(self, words: list[bytes]):
        self.numbers = Numbers((x, k + 1) for k, x in enumerate(words))

    def numbered(self, texts: list[bytes], rest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in a row, and the words of each text; with ``rest``,
        words that have none get that of their hash."""
        get, split = self.numbers.get, [x.lower().split() for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        found = map(self.numbers.__getitem__, chain.from_iterable(split)) if rest else (get(x, 0) for words in split for x in words)
        return np.fromiter(found, np.int64, int(sizes.sum())), sizes


def inner_pairs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its pair with the word before it, as one number; -1 at a
    text's first word and where either word is unknown."""
    pairs = np.full(len(flat), -1, np.int64)
    if len(flat) > 1:
        pairs[1:] = np.where((flat[1:] > 0) & (flat[:-1] > 0), (flat[:-1] << 32) | flat[1:], -1)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    pairs[starts] = -1
    return pairs, starts


def pair_counts(rows: DataFrame, shared) -> DataFrame:
    """``pair, n, n_target`` over rows ``text, target``, of words in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([x for x, _ in waiting]) if waiting else np.empty(0, np.int64)
            target = np.concatenate([x for _, x in waiting]) if waiting else np.empty(0, bool)
            waiting.clear()
            names, place = np.unique(pairs, return_inverse=True)
            n, own = np.bincount(place, minlength=len(names)), np.bincount(place[target], minlength=len(names))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.int64())], ["pair", "n", "n_target"])

        for part, raw in blocks(batches):
            flat, sizes = shared.value.numbered(raw)
            pairs, _ = inner_pairs(flat, sizes)
            target = np.repeat(np.asarray(part.column(1).to_pylist(), bool), sizes)
            waiting.append((pairs[pairs >= 0], target[pairs >= 0]))
            if sum(len(x) for x, _ in waiting) > HELD_BIGRAMS:
                yield flush()
        yield flush()

    made = rows.select("text", "target").mapInArrow(run, "pair long, n long, n_target long")
    return made.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Losses:
    """Loss of each word under one of the two models, of ``words`` words."""

    def __init__(self, total: int, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, words: int):
        counts = counts.astype(np.float64)
        counts[0] = total - counts[1:].sum()
        self.single = (counts + 1) / (total + words + 1)
        before = counts[pairs >> 32]
        self.inner = np.where(before > 0, INNER * pair_counts / np.where(before > 0, before, 1), 0)

    def of(self, flat: np.ndarray, place: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``place``: each word's pair in the model, if it is ``known``."""
        p = (1 - INNER) * self.single[flat]
        p[known] += self.inner[place[known]]
        p[first] = self.single[flat[first]]
        return -np.log(p)


def lm_scores(docs: DataFrame, targets: DataFrame, entries: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, target_loss, background_loss,
    score`` (mean loss per word under either model; their difference, lower for
    texts that are more like the target).

    ``targets``: a table of ``doc_id``; repeated and null ids add nothing. Words
    are runs of other characters than ASCII white space, A-Z in lower case.
    Null and empty texts have no words, null losses and a null score. Without
    target rows the target model is the flat one. Repeated rows count each; an
    empty table gives no rows; other columns are ignored. ``entries`` cuts the
    model.
    """
    spark = docs.sparkSession
    ids = targets.select(targets["doc_id"].cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    if ids.count() * 8 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    rows = id_text(docs).join(ids, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))

    words = staged(word_counts(rows), "words")
    total, total_target, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = F.col("n") * (entries or ENTRIES) >= total
    # frequent words are of the mean length of all, on the whole, which bounds the broadcast
    kept = words.where(frequent if entries is None else frequent & (F.length("word") <= WORD_BYTES)).collect()
    kept.sort(key=lambda x: bytes(x.word))
    vocabulary = Words([bytes(x.word) for x in kept])
    shared_words = spark.sparkContext.broadcast(vocabulary)

    found = pair_counts(rows, shared_words).where(frequent).toPandas().sort_values("pair")
    pairs = found["pair"].to_numpy(np.int64)
    size = n_words if entries is None else len(kept)
    counts = {column: np.asarray([0, *(x[column] for x in kept)]) for column in ("n", "n_target")}
    models = [Losses(n, counts[column], pairs, found[column].to_numpy(np.float64), size) for n, column in ((total_target, "n_target"), (total, "n"))]
    if entries is None:
        shards = max(LEAST_SHARDS, total // SHARD_WORDS)
        shared = spark.sparkContext.broadcast((pairs, models, ([*counts.values()], (total + size + 1, total_target + size + 1), INNER)))
        rest = counts_sent(words.where(~frequent), shards)
        parcels = counted(rest.union(rows_sent(rows, shared_words, shared, shards)), shared, shards)
        sums = finished(rest.union(parcels), shared, shards).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("low"), *(F.sum(x).alias(x) for x in ("rows", "n_words", "target_sum", "background_sum")))
        # equal rows have one key
        sums = sums.withColumn("doc_id", F.when(F.col("low") < F.col("doc_id"), F.raise_error(F.lit("two rows have one hash"))).otherwise(F.col("doc_id")))
        mean = lambda x: F.when(F.col("n_words") > 0, F.col(x) / F.col("n_words"))
        out = sums.select("doc_id", F.expr("n_words div rows").alias("n_words"), mean("target_sum").alias("target_loss"), mean("background_sum").alias("background_loss"), F.explode(F.expr("array_repeat(0, CAST(rows AS INT))")))
        # shuffles lose the order of rows
        return out.orderBy("doc_id").select("doc_id", "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
    shared = spark.sparkContext.broadcast((pairs, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")
        pairs, models = shared.value
        for part, raw in blocks(batches):
            flat, sizes = shared_words.value.numbered(raw)
            own, first = inner_pairs(flat, sizes)
            place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            known = (pairs[place] == own) & (own >= 0) if len(pairs) else np.zeros(len(own), bool)
            means = []
            for model in models:
                sums = np.zeros(len(sizes))
                if len(first):
                    sums[sizes > 0] = np.add.reduceat(model.of(flat, place, known, first), first)
                means.append(pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *means], ["doc_id", "n_words", "target_loss", "background_loss"])

    out = id_text(docs).mapInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    found = lm_scores(table(spark, sf_dir, "documents"), targets)
    return found.select("doc_id", "n_words", *(F.round(x, 6).alias(x) for x in ("target_loss", "background_loss", "score")))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS target FROM documents
), places AS (SELECT doc_id, target, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words
), totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE target) AS t FROM places
), vocabulary AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE target) AS t FROM places GROUP BY word
), size AS (SELECT count(*) AS v FROM vocabulary
), counted AS (SELECT p.doc_id, p.target, p.k, p.word, v.n, v.t FROM places p JOIN vocabulary v ON v.word = p.word
), steps AS (SELECT doc_id, target, k, word, n, t, lag(word) OVER w AS before, lag(n) OVER w AS bn, lag(t) OVER w AS bt FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), pairs AS (SELECT before, word, count(*) AS n, count(*) FILTER (WHERE target) AS t FROM steps WHERE before IS NOT NULL GROUP BY before, word
), losses AS (
  SELECT s.doc_id,
    -ln(CASE WHEN s.k = 1 THEN 1.0 ELSE 0.3 END * (s.t + 1) / (x.t + u.v + 1) + CASE WHEN p.t IS NULL OR s.bt = 0 THEN 0.0 ELSE 0.7 * p.t / s.bt END) AS target_loss,
    -ln(CASE WHEN s.k = 1 THEN 1.0 ELSE 0.3 END * (s.n + 1) / (x.n + u.v + 1) + CASE WHEN p.n IS NULL OR s.bn = 0 THEN 0.0 ELSE 0.7 * p.n / s.bn END) AS background_loss
  FROM steps s CROSS JOIN totals x CROSS JOIN size u LEFT JOIN pairs p ON p.before = s.before AND p.word = s.word
), means AS (SELECT doc_id, avg(target_loss) AS target_loss, avg(background_loss) AS background_loss FROM losses GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(m.target_loss, 6) AS target_loss, round(m.background_loss, 6) AS background_loss, round(m.target_loss - m.background_loss, 6) AS score
FROM words w LEFT JOIN means m ON m.doc_id = w.doc_id
"""
