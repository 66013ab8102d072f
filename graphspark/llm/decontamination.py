"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items, as word numbers. For each
pattern length there is a block shift table (how far the search may advance
over impossible positions), buckets of the patterns by a hash of their suffix,
and a direct comparison that confirms an occurrence. Texts are searched in
lanes of bounded length that advance together, so that each step is one
vector operation.

The benchmark is read in blocks whose size is measured first; the blocks are
broadcast. One Python stage searches the documents for all blocks. A worker
keeps the tables of ``KEPT_TABLES`` blocks from task to task; those of further
blocks are made again for each batch of documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_BYTES, BLOCK_BYTES, MIX, blocks, bounded, held, id_text, ranges, sha256_hex, table

#: Consecutive item words that make a window.
WINDOW_WORDS = 10
#: Bytes of benchmark text in a block, and blocks whose tables (some 50 MB each) a worker keeps.
BENCHMARK_BLOCK_BYTES, KEPT_TABLES = 2 << 20, 4
#: Slots of a shift table (a power of two), words of a lane, words of a suffix, pairs compared at once.
SLOTS = 1 << 20
LANE = 256
SUFFIX_WORDS = 4
PAIRS = 2_000_000

#: A-Z to lower case; all that is no word character becomes a space.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def folded_words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def suffix_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One hash per row of the columns, the last word's first."""
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = (out ^ (out >> np.uint64(31))) * MIX + x.astype(np.uint64)
    return out * MIX


class WuManber:
    """All occurrences of patterns of one length in a sequence of numbers.

    Numbers are 1..size for the patterns' words and 0 for any other.
    """

    def __init__(self, patterns: np.ndarray, size: int):
        count, self.length = patterns.shape
        self.base = np.int64(size + 1)
        self.block = min(2, self.length)
        self.suffix = min(SUFFIX_WORDS, self.length)
        self.shift = np.full(SLOTS, self.length - self.block + 1, np.int16)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.slots(patterns, end), self.length - 1 - end)
        tails = suffix_hashes([patterns[:, self.length - 1 - k] for k in range(self.suffix)])
        order = np.argsort(tails, kind="stable")
        self.patterns, self.numbers = patterns[order], order
        self.tails, starts, counts = np.unique(tails[order], return_index=True, return_counts=True)
        self.starts, self.counts = starts.astype(np.int64), counts.astype(np.int64)

    def slots(self, words: np.ndarray, end) -> np.ndarray:
        """Slot of the block that ends at ``end`` (rows of a matrix, or places of a vector)."""
        if words.ndim == 2:
            last, before = words[:, end], words[:, end - 1] if self.block == 2 else None
        else:
            last, before = words[end], words[end - 1] if self.block == 2 else None
        code = last.astype(np.int64)
        if before is not None:
            code = code + before * self.base
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def search(self, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last place, pattern number) of all occurrences within the texts that
        begin at ``starts`` and have ``counts`` words."""
        m = self.length
        ends = np.maximum(counts - m + 1, 0)  # places where a window can end
        lanes = -(-ends // LANE)
        first = np.repeat(starts + m - 1, lanes) + ranges(np.zeros(len(lanes), np.int64), lanes) * LANE
        until = np.minimum(first + LANE, np.repeat(starts + counts, lanes))
        at, found = first, []
        while len(at):
            shift = self.shift[self.slots(words, at)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < until
            at, until = at[live], until[live]
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        return self.confirm(words, at)

    def confirm(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return at, at
        tails = suffix_hashes([words[at - k] for k in range(self.suffix)])
        slot = np.minimum(np.searchsorted(self.tails, tails), len(self.tails) - 1)
        same = self.tails[slot] == tails
        at, slot = at[same], slot[same]
        places, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        sums = np.cumsum(self.counts[slot])
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + PAIRS, side="right")))
            n = self.counts[slot[low:high]]
            place, pattern = np.repeat(at[low:high], n), ranges(self.starts[slot[low:high]], n)
            for k in range(self.length):
                equal = words[place - k] == self.patterns[pattern, self.length - 1 - k]
                place, pattern = place[equal], pattern[equal]
            places.append(place)
            numbers.append(self.numbers[pattern])
            low = high
        return np.concatenate(places), np.concatenate(numbers)


class Benchmark:
    """The search tables of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.words: dict[bytes, int] = {}
        self.names = [x for x, _ in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, (_, raw) in enumerate(items):
            numbers = np.asarray([self.words.setdefault(x, len(self.words) + 1) for x in folded_words(raw)], np.int32)
            if size := min(window, len(numbers)):
                by_size[size].append((item, np.lib.stride_tricks.sliding_window_view(numbers, size)))
        self.engines = []
        for size, made in sorted(by_size.items()):
            rows = np.concatenate([x for _, x in made])
            owner = np.repeat([item for item, _ in made], [len(x) for _, x in made])
            _, first, number = np.unique(rows.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
            number, owner = np.unique(np.stack([number.ravel(), owner]), axis=1)
            # items of each pattern: owner[starts[k] : starts[k + 1]]
            self.engines.append((WuManber(rows[first], len(self.words)), np.searchsorted(number, np.arange(len(first) + 1)), owner))

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """Of each text: its number of words, which of them are hit, the items."""
        split = [folded_words(x) for x in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        starts = np.cumsum(counts) - counts
        get = self.words.get
        flat = np.fromiter([get(x, 0) for words in split for x in words], np.int32, int(counts.sum()))
        edge = np.zeros(len(flat) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        for engine, begin, owner in self.engines:
            ends, numbers = engine.search(flat, starts, counts)
            np.add.at(edge, ends - engine.length + 1, 1)
            np.add.at(edge, ends + 1, -1)
            if len(ends):
                pairs = np.unique(np.stack([np.searchsorted(starts, ends, side="right") - 1, numbers]), axis=1)
                for text, number in pairs.T.tolist():
                    items[text].update(self.names[x] for x in owner[begin[number] : begin[number + 1]].tolist())
        hit = np.cumsum(edge[:-1]) > 0
        for k, (start, count) in enumerate(zip(starts.tolist(), counts.tolist())):
            yield count, hit[start : start + count], items.get(k, set())


def item_blocks(benchmark: DataFrame, limit: int = BENCHMARK_BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``limit`` bytes of text; items without text have no window."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(x.item_id, x.text.encode()) for x in part.collect()]


class Search:
    """All blocks of a benchmark, to be searched for on the workers."""

    def __init__(self, benchmark: DataFrame, window: int, limit: int):
        bounded(benchmark.sparkSession)
        self.window, self.token = window, uuid.uuid4().hex
        self.blocks = [benchmark.sparkSession.sparkContext.broadcast(x) for x in item_blocks(benchmark, limit)]

    def tables(self) -> Iterator[Benchmark]:
        kept = held(f"benchmark {self.token}")
        for k, block in enumerate(self.blocks):
            made = kept.get(k) or Benchmark(block.value, self.window)
            if len(kept) < KEPT_TABLES:
                kept[k] = made
            yield made

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, set[str]]]]]:
        """Slices of the batches with each text's number of words, which of them are hit, the items."""
        for part, raw in blocks(batches, limit=BLOCK_BYTES if len(self.blocks) <= KEPT_TABLES else ARROW_BYTES):
            whole = None
            for made in self.tables():
                found = list(made.find(raw))
                whole = found if whole is None else [(n, x | y, a | b) for (n, x, a), (_, y, b) in zip(whole, found)]
            yield part, whole


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, limit: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items (sorted
    array of strings), contaminated``.

    Null and empty text: no words, nothing hit. An item without words or id
    never occurs; repeated items count by their id. A benchmark without rows
    contaminates nothing. Empty ``docs``: no rows. Other columns are ignored.
    """
    search = Search(benchmark, window, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in search.texts(batches):
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(x.sum()) for _, x, _ in found], pa.int64()), pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_hit", "items"])

    found = id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, limit: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window, with all their columns. Each row
    is judged by its own text, whatever its id."""
    search = Search(benchmark, window, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in search.texts(batches):
            yield part.filter(pa.array([not x.any() for _, x, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", sha256_hex(F.concat_ws(",", "items"))).drop("items")


#: Every document word inside an occurrence of a window, by joining windows of each length.
OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT doc_id, coalesce(w, []) AS w FROM words
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0
), starts AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM sized
), windows AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS win FROM starts
), lengths AS (SELECT DISTINCT m FROM windows
), places AS (SELECT d.doc_id, l.m, d.w, unnest(range(1, len(d.w) - l.m + 2)) AS s FROM docs d, lengths l WHERE len(d.w) >= l.m
), grams AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM places
), found AS (SELECT g.doc_id, g.m, g.s, x.item_id FROM grams g JOIN windows x ON g.m = x.m AND g.win = x.win
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, m, s FROM found)) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  coalesce(h.n_hit, 0) > 0 AS contaminated, sha256(coalesce(n.items, '')) AS items_sha256
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
