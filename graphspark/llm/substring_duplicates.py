"""Removal of repeated word windows with a compressed FM-index per shard.

A window of ``WINDOW`` words is assigned to the shard of its anchor: the least
of the hashes of its ``ANCHOR``-word runs. Equal windows have equal anchors and
meet in one shard. Consecutive windows of a text with one anchor make a
segment. Only segments whose anchor occurs elsewhere can hold a repeated
window, so only those are indexed, each distinct one once with its number of
occurrences. A shard's FM-index is built over the segments' overlapping
``STEP``-word symbols (seven make a window). The segments, those of equal text
as one, are streamed against it: backward search over the wavelet tree computes
matching statistics, for each place the length of the longest match that ends
there and occurs twice, up to the threshold. Intervals of places that reach the
threshold are reported and go back to the documents.

An anchor with many distinct segments (the edge of a passage in very many
texts) is split: its windows are taken one by one, equal ones counted, and
spread over shards by a hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, WORD_HASHES, blocks, bounded, gram_hashes, held, mixed, ranges, sha256_hex, staged, table
from .fm_index import FMIndex

#: Words of a window, of an anchor, and between the symbols of a window.
WINDOW, ANCHOR, STEP = 35, 8, 5
#: Symbols of a window, and places that its symbols span.
SYMBOLS = WINDOW // STEP
SPAN = WINDOW - STEP
#: Places that a shard indexes on average.
SHARD_PLACES = 250_000
#: Distinct segments beyond which an anchor is split.
SPLIT_SEGMENTS = 1000


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        size += step
    return place


def segments(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts with ``counts`` words: the segments' text, first window, windows, anchor, content hash."""
    empty = np.empty(0, np.int64)
    starts = np.cumsum(counts) - counts
    windows = np.maximum(counts - WINDOW + 1, 0)
    at = ranges(starts, windows)
    if not len(at):
        return empty, empty, empty, empty, empty
    grams = gram_hashes(hashes, ANCHOR)
    place = least_places(grams, WINDOW - ANCHOR + 1)[at]
    text = np.repeat(np.arange(len(counts)), windows)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[new, len(at)])
    first, text = at[new], text[new]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), MIX, np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:-1])]
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), np.uint64(pow(int(MIX), -1, 1 << 64)), np.uint64)])
    content = mixed((sums[first + n + WINDOW - 1] - sums[first]) * back[first] + n.astype(np.uint64))
    return text, first - starts[text], n, grams[place[new]].view(np.int64), content.view(np.int64)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, row_key``: rows with one id and different texts stay apart."""
    bounded(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def all_segments(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring")
        for part, raw in blocks(batches):
            words = [x.split() for x in raw]
            hashes = np.concatenate([np.empty(0, np.uint64), *(WORD_HASHES.of(x) for x in words)])
            text, first, n, anchor, content = segments(np.fromiter(map(len, words), np.int64, len(words)), hashes)
            take = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(content, pa.int64())], ["doc_id", "row_key", "first", "n", "anchor", "content"])

    return rows.mapInArrow(run, "doc_id long, row_key long, first int, n int, anchor long, content long")


def indexed_items(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """``anchor, content, item, offset, split, weight, places`` of each distinct
    segment, cut from the text that owns it: one row, or one per window of a
    split anchor. ``places``: the symbols' hashes, as bytes."""
    wanted = distinct.groupBy(F.col("owner.doc_id").alias("owner_id"), F.col("owner.row_key").alias("owner_key")).agg(F.collect_list(F.struct(F.col("owner.first").alias("first"), "n", "anchor", "content", "weight", "split")).alias("wanted"))
    found = rows.join(wanted, (F.col("row_key") == F.col("owner_key")) & F.col("doc_id").eqNullSafe(F.col("owner_id"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring")
        for part, raw in blocks(batches):
            out = [[], [], [], [], [], [], []]
            for text, own in zip(raw, part.column(1).to_pylist()):
                symbols = gram_hashes(WORD_HASHES.of(text.split()), STEP)
                for x in own:
                    first, n = x["first"], x["n"]
                    if x["split"]:
                        picked = symbols[first + np.arange(n)[:, None] + STEP * np.arange(SYMBOLS)]
                        made = [(int(gram_hashes(p, SYMBOLS).view(np.int64)[0]), k, symbols[first + k : first + k + 1 + SPAN].tobytes()) for k, p in enumerate(picked)]
                    else:
                        made = [(x["content"], 0, symbols[first : first + n + SPAN].tobytes())]
                    for item, offset, places in made:
                        for column, y in zip(out, (x["anchor"], x["content"], item, offset, x["split"], x["weight"], places)):
                            column.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], ["anchor", "content", "item", "offset", "split", "weight", "places"])

    return found.mapInArrow(run, "anchor long, content long, item long, offset int, split boolean, weight long, places binary")


def search_shard(places: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each item of a shard: which of its windows occur twice in the shard,
    by the matching statistics of the places at which they end."""
    joined = np.frombuffer(b"".join(places), np.uint64)
    lengths = np.fromiter((len(x) // 8 for x in places), np.int64, len(places))
    names, symbols = np.unique(joined, return_inverse=True)
    # an item becomes STEP strings of every STEP-th symbol, each ended by a separator
    place = ranges(np.zeros(len(lengths), np.int64), lengths)
    item = np.repeat(np.arange(len(lengths)), lengths)
    phase, nth = place % STEP, place // STEP
    sizes = (lengths[:, None] - np.arange(STEP) + STEP - 1) // STEP
    borders = np.cumsum((np.maximum(sizes, 0) + 1).ravel()).reshape(sizes.shape)
    string = borders - np.maximum(sizes, 0) - 1
    at = string[item, phase] + nth
    text, weight = np.zeros(int(borders[-1, -1]), np.int64), np.zeros(int(borders[-1, -1]), np.int64)
    text[at] = symbols.reshape(-1) + 1
    weight[at] = weights[item]
    index = FMIndex(text, len(names) + 1, SYMBOLS, weight)
    ends = at[place >= SPAN]  # of the items' windows, in order
    hit = index.matching_statistics(text, ends, SYMBOLS) >= SYMBOLS
    counts = lengths - SPAN
    return np.split(hit, np.cumsum(counts)[:-1])


def repeated_windows(items: DataFrame, shards: int) -> DataFrame:
    """``anchor, item, low, high``: runs [low, high) of windows that occur twice."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        held("substring")
        # rows that repeat in the input have brought their items more than once
        once = {x: k for k, x in enumerate(zip(part.column("anchor").to_pylist(), part.column("item").to_pylist()))}
        part = part.take(pa.array(sorted(once.values()), pa.int64()))
        hits = search_shard(part.column("places").to_pylist(), part.column("weight").to_numpy())
        number, low, high = [], [], []
        for k, hit in enumerate(hits):
            edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            number += [k] * (len(edges) // 2)
            low += edges[::2].tolist()
            high += edges[1::2].tolist()
        take = pa.array(number, pa.int64())
        return pa.table([part.column("anchor").take(take), part.column("item").take(take), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["anchor", "item", "low", "high"])

    rows = items.select(F.pmod("shard_key", F.lit(shards)).alias("shard"), "anchor", "item", "weight", "places")
    return rows.groupBy("shard").applyInArrow(run, "anchor long, item long, low int, high int")


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """``doc_id, row_key, spans``: word intervals [low, high) covered by windows
    that occur more than once, for the rows that have any."""
    runs = staged(all_segments(rows), "segments")
    repeated = staged(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "anchors")
    runs = staged(runs.join(repeated, "anchor"), "runs")
    distinct = runs.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.min(F.struct("doc_id", "row_key", "first")).alias("owner"))
    distinct = staged(distinct, "distinct")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > SPLIT_SEGMENTS).select("anchor", F.lit(True).alias("crowded"))
    # staged, so that the join with a hot anchor's segments is one of two plain shuffles, which can be split
    crowded = staged(crowded, "crowded")
    n_distinct, n_windows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct = distinct.join(crowded, "anchor", "left").withColumn("split", F.coalesce("crowded", F.lit(False)))
    items = staged(indexed_items(rows, distinct), "items")
    whole = items.where("NOT split").select("anchor", "item", "weight", "places", F.xxhash64("anchor").alias("shard_key"))
    single = items.where("split").dropDuplicates(["anchor", "content", "offset"])
    single = single.groupBy("anchor", "item").agg(F.sum("weight").alias("weight"), F.first("places").alias("places")).select("anchor", "item", "weight", "places", F.xxhash64("anchor", "item").alias("shard_key"))
    shards = max(1, -(-(n_windows + SPAN * n_distinct) // SHARD_PLACES))
    found = staged(repeated_windows(whole.union(single), shards), "repeated")
    split = items.where("split").select("anchor", "content", "item", "offset").distinct().join(found.select("anchor", "item"), ["anchor", "item"]).select("anchor", "content", F.col("offset").alias("low"), (F.col("offset") + 1).alias("high"))
    plain = found.join(items.where("NOT split").select("anchor", "item").distinct(), ["anchor", "item"], "left_semi").select("anchor", F.col("item").alias("content"), "low", "high")
    spans = runs.join(plain.union(split), ["anchor", "content"]).select("doc_id", "row_key", F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") - 1 + WINDOW).alias("high")).alias("span"))
    return spans.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, spans (word intervals
    that repeat), kept_text (words left, joined by a space)``.

    Words are runs of other characters than ASCII white space, unchanged. Null
    and empty text: no words. Texts of fewer words than a window keep all. Rows
    that repeat are each other's copies, so windows of both go. Empty table: no
    rows. Other columns are ignored.
    """
    rows = keyed(docs)
    spans = staged(repeated_intervals(rows), "spans").withColumnsRenamed({"doc_id": "span_id", "row_key": "span_key"})
    marked = rows.join(spans, (F.col("row_key") == F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_id")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substring")
        for part, raw in blocks(batches):
            counts, removed, merged, kept = [], [], [], []
            for text, found in zip(raw, part.column(2).to_pylist()):
                words, whole = text.split(), []
                for x in sorted((y["low"], y["high"]) for y in found or ()):
                    if whole and x[0] <= whole[-1][1]:
                        whole[-1] = (whole[-1][0], max(whole[-1][1], x[1]))
                    else:
                        whole.append(x)
                at, left = 0, []
                for low, high in whole:
                    left += words[at:low]
                    at = high
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                merged.append([{"low": a, "high": b} for a, b in whole])
                kept.append(b" ".join(left).decode())
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<low:int,high:int>>, kept_text string")


def op8_substring_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35
), windows AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + 34], ' ')) AS win FROM starts
), repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows WHERE win IN (SELECT win FROM repeated)
), places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM places x LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id
), gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = w.doc_id
"""
