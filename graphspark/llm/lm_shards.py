"""Losses of the words that the broadcast part of the bigram models doesn't hold.

Words have numbers: 1 and up for frequent ones, which every worker knows, a
negative hash for the rest, 0 for the place before a text's first word. An
occurrence of a pair goes to the shard of its rare word, or of the pair if both
words are frequent. There the pair is counted and its rare word looked up in the
shard's part of the word counts; a pair of two rare words goes on to the second
one's shard. No frequent pair goes anywhere, so no shard holds more than its
share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import blocks, held, mixed

#: Words of the corpus for each shard; shards at least.
SHARD_WORDS, LEAST_SHARDS = 4 << 20, 32
#: Occurrences that a task holds before it hands them on.
HELD_ENTRIES = 2_000_000
#: What a parcel holds: word counts, occurrences of pairs, sums of losses, rows.
COUNTS, ENTRIES, SUMS, ROWS = range(4)
PARCELS = "shard int, kind int, parcel binary"


def rare(word: bytes) -> int:
    """The negative number of a word that isn't frequent."""
    return ~(xxhash.xxh3_64_intdigest(word) >> 1)


def wrapped(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, byte by byte, compressed."""
    rows = np.stack([np.ascontiguousarray(x).view(np.int64) for x in columns])
    planes = np.ascontiguousarray(rows.view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1))
    return np.array(rows.shape, np.int64).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unwrapped(parcels: list[bytes], width: int) -> np.ndarray:
    """The parcels' columns, each as a row of numbers."""
    made = [np.empty((width, 0), np.int64)]
    for x in parcels:
        k, n = np.frombuffer(x[:16], np.int64).tolist()
        planes = np.frombuffer(pa.decompress(x[16:], decompressed_size=8 * k * n, codec="zstd", asbytes=True), np.uint8)
        made.append(np.ascontiguousarray(planes.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n))
    return np.concatenate(made, axis=1)


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(x.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def sent(kind: int, shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A parcel for each shard."""
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    parts = [wrapped(*(x[part] for x in columns)) for part in np.split(order, starts[1:])] if len(names) else []
    return batch(names, kind, parts)


def batch(shard, kind: int, parcels: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([kind] * len(parcels), pa.int32()), pa.array(parcels, pa.binary())], ["shard", "kind", "parcel"])


def counts_sent(words: DataFrame, shards: int) -> DataFrame:
    """Parcels of the counts of rare words, from ``word, n, n_target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                ids = np.fromiter(map(rare, part.column(0).to_pylist()), np.int64, part.num_rows)
                yield sent(COUNTS, shard_of(ids, shards), ids, part.column(1).to_numpy(), part.column(2).to_numpy())

    return words.select("word", "n", "n_target").mapInArrow(run, PARCELS)


def rows_sent(rows: DataFrame, shared_words, shared, shards: int) -> DataFrame:
    """Parcels of the rows ``doc_id, text, target`` with the losses of frequent
    pairs, and of all occurrences of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")
        pairs, models, _ = shared.value
        waiting: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            v, w, key, target = map(np.concatenate, zip(*waiting))
            waiting.clear()
            return sent(ENTRIES, shard_of(np.where(v < 0, v, np.where(w < 0, w, (v << 32) | w)), shards), v, w, key, target)

        for part, raw in blocks(batches):
            flat, sizes = shared_words.value.numbered(raw, rest=True)
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            before = np.zeros(len(flat), np.int64)
            before[1:] = flat[:-1]
            before[first] = 0
            own = np.where((before > 0) & (flat > 0), (before << 32) | flat, -1)
            place = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            known = (pairs[place] == own) & (own >= 0) if len(pairs) else np.zeros(len(own), bool)
            open_ = ~known & ((before != 0) | (flat < 0))
            ids = part.column(0).to_pylist()
            keys = np.fromiter((xxhash.xxh3_64_intdigest(b"%r " % x + y) for x, y in zip(ids, raw)), np.uint64, len(raw)).view(np.int64)
            sums = []
            for model in models:
                total = np.zeros(len(sizes))
                if len(first):
                    loss = model.of(np.maximum(flat, 0), place, known, first)
                    loss[open_] = 0
                    total[sizes > 0] = np.add.reduceat(loss, first)
                sums.append(total)
            null = np.array([x is None for x in ids], np.int64)
            yield batch(shard_of(keys[:1], shards), ROWS, [wrapped(keys, np.array([x or 0 for x in ids], np.int64), null, sizes, *sums)])
            target = np.asarray(part.column(2).to_pylist(), np.int64)
            waiting.append((before[open_], flat[open_], np.repeat(keys, sizes)[open_], np.repeat(target, sizes)[open_]))
            if sum(len(x[0]) for x in waiting) > HELD_ENTRIES:
                yield flush()
        if waiting:
            yield flush()

    return rows.select("doc_id", "text", "target").mapInArrow(run, PARCELS)


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Each shard and its parcels by kind; the rows are sorted by shard."""
    at, found = None, [[], [], [], []]
    for part in batches:
        for shard, kind, parcel in zip(*(part.column(k).to_pylist() for k in range(3))):
            if shard != at:
                if at is not None:
                    yield at, found
                at, found = shard, [[], [], [], []]
            found[kind].append(parcel)
    if at is not None:
        yield at, found


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    names, place = np.unique(key, return_inverse=True)
    return names, *(np.bincount(place, x, len(names)) for x in values)


class Shard:
    """A shard's word counts, with those of the frequent words."""

    def __init__(self, parcels: list[bytes], shared: tuple):
        self.frequent, self.totals, self.inner = shared
        ids, *counts = unwrapped(parcels, 3)
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], [x[order] for x in counts]
        if (self.ids[1:] == self.ids[:-1]).any():
            raise RuntimeError("two words have one hash")

    def counts_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each word in all texts, and in the target's."""
        out = [y[np.maximum(x, 0)] for y in self.frequent]
        few = np.flatnonzero(x < 0)
        place = np.searchsorted(self.ids, x[few])
        for made, own in zip(out, self.counts):
            made[few] = own[place]
        return out

    def losses(self, v: np.ndarray, w: np.ndarray, target: np.ndarray, before: list[np.ndarray]) -> list[np.ndarray]:
        """Under the target and the background model; ``before``: counts of ``v``."""
        order = np.lexsort((w, v))
        new = np.ones(len(v), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        group = np.empty(len(v), np.int64)
        group[order] = np.cumsum(new) - 1
        both = [np.bincount(group), np.bincount(group, target)]
        made = []
        for n, own, pair, size in zip(before, self.counts_of(w), both, self.totals):
            p = np.where(v == 0, 1, 1 - self.inner) * (own + 1) / size
            made.append(-np.log(p + np.where((v != 0) & (n > 0), self.inner * pair[group] / np.maximum(n, 1), 0)))
        return made[::-1]


def counted(parcels: DataFrame, shared, shards: int) -> DataFrame:
    """Occurrences become sums by row, for the row's shard; pairs of two rare
    words go on with the first one's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")
        for at, found in shards_in(batches):
            if found[ROWS]:
                yield batch([at] * len(found[ROWS]), ROWS, found[ROWS])
            if not found[ENTRIES]:
                continue
            shard = Shard(found[COUNTS], shared.value[2])
            v, w, key, target = unwrapped(found[ENTRIES], 4)
            found.clear()
            before = shard.counts_of(v)
            on = (v < 0) & (w < 0)
            if on.any():
                yield sent(ENTRIES, shard_of(w[on], shards), v[on], w[on], key[on], target[on], *(x[on] for x in before))
            here = ~on
            names, *sums = summed(key[here], *shard.losses(v[here], w[here], target[here], [x[here] for x in before]))
            yield sent(SUMS, shard_of(names, shards), names, *sums)

    return parcels.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, PARCELS)


def finished(parcels: DataFrame, shared, shards: int) -> DataFrame:
    """``key, doc_id, rows, n_words, target_sum, background_sum``, to be added up by ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("scores")

        def out(key, doc_id, rows, n_words, *sums) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), doc_id, pa.array(rows), pa.array(n_words), *map(pa.array, sums)], ["key", "doc_id", "rows", "n_words", "target_sum", "background_sum"])

        def parts(key: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
            none = np.zeros(len(key), np.int64)
            return out(key, pa.nulls(len(key), pa.int64()), none, none, *sums)

        for _, found in shards_in(batches):
            if found[ROWS]:
                key, doc_id, null, n_words, *sums = unwrapped(found[ROWS], 6)
                yield out(key, pa.array(doc_id, mask=null > 0), np.ones(len(key), np.int64), n_words, *(x.view(np.float64) for x in sums))
            if found[SUMS]:
                key, *sums = unwrapped(found[SUMS], 3)
                yield parts(*summed(key, *(x.view(np.float64) for x in sums)))
            if found[ENTRIES]:
                v, w, key, target, *before = unwrapped(found[ENTRIES], 6)
                yield parts(*summed(key, *Shard(found[COUNTS], shared.value[2]).losses(v, w, target, before)))

    return parcels.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "key long, doc_id long, rows long, n_words long, target_sum double, background_sum double")
