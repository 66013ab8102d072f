"""Packing by non-negative least squares.

Whole windows are cut off each document; what remains is shorter than a
window. The pieces are dealt evenly by a hash into groups of the size of
``GROUP_DOCS`` documents. In a group, shallow combinations of up to four lengths
that fill a window are enumerated over the lengths that occur, their repeat
counts are solved against the length histogram by non-negative least squares
and rounded down, and what is left is packed greedily (best fit decreasing).
A group is one task of bounded size; nothing goes to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held, id_text, table

WINDOW = 4096
#: Documents of a group, on average.
GROUP_DOCS = 8192
#: Bytes of text whose words are looked up at once: more of them share a lookup.
BLOCK_BYTES = 6 << 20
#: Words that a worker's table of ids holds at most, and the longest one kept.
TABLE_ENTRIES = 600_000
KEPT_BYTES = 48
#: Letters whose class and lower case no Unicode version changed; any other character, and a word with one.
NEAR = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
#: ASCII marks but for the apostrophe, which may begin a contraction.
MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and x != 39)
FAR, FAR_WORD = re.compile(f"[^{NEAR}]"), re.compile(f"[^ ]*[^{NEAR} ][^ ]*")
#: Combinations that one system holds at most, and its passes.
COMBINATIONS = 2000
PASSES = 25


class WordIds:
    """Word without ASCII white space to its ids as little-endian uint32.

    The tokenizer drops white space and never merges over it, so a text's ids
    are those of its words in a row. It also lower-cases, so words are looked
    up by their lower case, except in texts that may hold a special string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that need no normalising, without its own table of words
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.model.model, "_resize_cache"):
            self.model.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def encoded(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain(self, words: list[str]) -> list[bytes]:
        """Words of near letters only: one call for many, cut where a word ends."""
        made = np.asarray(self.model.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[made]) + 1) * 4
        if len(cuts) != len(words):
            return self.encoded(words)
        raw, at, out = made.tobytes(), 0, []
        for cut in cuts.tolist():
            out.append(raw[at:cut])
            at = cut
        return out

    def load(self, distinct: set[bytes]) -> None:
        """Encodes the words that are not known yet."""
        known = self.known
        if len(known) > TABLE_ENTRIES:
            known = self.known = {x: known[x] for x in distinct if x in known and len(x) <= KEPT_BYTES}
        fresh = distinct.difference(known)
        # a run of marks behind letters is a token group of its own
        stems = {x: x.rstrip(MARKS) or x for x in fresh}
        new = [*{*stems.values()}.difference(known)]
        odd = {x.encode() for x in FAR_WORD.findall(b" ".join(new).decode())}
        plain = [x for x in new if x not in odd] if odd else new
        for take, words in ((self.plain, plain), (self.encoded, [*odd])):
            for at in range(0, len(words), 1000):
                part = words[at : at + 1000]
                known.update(zip(part, take(b" ".join(part).decode().split(" "))))
        runs = self.runs
        for word, stem in stems.items():
            if len(word) != len(stem):
                if FAR.search(stem.decode()):
                    known[word] = self.encoded([word.decode()])[0]
                    continue
                run = word[len(stem) :]
                if run not in runs:
                    runs[run] = self.encoded([run.decode()])[0]
                known[word] = known[stem] + runs[run]
        if len(runs) > 10_000:
            runs.clear()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [(x if b"<|" in x else x.lower()).split() for x in texts]
        self.load(set().union(*split))
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words))


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Combinations of up to four of ``lengths`` whose sum fills the window:
    for each pair that is frequent or large, the largest length that still
    fits, then again. Sums reach the window or fall short of it by little."""
    order = np.argsort(-(counts * lengths), kind="stable")
    heads = lengths[order[: max(1, int(most**0.5 * 2))]]
    found: dict[tuple[int, ...], int] = {}

    def largest(rest: int) -> int:
        at = int(np.searchsorted(lengths, rest, side="right"))
        return int(lengths[at - 1]) if at else 0

    for a in map(int, heads):
        for b in (0, *map(int, heads)):
            if a + b > window or b > a:
                continue
            made = [x for x in (a, b) if x]
            while len(made) < 4 and (c := largest(window - sum(made))):
                made.append(c)
            if sum(made) >= window - max(1, window // 256):
                found.setdefault(tuple(sorted(made, reverse=True)), window - sum(made))
            if len(found) >= most:
                return list(found)
    return list(found)


def nnls_counts(found: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring the used histogram
    closest to ``counts`` in least squares, by cyclic coordinate descent."""
    place = {int(x): k for k, x in enumerate(lengths)}
    columns = []
    for made in found:
        uses = defaultdict(int)
        for x in made:
            uses[place[x]] += 1
        columns.append((np.fromiter(uses, np.int64), np.fromiter(uses.values(), np.float64)))
    left, x = counts.astype(np.float64).copy(), np.zeros(len(found))
    for _ in range(passes):
        moved = 0.0
        for j, (rows, uses) in enumerate(columns):
            step = max(-x[j], float(uses @ left[rows]) / float(uses @ uses))
            if step:
                x[j] += step
                left[rows] -= uses * step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def pack_lengths(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``sizes`` lie in 1..window.

    Empty input gives empty arrays. Ties keep the order of the input.
    """
    n = len(sizes)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    lengths, counts = np.unique(sizes, return_counts=True)
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], lengths)
    waiting = {int(x): order[a : a + c].tolist()[::-1] for x, a, c in zip(lengths, starts, counts)}
    found, used = combinations(lengths, counts, window), 0
    solved = nnls_counts(found, lengths, counts)
    for j in np.argsort([window - sum(x) for x in found], kind="stable"):
        made = found[j]
        times = int(solved[j] + 1e-9)
        for x in set(made):
            times = min(times, len(waiting[x]) // made.count(x))
        for _ in range(times):
            at = 0
            for x in made:
                piece = waiting[x].pop()
                sequence[piece], offset[piece] = used, at
                at += x
            used += 1
    # what is left: the largest first, each into the fullest window that takes it
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [sequence, fill]
    open_rooms = np.zeros(window + 1, bool)
    for x in map(int, lengths[::-1]):
        for piece in waiting[x][::-1]:
            fits = int(open_rooms[x:].argmax()) + x if open_rooms[x:].any() else -1
            if fits < 0:
                seat, fits = [used, 0], window
                used += 1
            else:
                seat = room[fits].pop()
                open_rooms[fits] = bool(room[fits])
            sequence[piece], offset[piece] = seat
            seat[1] += x
            if fits > x:
                room[fits - x].append(seat)
                open_rooms[fits - x] = True
    return sequence, offset


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: whole windows of each document's ids, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = held(f"packing {tokenizer}", lambda: WordIds(tokenizer)), np.asarray([end_id], "<u4").tobytes()
        for part, raw in blocks(batches, limit=BLOCK_BYTES):
            rows = [[], [], [], [], []]
            for doc, ids in zip(part.column(0).to_pylist(), words.ids(raw)):
                ids += tail
                total = len(ids) // 4
                for at in range(0, total, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    for column, x in zip(rows, (doc, at, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs every row of ``docs`` into sequences of at most ``window`` tokens.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, one row per piece. Null and empty text: the end id alone. Rows
    that repeat are packed each. An empty table gives no rows. Extra columns
    are ignored. Any assignment of this kind is right; this one depends only
    on the rows.
    """
    made = pieces(docs, tokenizer, end_id, window)
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long")
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_lengths(part.column("length").to_numpy(), window)
        group = key[0].as_py()
        return pa.table([*(part.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence * groups + group), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return made.withColumn("packing_group", key).groupBy("packing_group").applyInArrow(place, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
