"""Near-duplicate detection by b-bit MinHash.

1. Each text becomes its set of shingle hashes, of which the minima under
   ``MINIMA`` hash functions are taken. Documents with equal sets are one class.
2. Bands of ``ROWS`` full minima generate candidates; of each minimum only the
   low ``BITS`` bits are kept, packed into a signature.
3. Similarities of candidates are estimated by bit counts, corrected for
   chance collisions of the low bits; what stays well below the threshold goes.
4. The rest is confirmed on the full sets, and components are formed.

Pairs are never listed by bucket. Classes of a bucket are compared with one
leader; then, where a bucket still holds several components, with random
leaders; then only classes of different components are compared, in blocks of
bounded size, each pair in the first band that it shares. Two classes that a
chain of confirmed links already joins need no comparison.

With 25 bands of 5, a pair at the threshold of 0.85 shares no band with a
probability of 4e-7, with 38 one at 0.80 with 3e-7; the estimate drops such a
pair with one of 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_HASHES, blocks, gram_hashes, held, id_text, mixed, staged, table
from .components import components

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: By the percent of links: bands, and the estimate below which candidates are
#: dropped, over five standard errors below the threshold.
SETTINGS = {85: (25, 0.70), 80: (38, 0.63)}
ROWS = 5
#: Minima of a signature (a multiple of 16, those of all bands at least), bits kept of each.
MINIMA, BITS = 192, 4
#: Logarithm of the bits of a set's map.
MAP_BITS = 12
#: Classes that a block holds on either side.
BLOCK_CLASSES = 512
#: Bytes of ids that may be broadcast.
BROADCAST_BYTES = 16 << 20

_RANDOM = np.random.default_rng(20_061)
MULTIPLIERS = _RANDOM.integers(0, 1 << 62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all shingles of a text, with repeats; of the whole sequence if it is shorter."""
    hashes = WORD_HASHES.of(text.lower().split())
    return gram_hashes(hashes, min(words, len(hashes))) if len(hashes) else hashes


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA rows; a column per text, whose shingles begin at ``starts``."""
    out = np.empty((MINIMA, len(starts)), np.uint64)
    made = np.empty_like(shingles)
    for k in range(MINIMA):
        np.multiply(shingles, MULTIPLIERS[k], out=made)
        np.add(made, OFFSETS[k], out=made)
        out[k] = np.minimum.reduceat(made, starts)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen in a word: a row per text."""
    low = (mins & np.uint64(15)).reshape(-1, 16, mins.shape[1])
    words = np.zeros((low.shape[0], low.shape[2]), np.uint64)
    for k in range(16):
        words |= low[:, k] << np.uint64(4 * k)
    return np.ascontiguousarray(words.T)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of rows of packed signatures, corrected for collisions of low bits."""
    unequal = x ^ y
    unequal |= unequal >> np.uint64(2)
    unequal |= unequal >> np.uint64(1)
    unequal &= np.uint64(0x1111111111111111)
    share = 1 - np.bitwise_count(unequal).sum(axis=-1) / MINIMA
    chance = 0.5**BITS
    return (share - chance) / (1 - chance)


def signatures(docs: DataFrame, n_bands: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature, bands`` per row; the last three
    null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for part, raw in blocks(batches, limit=256 << 10):
            sets = [shingle_hashes(x) for x in raw]
            distinct = [np.unique(x) for x in sets]
            full = [k for k, x in enumerate(distinct) if len(x)]
            keys, rows, bands = ([None] * len(raw) for _ in range(3))
            if full:
                counts = np.asarray([len(distinct[k]) for k in full])
                mins = minima(np.concatenate([distinct[k] for k in full]), np.cumsum(counts) - counts)
                words = packed(mins)
                hashes = np.stack([gram_hashes(np.ascontiguousarray(mins[ROWS * b : ROWS * (b + 1)].T).ravel(), ROWS)[::ROWS] ^ mixed(np.full(len(full), b + 1, np.uint64)) for b in range(n_bands)], axis=1).view(np.int64)
                for place, k in enumerate(full):
                    keys[k] = hashlib.blake2b(distinct[k].tobytes(), digest_size=16).digest()
                    rows[k], bands[k] = words[place].tobytes(), hashes[place]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, distinct), pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>")


def bitmap(shingles: np.ndarray) -> bytes:
    """The set's members by the first bits of their hashes."""
    bits = np.zeros(1 << MAP_BITS, np.uint8)
    bits[(shingles >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """A bound of the intersection's size: a bit of one map that the other lacks
    stands for a member at least that the other set lacks."""
    only_x, only_y = (np.bitwise_count(z).sum(axis=-1, dtype=np.int64) for z in (x & ~y, y & ~x))
    return np.minimum(size_x - only_x, size_y - only_y)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, grams (sorted hashes as bytes), bits`` of the documents named in ``wanted(rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for part, raw in blocks(batches):
            sets = [np.unique(shingle_hashes(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(map(bitmap, sets), pa.binary())], ["rep", "grams", "bits"])

    if wanted.count() * 8 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    found = id_text(docs).join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    return found.mapInArrow(run, "rep long, grams binary, bits binary").dropDuplicates(["rep", "grams"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets confirm the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("rep").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("grams").alias("y"))
    size = lambda c: F.octet_length(c)
    rows = pairs.join(one, "a").join(two, "b").where(100 * F.least(size("x"), size("y")) >= percent * F.greatest(size("x"), size("y")))
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The distinct pairs ``a, b`` whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimates(x, y) >= least))

    one = classes.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    two = classes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    return pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


# What is found out about a bucket is staged before its members are joined with
# it: a join of two plain shuffles can split the members of a hot bucket, one
# that shares its shuffle with an aggregation can't.


def unsettled(bands: DataFrame, found: DataFrame) -> DataFrame:
    """``band, rep, component`` of the buckets that hold several components."""
    rows = bands.join(found, bands["rep"] == found["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    open_bands = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    return rows.join(staged(open_bands, "open"), "band")


def led(rows: DataFrame, order) -> DataFrame:
    """Pairs of each bucket's leader, least by ``order``, with the members of other components."""
    leaders = rows.groupBy("band").agg(F.min(F.struct(order.alias("o"), F.col("rep"), F.col("component"))).alias("l")).select("band", F.col("l.rep").alias("leader"), F.col("l.component").alias("own"))
    return rows.join(staged(leaders, "leaders"), "band").where("rep <> leader AND component <> own").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))


def compared(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of all members of a bucket that lie in different components.

    Members outside the bucket's largest component are compared with all
    others, in blocks; members of the largest one are not compared with each
    other. Pairs that pass the estimate must also pass a bound of the
    intersection by the sets' maps, so that hardly any but links are left.
    """
    n_bands, least = SETTINGS[percent]
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total")).select("band", F.col("m.component").alias("main"), F.col("m.n").alias("n_main"), F.col("total"))
    largest = staged(largest, "largest")
    chunks = lambda n: F.ceil(n / F.lit(BLOCK_CLASSES)).cast("int")
    placed = rows.join(largest, "band").withColumn("few", chunks(F.col("total") - F.col("n_main"))).withColumn("many", chunks(F.col("n_main"))).withColumn("is_main", F.col("component") == F.col("main"))
    spread = F.xxhash64("rep")
    placed = placed.withColumn("chunk", F.when(F.col("is_main"), F.col("few") + F.pmod(spread, F.col("many")).cast("int")).otherwise(F.pmod(spread, F.col("few")).cast("int")))
    # a block is a pair of chunks (i, j), i <= j, of which i lies outside the largest component
    tasks = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), lambda j: F.struct(F.least(j, F.col("chunk")).alias("i"), F.greatest(j, F.col("chunk")).alias("j"))))
    carried = ("rep", "component", "chunk", "signature", "bands", "bits", "n_shingles")
    members = placed.join(classes.select("rep", "signature", "bands"), "rep").join(sets.select("rep", "bits", (F.octet_length("grams") / 8).cast("long").alias("n_shingles")), "rep")
    members = members.select("band", F.explode(tasks).alias("t"), *carried).select("band", "t.i", "t.j", *carried)

    def compare(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        band, i, j = (x.as_py() for x in key)
        part = part.combine_chunks()
        n = part.num_rows
        rep, component, chunk, size = (part.column(x).to_numpy() for x in ("rep", "component", "chunk", "n_shingles"))
        words, maps = (np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint64).reshape(n, -1) for x in ("signature", "bits"))
        bands = np.asarray(part.column("bands").to_pylist(), np.int64).reshape(n, n_bands)
        here = (bands == band).argmax(axis=1)
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        a, b = [], []
        for x in left.tolist():
            y = right[(component[right] != component[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))]
            if i == j:
                y = y[rep[y] > rep[x]]
            y = y[estimates(words[y], words[x]) >= least]
            # only in the first band that both share
            y = y[(bands[y] == bands[x]).argmax(axis=1) == here[x]]
            both = most_shared(maps[y], maps[x], size[y], size[x])
            y = y[100 * both >= percent * (size[y] + size[x] - both)]
            a.append(np.minimum(rep[y], rep[x]))
            b.append(np.maximum(rep[y], rep[x]))
        whole = lambda z: pa.array(np.concatenate([np.empty(0, np.int64), *z]), pa.int64())
        return pa.table([whole(a), whole(b)], names=["a", "b"])

    return members.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def across(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` of classes with an id that occurs in several of them."""
    own = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key")
    key = F.xxhash64("set_key")
    several = staged(own.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id"), "several")
    pairs = own.join(several, "doc_id").distinct().join(classes.select("set_key", "rep"), "set_key")
    return pairs.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Lower-cases A-Z; words are runs of other characters than ASCII white
    space. Null, empty and blank texts have no shingles, are linked with
    nothing and kept. Fewer words than a shingle are one shingle. Equal rows
    are in one class; rows with one id and different texts are one node. Rows
    with a null id take part in no link. Empty table: no rows. Other columns
    are ignored. ``percent``: the least similarity of a link, one of ``SETTINGS``.
    """
    n_bands, least = SETTINGS[percent]
    rows = staged(signatures(docs, n_bands), "signatures")
    classes = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    one_id = staged(across(rows, classes), "across")
    bands = classes.select(F.explode("bands").alias("band"), "rep")
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    bands = staged(bands.join(staged(shared.select("band"), "shared"), "band"), "bands")
    candidates = classes.join(bands.select("rep").distinct(), "rep", "left_semi")
    candidates = staged(candidates, "candidates")
    sets = staged(shingle_sets(docs, candidates.select("rep").distinct()), "sets")
    none = bands.sparkSession.createDataFrame([], "node long, component long")
    links, found = one_id, none
    if not one_id.isEmpty():
        found = staged(components(links), "components")
    for step in ("first", "random", "all"):
        rest = staged(unsettled(bands, found), "unsettled")
        if rest.isEmpty():
            break
        if step == "first":
            pairs = estimated(led(rest, F.col("rep")), candidates, least)
        elif step == "random":
            pairs = estimated(led(rest, F.xxhash64("band", "rep")), candidates, least)
        else:
            pairs = compared(rest, candidates, sets, percent)
        more = staged(linked(staged(pairs, "pairs"), sets, percent), "confirmed")
        links = links.union(more)
        found = staged(components(links), "components")
    # classes of equal sets, then components of classes
    named = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    rows = rows.select("doc_id", "n_shingles", "set_key")
    # rows without words need no join, in which they would be one key
    blank = rows.where("set_key IS NULL").withColumn("component", F.lit(None).cast("long"))
    out = rows.where("set_key IS NOT NULL").join(named, "set_key", "left").unionByName(blank)
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (SELECT doc_id, w, least(5, len(w)) AS m FROM words WHERE len(w) > 0
), places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM starts
), sets AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + m - 1], ' ') AS g FROM places
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN pairs l ON l.a = r.other
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.node = w.doc_id
"""
