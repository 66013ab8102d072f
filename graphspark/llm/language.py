"""Language identification by nearest centroids.

A text is the TF-IDF vector of its letter trigrams (of UTF-8 bytes, hashed into
``DIMENSIONS``), normalised. Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled texts. A text gets the
language of the centroid with the largest cosine; it is rejected if that
cosine lies far below those of sample texts of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, held, id_text, table

DIMENSIONS = 8192
#: Labelled texts of each language that the centroids are fitted on, at most.
SAMPLE = 600
#: Languages that are learned, at most: those with most texts.
LANGUAGES = 256
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below this share of the least cosine of sample texts of its length.
SLACK = 0.6
#: Sample texts that a length needs to have its own bound.
LEAST_TEXTS = 20
UNKNOWN = "und"
#: Texts whose dense vectors are held at once.
ROWS = 64

#: ASCII letters in lower case, other ASCII characters as a space, the rest as it is.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))
ASCII_LETTERS = bytes(range(97, 123))


def has_letter(raw: bytes) -> bool:
    folded = raw.translate(FOLD)
    if folded.translate(None, bytes(range(32, 33)) + bytes(range(128, 256))):
        return True
    return any(x.isalpha() for x in folded.decode())


def counts(texts: list[bytes]) -> np.ndarray:
    """Trigram counts, a row per text."""
    folded = [b" " + b" ".join(x.translate(FOLD).split()) + b" " for x in texts]
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    flat = np.frombuffer(b"".join(folded) + b"  ", np.uint8).astype(np.uint32)
    codes = flat[:-2] * np.uint32(65536) + flat[1:-1] * np.uint32(256) + flat[2:]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - 13)
    # the last two places of a text begin no trigram of its own
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[np.maximum(ends - 2, 0)] = False
    row = np.repeat(np.arange(len(texts)), sizes)
    made = np.bincount(row[inside] * DIMENSIONS + codes[inside], minlength=len(texts) * DIMENSIONS)
    return made.reshape(len(texts), DIMENSIONS).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # idf of each dimension
    centroids: np.ndarray  # rows: CENTROIDS of each language in turn, some of them zero
    least: np.ndarray  # bound of the cosine by the logarithm of the number of trigrams

    def vectors(self, made: np.ndarray) -> np.ndarray:
        out = np.sqrt(made) * self.weights
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms, norms, 1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, list[bool]]:
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            made = counts(part)
            cosines = self.vectors(made) @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(part)), best], 0, 1).astype(float)
            size = np.log2(made.sum(axis=1) + 1).astype(int)
            bound = self.least[np.minimum(size, len(self.least) - 1)]
            for text, k, x, low in zip(part, best.tolist(), score.tolist(), bound.tolist()):
                known = has_letter(text)
                names.append(self.languages[k // CENTROIDS] if known else UNKNOWN)
                scores.append(x if known else 0.0)
                rejected.append(not known or x < low)
        return names, np.asarray(scores), rejected


def clusters(vectors: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means from the farthest points; unused centroids are zero."""
    centre = vectors.mean(axis=0)
    chosen = [int((vectors @ centre).argmax())]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    made = np.zeros((k, vectors.shape[1]), np.float32)
    made[: len(chosen)] = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ made[: len(chosen)].T).argmax(axis=1)
        for j in range(len(chosen)):
            if (own == j).any():
                total = vectors[own == j].sum(axis=0)
                made[j] = total / max(np.linalg.norm(total), 1e-9)
    return made


def held_out(doc_id) -> "F.Column":
    """Whether crc32 of the id as text leaves 1 when divided by 3; no for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(known: DataFrame, sample: int, languages: int) -> DataFrame | None:
    """``doc_id, lang, text``: of each of the ``languages`` with most rows of
    ``known``, the ``sample`` ids with the least hashes, the least text of each.

    A share of the hashes that surely holds them is read off the number of rows;
    what lies in it goes to the driver, which cuts it to ``sample``. So no task
    holds a language.
    """
    spark, buckets = known.sparkSession, 1 << 32
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return None
    least = sample + int(8 * sample**0.5) + 8
    limits = spark.createDataFrame([(x.lang, min(buckets, -(-least * buckets // x.n))) for x in sizes], "lang string, below long")
    within = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("hash")).join(F.broadcast(limits), "lang").where("hash < below")
    by_language: dict[str, list] = {}
    for x in sorted(within.select("lang", "hash", "doc_id").distinct().collect()):
        by_language.setdefault(x.lang, []).append((x.doc_id, x.lang))
    ids = spark.createDataFrame([x for own in by_language.values() for x in own[:sample]], "doc_id long, lang string")
    return known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """A model of the rows that aren't held out and have an id, a text and a
    language: at most ``sample`` texts of each of ``languages`` languages at
    most, those with most texts. None if there is no such row."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    bounded(docs.sparkSession)
    rows = drawn(known, sample, languages)
    if rows is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        for part, raw in blocks(batches):
            kept = [k for k, x in enumerate(raw) if has_letter(x)]
            at, values = [], []
            for k in kept:
                made = counts([raw[k]])[0]
                at.append(np.flatnonzero(made).astype(np.uint16).tobytes())
                values.append(made[made > 0].tobytes())
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "lang", "at", "n"])

    found = rows.mapInArrow(run, "doc_id long, lang string, at binary, n binary").collect()
    if not found:
        return None
    by_language: dict[str, list] = {}
    for x in sorted(found, key=lambda x: (x.lang, x.doc_id)):
        by_language.setdefault(x.lang, []).append(x)
    # every language counts alike in the document frequencies
    share = np.zeros(DIMENSIONS)
    for own in by_language.values():
        for x in own:
            share[np.frombuffer(x["at"], np.uint16)] += 1 / len(own)
    weights = np.log(1 + len(by_language) / (share + 1 / sample)).astype(np.float32)
    model = Model(sorted(by_language), weights, np.zeros((0, DIMENSIONS), np.float32), np.zeros(1))
    sizes, cosines, centroids = [], [], []
    for language in model.languages:
        made = np.zeros((len(by_language[language]), DIMENSIONS), np.float32)
        for row, x in zip(made, by_language[language]):
            row[np.frombuffer(x["at"], np.uint16)] = np.frombuffer(x["n"], np.float32)
        vectors = model.vectors(made)
        centroids.append(clusters(vectors))
        sizes += np.log2(made.sum(axis=1) + 1).astype(int).tolist()
        cosines += (vectors @ centroids[-1].T).max(axis=1).tolist()
    model.centroids = np.concatenate(centroids)
    sizes, cosines, least = np.asarray(sizes), np.asarray(cosines), np.zeros(40)
    for size in range(1, 40):
        own = cosines[sizes == size]
        least[size] = SLACK * own.min() if len(own) >= LEAST_TEXTS else least[size - 1]
    model.least = least
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, lang_pred, score, rejected``.

    Null texts and those without a letter are ``und``, with score 0, rejected.
    Without a model every text is. Repeated rows are judged each; an empty
    table gives no rows; of the columns only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        model = shared.value
        for part, raw in blocks(batches):
            names, scores, rejected = model.predict(raw) if model else ([UNKNOWN] * len(raw), np.zeros(len(raw)), [True] * len(raw))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    found = id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def rejecting(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns. Without
    a model, all rows with a letter stay."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        model = shared.value
        for part, raw in blocks(batches):
            rejected = model.predict(raw)[2] if model else [not has_letter(x) for x in raw]
            yield part.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
