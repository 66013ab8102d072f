"""The corpus pipeline: language, near duplicates, benchmark, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before has kept, and returns a table with the columns of ``documents``; the
last one returns the packing. Between stages the table is written as Parquet
to the shared folder and read again, so that a lost executor costs a stage's
tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm.common import staged, table
from graphspark.llm.decontamination import uncontaminated
from graphspark.llm.language import fit, rejecting
from graphspark.llm.near_duplicates import near_duplicates
from graphspark.llm.packing import pack
from graphspark.llm.pii import find_personal_data, masked

#: Ids that may be broadcast; beyond that, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Texts are near duplicates from this similarity of their five-word shingles on.
NEAR_PERCENT = 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``ids(gone)``; rows without an id stay."""
    ids = staged(ids.where("gone IS NOT NULL").distinct(), "gone")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that language identification rejects go; all columns stay as they are."""
    return rejecting(docs, fit(docs))


def apart(docs: DataFrame) -> DataFrame | None:
    """``row, number, text``: a number, ordered as the ids, for each distinct
    ``(doc_id, text)``; null without an id. None if no id has several texts."""
    rows = docs.select(F.struct(*(docs[f"`{x}`"] for x in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    ids = rows.where("doc IS NOT NULL").groupBy("doc").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
    if ids.where("low <> high").isEmpty():
        return None
    keys = rows.where("doc IS NOT NULL").select("doc", "text_key").distinct().orderBy("doc", "text_key")
    keys = staged(keys.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return staged(rows.join(keys, ["doc", "text_key"], "left").select("row", "number", "text"), "numbered")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the
    least id, once. Rows without an id stay. Rows with one id and different
    texts are judged each."""
    rows = apart(docs)
    if rows is not None:
        rest = near_duplicate(spark, rows.withColumnRenamed("number", "doc_id"), sf_dir)
        return rest.select("row.*")
    found = staged(near_duplicates(docs, NEAR_PERCENT), "near")
    rest = without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")))
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if twice.isEmpty():
        return rest
    repeated = rest.join(twice.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return without(rest, twice.select(F.col("doc_id").alias("gone"))).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, whatever their id."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    out = masked(docs, find_personal_data(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Nearest centroids and token packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
