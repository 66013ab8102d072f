"""Shared helpers: tables of a folder, the shared folder, Arrow blocks, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python block holds, a single longer text excepted.
BLOCK_BYTES = 1 << 20
#: Entries that a worker's word cache holds before it is emptied.
CACHE_ENTRIES = 150_000
#: Bytes after which an Arrow batch from the JVM to Python ends.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, by any path Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that driver and executors share;
    an own one, removed at the end, only in local mode."""
    app = spark.sparkContext.applicationId
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return f"{told.rstrip('/')}/staged-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"/tmp/graphspark-staged/{app}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def drop_staged(spark: SparkSession) -> None:
    """Removes the tables that this application has staged; results that still
    read them must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: later stages
    neither compute it again nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small by their bytes, if the session allows larger ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column can clash."""
    bounded(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text at most, and
    their texts as UTF-8 (null: empty)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in pc.cast(part.column(part.schema.get_field_index(column)), pa.binary()).to_pylist()]
            at = end
    # the worker goes on to other tasks, perhaps of another kind
    WORD_HASHES.clear()
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, computed once for each entry."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()

#: What this worker keeps from task to task: the tables of one operator.
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object] = dict) -> object:
    """The worker's tables ``name``, made if need be; those of the operator that
    it ran before are dropped first, so that a worker that goes from stage to
    stage of a pipeline doesn't gather all of them."""
    if name not in _HELD:
        _HELD.clear()
        WORD_HASHES.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
        _HELD[name] = make()
    return _HELD[name]


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX2
    x = (x ^ (x >> np.uint64(32))) * MIX2
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (over document borders too)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= MIX
        out ^= out >> np.uint64(29)
        out += hashes[k : k + m]
    return mixed(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sha256_hex(column) -> "F.Column":
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


Query = Callable[[SparkSession, str], DataFrame]
