"""Shared folder, lineage cuts and hashing helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = getattr(spark, "_tallyframe_shared", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark._tallyframe_shared = own
    return own


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python holds of a partition at once, as texts can be long; a bound of the session that is smaller stays.

    Spark reads the bound when a plan runs, so it holds for the session.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: computed once, and safe from lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallyframe_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote once nothing reads it any more."""
    path = getattr(df, "_tallyframe_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def told_apart(id_column: str = "doc_id") -> tuple[Column, Column]:
    """did and tag of a text: the id (0 for null) and a hash of the text and of whether the id is null. Neither is ever null, so they join plainly."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("did"), F.xxhash64("text", F.col(id_column).isNull()).alias("tag")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, buckets: int):
    """crc32 of the id's decimal text, modulo buckets: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array (wraps modulo 2**64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i]-b[i] (ids) as a spanning star forest: (id, smallest id it reaches here), roots left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]
