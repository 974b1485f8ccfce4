"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits or runs of other marks, of the whole text; features are hashed unigrams, bigrams, and one
feature for a token that repeats its predecessor. A document is a sparse vector of sqrt(count / tokens). Training sees a bounded
sample of the labelled rows (`max_rows`, chosen by a hash of the id), in one task; scoring runs in every
partition as sparse dot products against the broadcast weights, whose size (4 * 2**bits bytes) is a parameter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import WordHashes, documents, fold, small_batches

TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
REPEAT = 0x9E3779B97F4A7C15


class Features:
    """Sparse hashed features of texts, by chunks of at most `chunk` bytes (a longer text is a chunk of its own)."""

    def __init__(self, bits: int, chunk: int = 2_000_000):
        self.bits, self.chunk, self.words = bits, chunk, WordHashes()

    def _one(self, text: bytes) -> np.ndarray:
        h = self.words.of(TOKEN.findall(text))
        if not len(h):
            return h
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
        two *= np.uint64(0xFF51AFD7ED558CCD)
        two[h[:-1] == h[1:]] = np.uint64(REPEAT)
        return np.concatenate([h, two]) >> np.uint64(64 - self.bits)

    def of(self, texts):
        """Yields (number of texts, row of each entry, feature, value) for runs of texts."""
        at = 0
        while at < len(texts):
            parts, size, first = [], 0, at
            while at < len(texts) and (not parts or size + len(texts[at]) <= self.chunk):
                parts.append(self._one(texts[at]))
                size += len(texts[at])
                at += 1
            lengths = np.array([len(p) for p in parts])
            row = np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)
            key, count = np.unique((row << np.uint64(self.bits)) | np.concatenate(parts).astype(np.uint64), return_counts=True)
            row = (key >> np.uint64(self.bits)).astype(np.int64)
            total = np.maximum(lengths, 1)
            yield at - first, row, (key & np.uint64((1 << self.bits) - 1)).astype(np.int64), np.sqrt(count / total[row])


def ftrl(rows, dim: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """rows: list of (features, values, label 0/1). Returns the weights; the last one is the bias."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rows = [(np.append(f, dim), np.append(v, 1.0), y) for f, v, y in rows]
    for _ in range(epochs):
        for f, v, y in rows:
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            new = nf + g * g
            z[f] = zf + g - (np.sqrt(new) - root) / alpha * w
            n[f] = new
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def _train(bits: int, **how):
    def run(batches):
        rows, feats = [], Features(bits)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ys, at = batch.column("label").to_pylist(), 0
            for n, row, feature, value in feats.of(texts):
                cuts = np.searchsorted(row, np.arange(n + 1))
                for i in range(n):
                    rows.append((feature[cuts[i] : cuts[i + 1]].astype(np.int32), value[cuts[i] : cuts[i + 1]].astype(np.float32), ys[at + i]))
                at += n
        if rows:
            w = ftrl(rows, 1 << bits, **how)
            keep = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(keep, pa.int32()), "weight": pa.array(w[keep], pa.float32())})

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, max_rows: int = 6_000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> np.ndarray:
    """Weights learned from at most max_rows labelled documents; docs (doc_id, text), labels (doc_id, label 0/1).

    Null labels teach nothing; of several labels for one id the smallest holds, of several texts the one with the least hash. Without rows all weights are 0.
    """
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id")
    chosen = (
        labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(order, "doc_id").limit(max_rows)
    )
    # at most max_rows ids: a proven bound
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id's texts count once: max_rows bounds the task whatever repeats
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("r")).select("doc_id", "r.*")
    one = sample.withColumn("o", order).repartition(1).sortWithinPartitions("o", "doc_id").select("text", "label")
    found = one.mapInArrow(_train(bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs), "feature int, weight float").toArrow()
    w = np.zeros((1 << bits) + 1, np.float32)
    w[found.column("feature").to_numpy()] = found.column("weight").to_numpy()
    return w


def _score(weights, bits: int, text: str | None):
    """Batches of (others, _text or the field `text` of others)."""

    def run(batches):
        w, feats = weights.value, Features(bits)
        for batch in batches:
            others = batch.column("others")
            column = batch.column("_text") if text is None else others.field(text)
            texts = [(t or "").encode() for t in column.to_pylist()]
            out = []
            for n, row, feature, value in feats.of(texts):
                m = np.bincount(row, weights=w[feature] * value, minlength=n) + w[-1]
                out.append(1 / (1 + np.exp(-np.clip(m, -35, 35))))
            del texts
            yield pa.RecordBatch.from_pydict({"others": others, "score": pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())})

    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of docs and a column `name` (double, 0 to 1) scoring the whole text.

    Null and empty texts get the bias's score; repeated rows equal scores; an empty table gives no rows. `keep` may hold the text but not `name`;
    columns may have any names.
    """
    bits = (len(weights) - 1).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(weights)
    small_batches(docs.sparkSession)
    inside = text in keep  # the text crosses to Python once
    others = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("others")
    rows = docs.select(others) if inside else docs.select(others, F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["others"], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_score(held, bits, text if inside else None), schema)
    return out.select("others.*", F.col("score").alias(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns from labels whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    w = train(docs, labels.where(fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label")))
    return score(docs, w, ["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
