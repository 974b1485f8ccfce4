"""Language identification with error-correcting output codes over byte trigrams.

Languages get codewords; one binary logistic classifier for each bit predicts it from the mean weight of the text's hashed byte
trigrams. Decoding adds the logistic losses of the margins against every codeword and takes the least; a
second codeword within `margin` flags the row as ambiguous. Training sees a bounded sample of labelled rows (at most `max_rows`, the same number of each
language as far as it has so many, chosen by a hash of the id) in one task; scoring reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, fold, small_batches

LETTER = re.compile(r"[^\W\d_]")
SCALE = 30.0


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of -1/+1: exhaustive up to six classes, else the best spread of random candidates."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        bits = np.arange(1, 1 << (k - 1))
        code = np.vstack([np.zeros(len(bits), np.int64), *((bits >> i) & 1 for i in range(k - 1))])
        return code * 2.0 - 1
    rng, n = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(k)))
    words = [rng.integers(0, 2, n)]
    while len(words) < k:
        some = rng.integers(0, 2, (64, n))
        words.append(some[np.argmax([min((w != s).sum() for w in words) for s in some])])
    return np.array(words) * 2.0 - 1


def trigrams(text: bytes, bits: int) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes with a space at either end; never empty."""
    b = np.frombuffer(b" " + text.lower() + b"  ", np.uint8).astype(np.uint32)
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _learn(bits: int, epochs: int, rate: float):
    def run(batches):
        rows, langs = [], []
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                f, n = np.unique(trigrams(text.encode(), bits), return_counts=True)
                rows.append((f.astype(np.int32), (n * (SCALE / n.sum())).astype(np.float32)))
                langs.append(lang)
        if not rows:
            return
        known = sorted(set(langs))
        code = codewords(len(known))
        target = {lang: (code[i] + 1) / 2 for i, lang in enumerate(known)}
        w, g2 = np.zeros((1 << bits, code.shape[1])), np.full((1 << bits, code.shape[1]), 1e-4)
        b = np.zeros(code.shape[1])
        for _ in range(epochs if len(known) > 1 else 0):
            for (f, x), lang in zip(rows, langs):
                err = 1 / (1 + np.exp(-np.clip(x @ w[f] + b, -35, 35))) - target[lang]
                g = x[:, None] * err
                s = g2[f] + g * g
                g2[f] = s
                w[f] -= rate * g / np.sqrt(s)
                b -= 0.02 * err
        yield pa.RecordBatch.from_pydict(
            {"langs": pa.array([known], pa.list_(pa.string())), "weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([b.tolist()], pa.list_(pa.float64()))}
        )

    return run


def train(rows: DataFrame, bits: int = 16, max_rows: int = 4_000, epochs: int = 2, rate: float = 0.3):
    """(languages, codewords, weights, bias) from at most max_rows rows of rows (doc_id, text, lang); null texts, ids and languages teach nothing.

    Every language has max_rows / languages ids or all it has; more than max_rows languages raise ValueError. Of several rows of one id the one with the least hash teaches.
    """
    small_batches(rows.sparkSession)
    order = F.xxhash64("doc_id")
    known = rows.where("text is not null and lang is not null and doc_id is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_rows + 1).collect()
    if len(sizes) > max_rows:
        raise ValueError(f"more than {max_rows} languages")
    share = max_rows // max(1, len(sizes))
    # ids under a threshold of the hash: half as many again as wanted and a few, so that the window below holds a bounded sample
    limit = rows.sparkSession.createDataFrame([(r.lang, min(1.0, (1.5 * share + 100) / r.n)) for r in sizes], "lang string, part double")
    some = known.select("doc_id", "lang").join(F.broadcast(limit), "lang").where((F.pmod(order, F.lit(1 << 53)) / float(1 << 53)) < F.col("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    ids = some.select("doc_id", "lang").distinct().withColumn("place", place).where(F.col("place") <= share).select("doc_id").distinct()
    # at most max_rows ids: a proven bound
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id", "left_semi")
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("r")).select("doc_id", "r.*")
    one = sample.withColumn("o", order).repartition(1).sortWithinPartitions("o", "doc_id").select("text", "lang")
    found = one.mapInArrow(_learn(bits, epochs, rate), "langs array<string>, weights binary, bias array<double>").first()
    if found is None:
        return [], codewords(0), np.zeros((1 << bits, 1), np.float32), np.zeros(1)
    code = codewords(len(found.langs))
    return list(found.langs), code, np.frombuffer(bytes(found.weights), "<f4").reshape(1 << bits, -1), np.array(found.bias)


def _predict(model, margin: float, chunk: int):
    def run(batches):
        langs, code, w, b = model.value
        bits = len(w).bit_length() - 1
        w = np.ascontiguousarray(w)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = np.zeros((len(texts), w.shape[1]))
            at = 0
            while at < len(texts):
                parts, size, first = [], 0, at
                while at < len(texts) and (not parts or size + len(texts[at] or "") <= chunk):
                    parts.append(trigrams((texts[at] or "").encode(), bits))
                    size += len(texts[at] or "")
                    at += 1
                lengths = np.array([len(p) for p in parts])
                flat, starts = np.concatenate(parts), np.r_[0, np.cumsum(lengths)]
                for lo in range(0, len(flat), 4 * chunk):  # a very long text goes in pieces
                    hi = min(lo + 4 * chunk, len(flat))
                    some = w[flat[lo:hi]]
                    i, j = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
                    sums[first + i : first + j] += np.add.reduceat(some, np.maximum(starts[i:j] - lo, 0), axis=0)
                sums[first:at] *= (SCALE / lengths)[:, None]
            loss = np.logaddexp(0, -(sums + b)[:, None, :] * code[None]).sum(axis=2) if langs else np.zeros((len(texts), 0))
            pred, score, doubt = [], [], []
            for text, row in zip(texts, loss):
                if not langs or text is None or not LETTER.search(text):
                    pred.append("und")
                    score.append(0.0)
                    doubt.append(True)
                    continue
                best = int(row.argmin())
                p = np.exp(row[best] - row)
                pred.append(langs[best])
                score.append(float(1 / p.sum()))
                doubt.append(bool(len(row) > 1 and np.partition(row, 1)[1] - row[best] < margin))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(doubt, pa.bool_())}
            )

    return run


def identify(docs: DataFrame, model, margin: float = 0.7, chunk: int = 500_000) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of docs (doc_id, text).

    Null texts, texts without a letter and a model without languages give `und` with score 0 and ambiguous true. Repeated rows
    get equal answers; very long texts are read whole, in pieces. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(held, margin, chunk), "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learns from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
