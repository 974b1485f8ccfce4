"""Pipeline stages against plain versions on a small corpus with edge rows and clashing columns."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import EDGE, check_packing, jaccard_classes

import corpus_pipeline
from tallyframe.llm import common, quality

SF = "/root/testdata/sf0.001"
CLASH = {"score": 1.5, "tag": 7, "raw": b"x", "ranges": "r", "removed": 1, "others": "o", "row": 2, "mix_tokens": 3, "mix_note": 8, "key": 9, "did": 10, "rep": 4, "kept": True, "a.b": 5}


@pytest.fixture(scope="module")
def docs(spark):
    own = common.documents(spark, SF)
    rows = spark.createDataFrame([(i, t, None, None if n % 2 else "src0", None) for n, (i, t) in enumerate(EDGE)], own.schema)
    out = own.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    return common.cut(out.withColumns({k: F.lit(v) for k, v in CLASH.items()}), "corpus")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_match_plain_versions(spark, docs):
    names, stages = zip(*corpus_pipeline.STAGES)
    now = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = common.cut(stage(spark, now, SF), "stage")
        if name != names[-1]:
            assert result.columns == now.columns
        out[name] = (now, result)
        now = result
    before, after = out["quality classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    w = quality.train(before, labels.where(common.fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label")))
    assert Counter(rows_of(after)) == Counter(r for r in rows_of(before) if plain_score(r[1], w) >= 0.5)

    before, after = out["MinHash near-dedup"]
    worded = [r for r in set(rows_of(before)) if (r[1] or "").encode().split()]
    comp, _ = jaccard_classes(worded, 5, 80)
    want = Counter(r for r, c in zip(worded, comp) if r[0] == c and r[0] is not None) + Counter(r for r in rows_of(before) if not (r[1] or "").encode().split())
    alone = [r for r, c in zip(worded, comp) if c is None]
    assert len(alone) == len({t for _, t in alone})  # no two rows without ids are copies here
    assert Counter(rows_of(after)) == want + Counter(alone)

    before, after = out["suffix-array dedup"]
    assert Counter(rows_of(after)) == Counter((i, t) for i, t, removed in without_repeats(rows_of(before), 200) if not removed or t.strip(" \t\n\r\x0b\f"))
    assert any(removed for *_, removed in without_repeats(rows_of(before), 200))

    before, after = out["mixing sources to target weights"]
    times = Counter(rows_of(after))
    assert set(times) == set(rows_of(before))
    once = Counter(rows_of(before))
    assert all(once[r] <= n <= 3 * once[r] for r, n in times.items())
    tokens = lambda df: {r.source: r.t for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("t")).collect()}
    a, b = tokens(before), tokens(after)
    assert all(b[s] <= 2 * a[s] for s in a if a[s])

    before, after = out["packing"]
    padding, total = check_packing(rows_of(before), after.collect(), 2048)
    assert padding <= 0.02 * total


def without_repeats(rows, length):
    """(id, text left, bytes removed) by brute force over all strings of `length` bytes."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for (i, t), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((i, None if t is None else bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"), int(gone.sum())))
    return out


def plain_score(text, w):
    bits = (len(w) - 1).bit_length() - 1
    words = quality.WordHashes()
    h = [words[t] for t in quality.TOKEN.findall((text or "").encode())]
    mask, found = common.MASK64, Counter()
    for x in h:
        found[x >> (64 - bits)] += 1
    for x, y in zip(h, h[1:]):
        two = quality.REPEAT if x == y else ((((x * 0x9E3779B97F4A7C15) & mask) ^ (y >> 7) ^ y) * 0xFF51AFD7ED558CCD) & mask
        found[two >> (64 - bits)] += 1
    n = max(1, sum(found.values()))
    m = sum(float(w[f]) * math.sqrt(c / n) for f, c in found.items()) + float(w[-1])
    return 1 / (1 + np.exp(-m))


def test_stages_of_an_empty_table(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_gives_packed_sequences(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
