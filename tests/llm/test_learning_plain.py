"""The two learned operators against plain versions written with dicts and loops."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, langid, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("o")).collect()
    return sorted(rows, key=lambda r: (r.o, r.doc_id))


def plain_features(text, bits):
    words = quality.WordHashes()
    h = [words[t] for t in quality.TOKEN.findall((text or "").encode())]
    n = Counter(x >> (64 - bits) for x in h)
    for x, y in zip(h, h[1:]):
        two = quality.REPEAT if x == y else ((((x * 0x9E3779B97F4A7C15) & common.MASK64) ^ (y >> 7) ^ y) * 0xFF51AFD7ED558CCD) & common.MASK64
        n[two >> (64 - bits)] += 1
    total = max(1, sum(n.values()))
    return {f: math.sqrt(c / total) for f, c in n.items()}


def test_quality_by_a_plain_version(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learn = [r for r in texts if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    alpha, beta, l1, l2, bits = 0.5, 1.0, 0.05, 0.01, 20
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    rows = [(plain_features(r.text, bits) | {-1: 1.0}, labels[r.doc_id]) for r in learn]
    for _ in range(3):
        for x, y in rows:
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    got = {r.doc_id: r for r in quality.op1_quality(spark, SF).collect()}
    assert len(got) == len(texts) and len(rows) > 40
    for r in texts:
        x = plain_features(r.text, bits) | {-1: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))
        o = got[r.doc_id]
        assert o.score == pytest.approx(p, abs=1e-4) and o.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert o.predicted == int(o.score >= 0.5)


def plain_trigrams(text, bits):
    b = b" " + text.lower() + b"  "
    return Counter((((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761) & 0xFFFFFFFF) >> (32 - bits) for i in range(len(b) - 2))


def test_language_by_a_plain_version(spark, texts):
    """Training on few rows, and decoding of all, by loops over the codewords' bits."""
    bits, share = 10, 4
    by_lang = defaultdict(list)
    for r in texts:
        if r.text and r.lang and len(by_lang[r.lang]) < share:
            by_lang[r.lang].append(r)
    known = sorted(by_lang)
    learn = sorted((r for rows in by_lang.values() for r in rows), key=lambda r: (r.o, r.doc_id))
    code = langid.codewords(len(known))
    k = code.shape[1]
    w, g2, bias = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [1e-4] * k), [0.0] * k

    def weights(text):
        n = plain_trigrams(text.encode(), bits)
        return {f: c * langid.SCALE / sum(n.values()) for f, c in n.items()}

    def margins(x):
        return [sum(v * w[f][j] for f, v in x.items()) + bias[j] for j in range(k)]

    for _ in range(2):
        for r in learn:
            x = weights(r.text)
            err = [1 / (1 + math.exp(-max(-35, min(35, m)))) - (code[known.index(r.lang)][j] + 1) / 2 for j, m in enumerate(margins(x))]
            for f, v in x.items():
                for j in range(k):
                    g = v * err[j]
                    g2[f][j] += g * g
                    w[f][j] -= 0.3 * g / math.sqrt(g2[f][j])
            for j in range(k):
                bias[j] -= 0.02 * err[j]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"), bits=bits, max_rows=share * len(known))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in texts:
        o = got[r.doc_id]
        if not r.text or not langid.LETTER.search(r.text):
            assert (o.lang_pred, o.score) == ("und", 0.0)
            continue
        m = margins(weights(r.text))
        loss = [sum(math.log1p(math.exp(-m[j] * c[j])) if -m[j] * c[j] < 30 else -m[j] * c[j] for j in range(k)) for c in code]
        best = min(range(len(known)), key=loss.__getitem__)
        assert o.score == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-3)
        if sorted(loss)[1] - loss[best] > 1e-3:
            assert o.lang_pred == known[best]


def test_rare_languages_and_repeated_ids_are_learned(spark):
    """One language in a thousand is learned, and an id that repeats does not crowd out others."""
    common_rows = spark.range(3000).select("id", F.concat(F.lit("the cat and the dog "), "id").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(5000 + i, f"der hund und die katze {i}", "de") for i in range(3)], "id long, text string, lang string")
    same = spark.range(500).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("the other text "), "id").alias("text"), F.lit("en").alias("lang"))
    rows = common_rows.unionByName(rare).unionByName(same).withColumnRenamed("id", "doc_id")
    model = langid.train(rows, max_rows=200)
    assert model[0] == ["de", "en"]
    got = langid.identify(spark.createDataFrame([(1, "und der hund"), (2, "and the dog")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["de", "en"]
    with pytest.raises(ValueError):
        langid.train(rows.withColumn("lang", F.col("doc_id").cast("string")), max_rows=200)
