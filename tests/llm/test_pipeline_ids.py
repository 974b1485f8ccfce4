"""Rows of one id with different texts in the pipeline's MinHash stage."""

from collections import Counter

import corpus_pipeline
from test_llm_operators import DOC


def test_texts_that_share_an_id_are_documents(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (1, b), (1, b), (2, c), (3, a), (4, b + " more"), (5, None), (5, ""), (None, a), (None, a), (None, c + " z"), (None, "alone"), (None, "alone")]
    for n in (1, 7):
        got = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, DOC).repartition(n), "")
        assert got.columns == ["doc_id", "text"]
        assert Counter(map(tuple, got.collect())) == Counter([(1, a), (1, b), (2, c), (5, None), (5, ""), (None, "alone")])


def test_rows_keep_their_other_columns(spark):
    """Of equal rows one stays whole, whatever the partitions; a text of line ends only goes once its repeats are cut."""
    a = " ".join(f"alpha{i}" for i in range(60))
    rows = [(1, a, "x", 1), (1, a, "y", 2), (2, a + "\n\n", "z", 3), (3, "\n \t", "w", 4), (4, " ".join(f"beta{i}" for i in range(60)), "v", 5)]
    seen = set()
    for n in (1, 5):
        docs = spark.createDataFrame(rows, f"{DOC}, note string, mix_note int").repartition(n)
        got = corpus_pipeline.minhash_dedup(spark, docs, "").collect()
        seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1 and {r[0] for r in next(iter(seen))} == {1, 3, 4}
    cut = corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(rows[1:4], f"{DOC}, note string, mix_note int"), "").collect()
    assert sorted(map(tuple, cut)) == [(3, "\n \t", "w", 4)]
