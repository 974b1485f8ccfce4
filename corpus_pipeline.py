"""Corpus pipeline over `documents`: quality, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import common, minhash, mixing, packing, quality, suffix_dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more. It learns from the labels whose crc32(doc_id) mod 3 is not 1 and the texts that docs has for them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(common.fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels)
    name = free_name("score", docs)
    return quality.score(docs, weights, docs.columns, name=name).where(F.col(name) >= 0.5).drop(name)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each class linked on five-word shingles at 0.8 or more. Different texts of one id are documents of their own; rows
    without words stay."""
    return minhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 200 bytes; documents of which only white space is left go."""
    out = suffix_dedup.without_repeats(docs).where(F.expr("removed = 0") | F.col("text").rlike(r"\S"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("others.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*(own.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The most even mix that repeats no source more than twice and keeps every document; a row for each copy."""
    return mixing.realise(docs, max_passes=2.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def free_name(base: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while base in docs.columns:
        base += "_"
    return base


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]
#: Hashing, tokenizing and training cannot be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = common.cut(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
