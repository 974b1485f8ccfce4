"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected to meet a target entropy or
a limit on repetition. The driver sees one row for each source, at most `max_sources`. A source's budget is a number of whole passes and a part of
one: its documents lie in blocks by a hash, blocks are permuted by a seeded hash, and the partial pass takes blocks in that order until its
tokens are spent. The order of blocks and the place in a block are returned, so that sorting by them realises the permutation. Each source needs only the place where
its budget ends: 1,024 ranges of the order are summed first, then the blocks of the range where it ends, then the documents of that block, so no
window holds more than a thousandth of a source's blocks. Documents meet that place in a join with one row for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, documents

#: Sources up to which their plan is broadcast by hint.
MOST_HINTED = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def shares(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    w = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    return [x / sum(w) for x in w]


def entropy(weights: list[float]) -> float:
    """In bits."""
    return -sum(w * math.log2(w) for w in weights if w > 0)


def passes(tokens: list[float], exponent: float, budget: float | None) -> list[float]:
    """Passes over each source; without a budget the least repeated source gets exactly one."""
    rate = [w / t if t > 0 else 0.0 for w, t in zip(shares(tokens, exponent), tokens)]
    budget = 1 / min(r for r in rate if r > 0) if budget is None else budget
    return [r * budget for r in rate]


def bisect_exponent(good, lo: float, hi: float) -> float:
    """The least exponent in [lo, hi] for which good() holds, given that it holds from some exponent on; hi if it never does."""
    if good(lo):
        return lo
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def plan_weights(tokens: list[float], budget: float | None = None, max_passes: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent: the most even mix within max_passes, or the mix whose entropy (bits) comes down to target_entropy."""
    if (max_passes is None) == (target_entropy is None):
        raise ValueError("give max_passes or target_entropy")
    known = [t for t in tokens if t > 0]
    if len(known) < 2:
        return 1.0
    if max_passes is not None:
        return bisect_exponent(lambda x: max(passes(known, x, budget)) <= max_passes, 0.0, 1.0)
    return bisect_exponent(lambda x: entropy(shares(known, x)) <= target_entropy, 0.0, 16.0)


def names_for(columns: list[str], prefix: str = "mix") -> dict[str, str]:
    """The columns that mix() adds, with underscores after a name that is taken."""
    out = {}
    for k in ("tokens", "weight", "block", "order", "place", "copies"):
        name = f"{prefix}_{k}"
        while name in columns:
            name += "_"
        out[k] = name
    return out


def word_count(text: str = "text"):
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, budget: float | None = None, max_passes: float | None = None, target_entropy: float | None = None,
    block_docs: int = 4096, seed: int = 1, prefix: str = "mix", tokens: str | None = None, max_sources: int = 1_000_000,
) -> DataFrame:
    """docs (doc_id, text, source, any others): docs with its tokens, its source's weight, its block, the block's order, its place in the block, and copies.

    The columns are named by names_for(). Tokens are words between white space, or the column `tokens`; null and empty texts have none, cost nothing, and get the
    source's whole passes and the rest of its permutation as it comes. Null is a
    source of its own. Without a budget it is the least at which no source is cut below one pass, so every document stays. A budget is
    never exceeded by the partial pass. Ties of the hash are broken by id, tokens and text; repeated rows count each. An empty table gives no rows.
    Columns may have any names. Raises ValueError for more than max_sources sources. The texts are read once, into a table of the shared folder.
    """
    spark = docs.sparkSession
    names = names_for(docs.columns, prefix)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    count = word_count() if tokens is None else F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"), count.alias("tokens"), "doc_id", F.xxhash64("text").alias("tag"))
    rows = cut(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "tag")), "counted")
    held = rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(held) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    held.sort(key=lambda r: r.key)
    sums = [float(r.tokens) for r in held]
    plan = []
    if any(sums):
        exponent = plan_weights(sums, budget, max_passes, target_entropy)
        for r, w, e in zip(held, shares(sums, exponent), passes(sums, exponent, budget)):
            whole = math.floor(e + 1e-9)
            part = max(0, math.floor((e - whole) * r.tokens + 1e-6)) if r.tokens else 0
            plan.append((r.key, w, whole if r.tokens else 1, part, max(1, math.ceil(r.docs / block_docs))))
    else:
        plan = [(r.key, 0.0, 1, 0, 1) for r in held]
    hint = F.broadcast if len(plan) <= MOST_HINTED else lambda df: df  # beyond that Spark's own size check decides
    plan = spark.createDataFrame(plan, "key string, weight double, whole int, part long, blocks long")
    rows = rows.join(hint(plan), "key").withColumn("block", F.pmod("h", "blocks"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "block")).withColumn("place", F.xxhash64(F.lit(seed + 2), "h"))
    blocks = cut(rows.where("part > 0").groupBy("key", "order", "block", "part").agg(F.sum("tokens").alias("t")).withColumn("range", F.shiftright("order", 54)), "blocks")
    ranges = _edge(blocks.groupBy("key", "part", "range").agg(F.sum("t").alias("t")), ["range"], F.lit(0))
    inner = blocks.join(hint(ranges.select("key", "range", F.col("before").alias("base"))), ["key", "range"])
    edge = _edge(inner, ["order", "block"], F.col("base")).select("key", F.struct("order", "block").alias("edge"), "before")
    rows = rows.join(hint(edge), "key", "left")
    at = F.struct("order", "block")
    inside, split = F.coalesce(at < F.col("edge"), F.lit(False)), F.coalesce(at == F.col("edge"), F.lit(False))
    base = rows.where(~split).withColumn("copies", F.col("whole") + inside.cast("int"))
    within = Window.partitionBy("key", "order", "block").orderBy("place", "doc_id", "tokens", "tag").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where(split).withColumn("spent", F.sum("tokens").over(within))
    last = last.withColumn("copies", F.col("whole") + (F.col("before") + F.col("spent") <= F.col("part")).cast("int")).drop("spent")
    return base.unionByName(last).select("row.*", *(F.col(k).alias(v) for k, v in names.items()))


def _edge(sums: DataFrame, order: list[str], base) -> DataFrame:
    """Of sums (key, part, t, order...): for each key the last row, in this order, before which at most `part` is spent, and `before`, what is."""
    spent = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", base + F.sum("t").over(spent) - F.col("t")).where("before <= part")
    return sums.groupBy("key").agg(F.max(F.struct("before", *order)).alias("e")).select("key", "e.*")


def realise(docs: DataFrame, prefix: str = "mix", **how) -> DataFrame:
    """mix(), with one row for each copy and the columns of docs alone; copies of 0 go."""
    names = names_for(docs.columns, prefix)
    mixed = mix(docs, prefix=prefix, **how)
    times = F.explode(F.array_repeat(F.lit(0), F.col(names["copies"])))
    rows = mixed.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), times.alias("copy"))
    return rows.select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their copies in the most even mix that repeats no source more than twice and keeps every document."""
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("tokens"), F.xxhash64("text").alias("text"))
    return mix(docs, max_passes=2.0, tokens="tokens").select(
        "doc_id", "source", "tokens", *(F.col(f"mix_{k}").alias(k) for k in ("weight", "block", "order", "place", "copies"))
    )
