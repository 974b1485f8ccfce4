"""Byte lineage: from which input bytes each output byte of a chain of reformatting steps comes.

A BUILD moves byte ranges, so a step is rows (out_start, length, in_start, null for literals) and two steps compose by overlap of ranges. Ranges meet
in cells of CELL bytes: an equi-join on (chain, step, cell), each pair taken once, in the cell where the overlap starts. Steps compose in pairs, so a chain of n takes
log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .settle import settled

CELL = 64


def parts_of(build: DataFrame, keys: list[str]) -> DataFrame:
    """build (*keys, place, in_start or null, length): the cards of BUILDs in order, with out_start from the lengths before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # the cards of one BUILD
    return build.select(*keys, (F.coalesce(F.sum("length").over(w), F.lit(0)) + 1).cast("long").alias("out_start"), F.col("length").cast("long").alias("length"), F.col("in_start").cast("long").alias("in_start"))


def _cells(df: DataFrame, start: str) -> DataFrame:
    return df.withColumn("cell", F.explode(F.expr(f"sequence(div({start}, {CELL}), div({start} + length - 1, {CELL}))")))


def _after(first: DataFrame, second: DataFrame) -> DataFrame:
    """(chain, step, out_start, length, in_start) of second's ranges traced through first's, on equal (chain, step)."""
    a = _cells(first.select("chain", "step", F.col("out_start").alias("mid"), "length", F.col("in_start").alias("from")), "mid").withColumnRenamed("length", "length_a")
    moved = second.where("in_start is not null")
    b = _cells(moved.select("chain", "step", "out_start", "length", F.col("in_start").alias("read")), "read")
    low, high = F.greatest("mid", "read"), F.least(F.expr("mid + length_a"), F.expr("read + length"))
    met = b.join(a, ["chain", "step", "cell"]).where((low < high) & (F.expr(f"div(greatest(mid, read), {CELL})") == F.col("cell")))
    return met.select("chain", "step", (F.col("out_start") + low - F.col("read")).alias("out_start"), (high - low).alias("length"), (F.col("from") + low - F.col("mid")).alias("in_start")).unionByName(
        second.where("in_start is null")
    )


def traced(steps: DataFrame) -> DataFrame:
    """steps (chain, step from 0 without gaps, out_start, length, in_start): (chain, out_start, length, in_start) over all steps of each chain.

    Bytes that a step reads beyond what the step before wrote come from nowhere and have no row; literals have a null in_start; ranges of no length are left out.
    """
    now = settled(steps.select("chain", F.col("step").cast("long").alias("step"), "out_start", "length", "in_start").where("length > 0"))
    last = settled(steps.groupBy("chain").agg(F.max("step").cast("long").alias("last")))
    while not last.where("last > 0").isEmpty():
        half = F.shiftright("step", 1)
        first = now.where("step % 2 = 0").withColumn("step", half)
        second = now.where("step % 2 = 1").withColumn("step", half)
        alone = first.join(last.where("last % 2 = 0").select("chain", F.shiftright("last", 1).alias("step")), ["chain", "step"], "left_semi")
        paired = first.join(alone.select("chain", "step").distinct(), ["chain", "step"], "left_anti")
        now = settled(_after(paired, second).unionByName(alone.select(*second.columns)))
        last = settled(last.select("chain", F.shiftright("last", 1).alias("last")))
    return now.select("chain", "out_start", "length", "in_start")
