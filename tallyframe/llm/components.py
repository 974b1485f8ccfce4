"""Connected components over a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two equi-joins; nothing about links or components
reaches the driver but a count and a checksum of the round's links. Hot nodes are safe: minima combine before the shuffle, and
minima are written before they are joined, so that
both sides of a join are shuffled for it and adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, drop


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (u long, v long), either direction, repeats and self links allowed.

    Returns (id, component_id): one row for each node that has a link to another, with the smallest id reachable.
    An empty table gives an empty table. Raises if the rounds do not converge.
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large")
        # each row of large has u > v; the small star hangs u's links on its least neighbour
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = cut(small, "links")
        now = _mark(new)
        for used in (edges, low, large, least):
            drop(used)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
        edges.groupBy(F.col("v").alias("id")).agg(F.min("v").alias("component_id"))
    )
