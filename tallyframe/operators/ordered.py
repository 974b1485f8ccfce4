"""What earlier rows of a key say about a row, for keys of any number of rows: rows are sorted over range partitions of (key, order), each partition is summed up
for its keys, and the sums of the partitions before come in by an equi-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .settle import settled


def before(df: DataFrame, by: list[str], order: list, values: dict[str, Callable[[], Column]], join: Callable[[Column, Column], Column]) -> DataFrame:
    """df with, for each name of values, an aggregate over the rows of the key that come earlier in order (null if there are none).

    values[name]() is an aggregate expression over df's columns that also works over parts, put together by join(earlier part, later part); both may be null.
    The order must be total within a key; a null key is a key.
    """
    rows = settled(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("part__", F.spark_partition_id()))
    parts = rows.groupBy(*by, "part__").agg(*(v().alias(f"{n}__part") for n, v in values.items()))
    earlier = Window.partitionBy(*by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds some of the key
    lists = parts.select(*by, "part__", *(F.collect_list(F.struct(F.col(f"{n}__part").alias("v"))).over(earlier).alias(f"{n}__list") for n in values))
    folded = {}
    for n in values:
        kind = dict(parts.dtypes)[f"{n}__part"]
        folded[f"{n}__carry"] = F.aggregate(F.col(f"{n}__list"), F.lit(None).cast(kind), lambda a, x: join(a, x["v"]).cast(kind))
    carry = lists.select(*(F.col(k).alias(f"{k}__k") for k in by), F.col("part__").alias("part__k"), *(c.alias(n) for n, c in folded.items()))
    here = Window.partitionBy(*by, "part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select(*df.columns, "part__", *(v().over(here).alias(f"{n}__own") for n, v in values.items()))
    on = own["part__"] == carry["part__k"]
    for k in by:
        on = on & own[k].eqNullSafe(carry[f"{k}__k"])
    out = own.join(carry, on)
    return out.select(*df.columns, *(join(F.col(f"{n}__carry"), F.col(f"{n}__own")).alias(n) for n in values))


def sum_before(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over the key's earlier rows, 0 if there are none."""
    zero = F.lit(0)
    add = lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
    return before(df, by, order, {name: lambda: F.sum(value)}, add).withColumn(name, F.coalesce(name, zero))


def last_before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value that is not null among the key's earlier rows, null if there is none."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    later = lambda a, b: F.coalesce(b, a)
    return before(df, by, order, {name: lambda: F.max_by(value, at)}, later)
