"""Read loops over ordered records: as one aggregation where order cannot matter, else as an ordered fold by group.

Storing truncates and wraps, so adding is associative only under conditions: one sign throughout (and none negative for an unsigned
receiver), or no overflow on the way and no finer scale than the receiver's. safe_total() takes these conditions in the same aggregation and folds
only the groups that fail them, over all tasks (scan.py).
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..functions.picture import Picture, parse_picture
from . import scan


@dataclass
class Add:
    """ADD value TO name, under `when` if given. Exact if value has one sign and no finer scale than the picture."""

    name: str
    picture: str
    value: Column
    when: Column | None = None
    initial: str = "0"

    def column(self) -> Column:
        p = parse_picture(self.picture)
        x = V.store(self.value, Picture("numeric", 36, p.scale, True)).cast(f"decimal(36,{max(p.scale, 0)})")
        x = F.sum(x if self.when is None else F.when(self.when, x))
        return V.store(F.coalesce(x, V.decimal_lit(0)) + V.decimal_lit(self.initial), p).alias(self.name)


@dataclass
class Last:
    """MOVE value TO name on every record: the value of the last one in order."""

    name: str
    picture: str
    value: Column
    order: str

    def column(self) -> Column:
        return V.store(F.max_by(self.value, F.col(self.order)), parse_picture(self.picture)).alias(self.name)


@dataclass
class Greatest:
    """IF value > name MOVE value TO name (or < with least=True)."""

    name: str
    picture: str
    value: Column
    initial: str = "0"
    least: bool = False

    def column(self) -> Column:
        pick, agg = (F.least, F.min) if self.least else (F.greatest, F.max)
        return V.store(pick(agg(self.value), V.decimal_lit(self.initial)), parse_picture(self.picture)).alias(self.name)


def algebraic(df: DataFrame, keys: list[str], accumulators: list) -> DataFrame:
    """All accumulators of the loop in one aggregation with map-side combining; the caller answers for the conditions."""
    return df.groupBy(*keys).agg(*(a.column() for a in accumulators))


def _conditions(x: Column, p: Picture, finer: bool) -> Column:
    """Of the aggregates lo, hi, size of a group: whether its sum may replace the fold."""
    one_sign = F.col("lo") >= 0 if not p.signed else (F.col("lo") >= 0) | (F.col("hi") <= 0)
    if finer:
        return one_sign
    return one_sign | (F.lit(p.signed) & (F.col("size") < V.power_of_ten(p.digits - p.scale)))


def safe_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, picture: str) -> DataFrame:
    """keys and the field `name` after `ADD value TO name` on each record of the group in order. The order must be total."""
    p = parse_picture(picture)
    kind = dict(df.dtypes)[value]
    scale = int(kind.split(",")[1].rstrip(")"))
    cut = V.store(F.col(value), Picture("numeric", 36, p.scale, True))
    sums = df.groupBy(*keys).agg(F.sum(cut).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(F.abs(cut)).alias("size"))
    ok = _conditions(F.col(value), p, scale > p.scale)
    fast = sums.where(ok).select(*keys, V.store(F.col("total"), p).alias(name))
    slow = df.join(sums.where(~ok).select(*keys), keys, "left_semi")
    return fast.unionByName(scan.totals(slow, keys, order, scan.step(F.col(value), p, scale), name, p))


def safe_trace(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, picture: str) -> DataFrame:
    """df with the total as each READ sees it, for values of any sign and a group of any size: one group runs in all tasks. The order must be total."""
    p = parse_picture(picture)
    scale = int(dict(df.dtypes)[value].split(",")[1].rstrip(")"))
    return scan.trace(df, keys, order, scan.step(F.col(value), p, scale), name, p)


def trace(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, picture: str) -> DataFrame:
    """df with the total as each READ sees it: before its own record is added (0 at the first). For values of one sign."""
    p = parse_picture(picture)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, V.store(F.coalesce(F.sum(value).over(w), V.decimal_lit(0)), p))
