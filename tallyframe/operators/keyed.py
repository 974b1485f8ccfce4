"""Keyed files: WRITE, REWRITE and DELETE as an ordered change log, with the status of every step, and the file that is left.

Whether a key exists before a step follows from the last WRITE or DELETE of it before, else from the file: a WRITE leaves it there whether or not it succeeds, a
DELETE leaves it away, a REWRITE changes neither. So statuses need no replay, and a key of any number of changes is spread over partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from .ordered import last_before

# File status of a step that succeeds, finds its key taken, finds no such key.
DONE, TAKEN, NO_KEY = "00", "22", "23"


def _on(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(and_, (a[k].eqNullSafe(b[f"{k}__k"]) for k in keys))


def _keys(file: DataFrame, keys: list[str], *more) -> DataFrame:
    return file.select(*(F.col(k).alias(f"{k}__k") for k in keys), *more)


def statuses(file: DataFrame, log: DataFrame, keys: list[str], order: list[str], verb: str = "verb") -> DataFrame:
    """log (verb WRITE, REWRITE or DELETE, in order within a key) with `status` and `invalid_key`.

    file holds at most one record of a key. A null key is a key of its own; another verb raises in ANSI mode; an empty log gives no rows; a key of
    the file that the log does not name is untouched.
    """
    known = F.when(F.col(verb).isin("WRITE", "REWRITE", "DELETE"), F.col(verb)).otherwise(F.raise_error(F.concat(F.lit("no such verb: "), F.coalesce(verb, F.lit("null")))))
    rows = log.withColumn("leaves__", F.when(known == "WRITE", True).when(known == "DELETE", False))
    rows = last_before(rows, keys, order, "leaves__", "left__")
    had = _keys(file, keys, F.lit(True).alias("had__"))
    rows = rows.join(had, _on(rows, had, keys), "left")
    exists = F.coalesce("left__", "had__", F.lit(False))
    status = F.when((F.col(verb) == "WRITE") & exists, TAKEN).when((F.col(verb) != "WRITE") & ~exists, NO_KEY).otherwise(DONE)
    return rows.select(*log.columns, status.alias("status"), (status != DONE).alias("invalid_key"))


def applied(file: DataFrame, told: DataFrame, keys: list[str], order: list[str], verb: str = "verb") -> DataFrame:
    """The file after the steps of statuses(file, log, ...): its columns, each key once. One aggregation with map-side combining and one join."""
    values = [c for c in file.columns if c not in keys]
    at = F.struct(*order)
    good = F.col("status") == DONE
    changed = told.groupBy(*keys).agg(
        F.max_by(F.col(verb) != "DELETE", F.when(F.col(verb) != "REWRITE", at)).alias("left__"),
        F.max_by(F.struct(*values) if values else F.lit(True), F.when(good & (F.col(verb) != "DELETE"), at)).alias("new__"),
    )
    old = _keys(file, keys, F.struct(*values).alias("old__") if values else F.lit(True).alias("old__"), F.lit(True).alias("had__"))
    both = changed.join(old, _on(changed, old, keys), "full")
    stays = F.coalesce("left__", "had__", F.lit(False))
    key = [F.when(F.col("had__"), F.col(f"{k}__k")).otherwise(F.col(k)).alias(k) for k in keys]
    held = F.coalesce("new__", "old__")
    out = both.where(stays).select(*key, *(held[c].alias(c) for c in values))
    return out.select(*file.columns)
