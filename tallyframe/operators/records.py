"""Record files: fixed layouts, sort, merge, include, omit, build, sum, join keys, control breaks, keyed reads, table search, text statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..functions.picture import Picture, parse_picture
from .settle import settled

NEGATIVE = "pqrstuvwxy"  # the last digit of a negative zoned number


class Layout:
    """A record as text of fixed columns: (NAME, PICTURE) in order."""

    def __init__(self, fields: list[tuple[str, str]]):
        self.fields, at = [], 1
        for name, picture in fields:
            p = parse_picture(picture)
            self.fields.append((name.lower().replace("-", "_"), p, at, p.length))
            at += p.length
        self.size = at - 1

    @staticmethod
    def _out(c: Column, p: Picture) -> Column:
        if not p.numeric:
            return V.store_text(F.coalesce(c, F.lit("")), p.length)
        units = (V.store(c, p) * V.power_of_ten(p.scale)).cast("decimal(38,0)")
        text = F.lpad(F.abs(units).cast("string"), p.length, "0")
        if not p.signed:
            return text
        last = F.translate(F.substring(text, p.length, 1), "0123456789", NEGATIVE)
        return F.when(units < 0, F.concat(F.substring(text, 1, p.length - 1), last)).otherwise(text)

    @staticmethod
    def _in(c: Column, p: Picture) -> Column:
        if not p.numeric:
            return c
        text = F.translate(c, NEGATIVE, "0123456789") if p.signed else c
        x = F.coalesce(F.trim(text).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast(f"decimal({max(p.digits, 1)},0)")
        x = x * V.power_of_ten(-p.scale)
        if p.signed:
            x = F.when(F.substring(c, p.length, 1).rlike(f"[{NEGATIVE}]"), -x).otherwise(x)
        return x.cast(p.spark_type)

    def write(self, df: DataFrame, record: str) -> DataFrame:
        return df.withColumn(record, F.concat(*(self._out(F.col(n), p) for n, p, _, _ in self.fields)))

    def read(self, df: DataFrame, record: str) -> DataFrame:
        """Columns of the layout from the text column `record`; short records read as spaces."""
        whole = F.rpad(record, self.size, " ")
        return df.select(*(self._in(F.substring(whole, at, n), p).alias(name) for name, p, at, n in self.fields))


def sort(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """SORT ... ON ASCENDING / DESCENDING KEY: keys (column, "A" | "D"), a range-partitioned global sort."""
    return df.orderBy(*(F.col(c).desc() if d == "D" else F.col(c).asc() for c, d in keys))


def merge(files: list[DataFrame], within: list[str], keys: list[tuple[str, str]], seq: str) -> DataFrame:
    """MERGE: the union of files of one layout, numbered in key order within each group. The keys must be a total order.

    The files share the splitters of one range-partitioned sort over group and keys; a row's number is its place in the whole file less that of its group's first.
    """
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    order = [*(F.col(c).asc() for c in within), *(F.col(c).desc() if d == "D" else F.col(c).asc() for c, d in keys)]
    rows = settled(numbered(out, order, "__position"))
    first = rows.groupBy(*(F.col(c).alias(f"{c}__g") for c in within)).agg(F.min("__position").alias("__first"))
    on = F.lit(True)
    for c in within:
        on = on & rows[c].eqNullSafe(first[f"{c}__g"])
    return rows.join(first, on).select(*out.columns, (F.col("__position") - F.col("__first") + 1).alias(seq))


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df with each row's place (from 1) in the order of all rows, which must be total.

    A range-partitioned sort is written once; a row's place is what the partitions before its own hold, summed over one row a partition, and its place in there.
    """
    at = F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
    held = settled(df.orderBy(*order).withColumn("__at", at))
    sizes = held.groupBy(F.col("__at.p").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    out = held.join(starts, F.col("__at.p") == F.col("__p"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__start") + F.col("__at.i") + 1).alias(name))


def sort_keys(record: str, fields: list[tuple]) -> list[Column]:
    """SORT FIELDS=(start,length,format,A|D, ...) as sort columns over the bytes of a record."""
    return [(_field(record, start, length, kind).desc() if way == "D" else _field(record, start, length, kind).asc()) for start, length, kind, way in fields]


def sort_fields(df: DataFrame, record: str, fields: list[tuple]) -> DataFrame:
    """SORT FIELDS on byte ranges: a range-partitioned global sort."""
    return df.orderBy(*sort_keys(record, fields))


def repro(df: DataFrame, record: str, key: tuple[int, int] | None = None, from_key: str | None = None, to_key: str | None = None) -> DataFrame:
    """REPRO: the records as they are, or those whose key bytes lie from from_key to to_key (compared as far as the given key goes)."""
    if key is not None:
        k = F.substring(record, *key)
        if from_key is not None:
            df = df.where(F.substring(k, 1, len(from_key)) >= from_key)
        if to_key is not None:
            df = df.where(F.substring(k, 1, len(to_key)) <= to_key)
    return df


def generate(df: DataFrame, record: str, parts: list[tuple], size: int) -> DataFrame:
    """IEBGENER with reformat cards: parts (length, start in the input or a literal, start in the output); other bytes are spaces. Later parts win.

    Each output byte range is cut from the input once; the parts may come in any order.
    """
    owner = [None] * size
    for n, (length, _, to) in enumerate(parts):
        owner[to - 1 : to - 1 + length] = [n] * length
    pieces, at = [], 0
    while at < size:
        end = at
        while end < size and owner[end] == owner[at]:
            end += 1
        if owner[at] is None:
            pieces.append(F.lit(" " * (end - at)))
        else:
            length, what, to = parts[owner[at]]
            skip = at - (to - 1)
            whole = F.lit(what.ljust(length)[skip : skip + end - at]) if isinstance(what, str) else F.substring(record, what + skip, end - at)
            pieces.append(F.rpad(whole, end - at, " "))
        at = end
    return df.select(F.concat(*pieces).alias(record))


def start_read(df: DataFrame, file: DataFrame, keys: list[str], wanted: str, key: str, next_key: str, previous: bool = False) -> DataFrame:
    """START file KEY >= wanted, then READ NEXT (or KEY <= wanted and READ PREVIOUS): df with the key that is read, null if there is none.

    Requests and records of the columns `keys` meet in one ordered window, so the file is read once and nothing is multiplied.
    """
    asks = df.withColumns({"__at": F.col(wanted), "__ask": F.lit(True), "__key": F.lit(None).cast(file.schema[key].dataType)})
    have = file.select(*keys, F.col(key).alias("__at"), F.lit(False).alias("__ask"), F.col(key).alias("__key"))
    # the way that is read, turned round: the record read is the last one before the request, and one of an equal key counts
    way = F.col("__at").asc() if previous else F.col("__at").desc()
    w = Window.partitionBy(*keys).orderBy(way, F.col("__ask").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__key", ignorenulls=True).over(w)
    both = asks.unionByName(have, allowMissingColumns=True).withColumn(next_key, found)
    return both.where("__ask").select(*df.columns, next_key)


def _field(record: str, start: int, length: int, kind: str) -> Column:
    c = F.substring(record, start, length)
    return F.trim(c).cast("decimal(38,0)") if kind in ("ZD", "FS", "NUM") else c


COMPARE = {"EQ": "=", "NE": "<>", "GT": ">", "LT": "<", "GE": ">=", "LE": "<="}


def _cards(record: str, cards: list[tuple]) -> Column:
    out = F.lit(True)
    for start, length, kind, op, value in cards:
        out = out & V.OPERATORS[COMPARE[op]](_field(record, start, length, kind), F.lit(value))
    return out


def include(df: DataFrame, record: str, cards: list[tuple]) -> DataFrame:
    """INCLUDE COND=(start,length,format,op,value) AND ..."""
    return df.where(_cards(record, cards))


def omit(df: DataFrame, record: str, cards: list[tuple]) -> DataFrame:
    return df.where(~_cards(record, cards))


def build(df: DataFrame, record: str, parts: list) -> DataFrame:
    """OUTREC BUILD: (start, length) ranges and literal texts, in order."""
    return df.select(F.concat(*(F.lit(p) if isinstance(p, str) else F.substring(record, *p) for p in parts)).alias(record))


def build_lineage(parts: list) -> list[tuple[int, int, int | None]]:
    """(out start, length, in start or None for a literal) of each part of a BUILD."""
    out, at = [], 1
    for p in parts:
        n = len(p) if isinstance(p, str) else p[1]
        out.append((at, n, None if isinstance(p, str) else p[0]))
        at += n
    return out


def sum_fields(df: DataFrame, record: str, keys: list[tuple], sums: list[tuple]) -> DataFrame:
    """SUM FIELDS: (name, start, length) keys and sums, and the number of records n."""
    return df.groupBy(*(F.substring(record, s, n).alias(k) for k, s, n in keys)).agg(
        *(F.sum(_field(record, s, n, "ZD")).cast("decimal(38,0)").alias(k) for k, s, n in sums), F.count(F.lit(1)).alias("n")
    )


def join_keys(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """JOINKEYS on pairs of columns; Catalyst and adaptive execution choose the strategy."""
    on = None
    for x, y in keys:
        c = a[x] == b[y]
        on = c if on is None else on & c
    return a.join(b, on, how)


def keyed_read(df: DataFrame, file: DataFrame, keys: list[tuple[str, str]], defaults: dict) -> DataFrame:
    """READ file KEY IS ...: df with the file's columns, the defaults where there is no record, and invalid_key."""
    file = file.withColumn("__found", F.lit(True))
    out = join_keys(df, file, keys, "left")
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}
    return out.withColumns(filled | {"invalid_key": F.col("__found").isNull()}).drop("__found")


def control_break(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with whether a record starts a new control group, for a file sorted by keys and order.

    The previous record has other keys exactly at the first record of its group, so the window is by key and no global sort is needed.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) == 1)


def varying(df: DataFrame, limit: Column, start: int, by: int = 1) -> DataFrame:
    """PERFORM VARYING i FROM start BY by UNTIL i > limit, adding i: columns total and i (as the loop leaves it)."""
    steps = F.when(limit >= start, F.sequence(F.lit(start), limit.cast("int"), F.lit(by))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return df.withColumns({"total": total, "i": F.size(steps) * by + start})


def search(array: str, test: Callable[[Column], Column]) -> Column:
    """SEARCH: 1-based index of the first element that satisfies test, 0 at end."""
    return F.coalesce(F.array_position(F.transform(array, test), True), F.lit(0)).cast("int")


def string_into(df: DataFrame, parts: list[tuple], target: str, length: int, pointer: str) -> DataFrame:
    """STRING part DELIMITED BY d (None: SIZE) ... INTO target WITH POINTER pointer (from 1)."""
    some = [F.substring_index(p if isinstance(p, Column) else F.col(p), d, 1) if d else (p if isinstance(p, Column) else F.col(p)) for p, d in parts]
    return df.withColumn(target, F.concat(*some)).withColumns({pointer: F.least(F.length(target), F.lit(length)) + 1, target: F.rpad(target, length, " ")})


def unstring(df: DataFrame, source: str, delimiter: str, targets: list[tuple[str, int]], filled: str) -> DataFrame:
    """UNSTRING source DELIMITED BY delimiter INTO targets TALLYING IN filled; targets without a part are blank."""
    parts = F.split(source, "\\Q" + delimiter + "\\E")
    out = {n: F.rpad(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")), k, " ") for i, (n, k) in enumerate(targets)}
    return df.withColumns(out | {filled: F.least(F.size(parts), F.lit(len(targets)))})


def tally(source: str, text: str) -> Column:
    """INSPECT source TALLYING n FOR ALL text."""
    return ((F.length(source) - F.length(F.replace(F.col(source), F.lit(text), F.lit("")))) / len(text)).cast("int")


def converting(source: str, old: str, new: str) -> Column:
    """INSPECT source CONVERTING old TO new."""
    return F.translate(source, old, new)


def replacing(source: str, old: str, new: str) -> Column:
    """INSPECT source REPLACING ALL old BY new (of one length)."""
    if len(old) != len(new):
        raise ValueError("REPLACING needs texts of one length")
    return F.replace(F.col(source), F.lit(old), F.lit(new))
