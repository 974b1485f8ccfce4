"""Totals whose order matters, computed by all tasks however few keys there are.

Adding to a field cuts to its scale, drops the sign of an unsigned one and keeps low-order digits, so one record maps any incoming total to an outgoing
one, and such maps compose. Records are sorted over range partitions of (key, order), so that a key may span many. A key that begins inside a partition starts
from the initial value and is folded there. Only the first key of a partition may go on from the one before: it becomes a summary of what its records do
to any total. One row a partition is then composed in order, and every partition knows the total it starts from.

Two summaries: `Walk` for steps on the field's grid into a signed field, three numbers whatever the records; `Table`, a piecewise linear map with as many
pieces as the steps make, for finer steps, rounding, and unsigned fields.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.language import NotModelled
from ..functions.picture import Picture
from .settle import settled
from .streamed import arrow_schema, batches_of

#: Steps of a summary taken at once.
BLOCK = 512


@dataclass(frozen=True)
class Walk:
    """Steps that add whole units to a signed field of `limit` = 10**digits, seen as a walk over a line with a zero at each multiple of limit.

    total: where it ends. A zero that lies up to `below` units under the end (or at it) was last passed upwards, one up to `above` over it downwards; the value is
    then positive or negative. Zeros further away were not passed and the incoming sign holds. above + below < limit.
    """

    limit: int
    total: int = 0
    above: int = 0
    below: int = 0

    @staticmethod
    def of(x: np.ndarray, limit: int) -> Walk:
        out = Walk(limit)
        most = max(1, min(1 << 16, (1 << 62) // (2 * limit)))  # no partial sum leaves 64 bits
        for at in range(0, len(x), most):
            out = out.then(Walk._few(x[at : at + most], limit))
        return out

    @staticmethod
    def _few(x: np.ndarray, limit: int) -> Walk:
        path = np.cumsum(np.r_[0, x])
        end = int(path[-1])
        up, down = np.maximum.accumulate(path[::-1]) - end, end - np.minimum.accumulate(path[::-1])  # what the last steps passed
        full = np.flatnonzero(up + down >= limit)
        if not len(full):
            return Walk(limit, end, int(up[-1]), int(down[-1]))
        above, below = int(up[full[0] - 1]), int(down[full[0] - 1])  # the step that passes the rest of the circle does so in one direction
        if up[full[0]] > above:
            return Walk(limit, end, limit - 1 - below, below)
        return Walk(limit, end, above, limit - 1 - above)

    def then(self, later: Walk) -> Walk:
        """This walk and a later one: what the later one passed last counts."""
        n = self.limit
        above = max(later.above, min(self.above - later.total, n - 1 - later.below))
        below = max(later.below, min(self.below + later.total, n - 1 - later.above))
        return Walk(n, self.total + later.total, above, below)

    def __call__(self, a: int) -> int:
        rest = (a + self.total) % self.limit
        if rest <= self.below:
            return rest
        return rest - self.limit if a < 0 or self.limit - rest <= self.above else rest

    def pack(self) -> bytes:
        return b"W" + json.dumps([self.limit, self.total, self.above, self.below]).encode()


@dataclass(frozen=True)
class Table:
    """A piecewise linear map of whole numbers: from start[i] on, value[i] + slope[i] * (a - start[i]); the last piece ends at `end`."""

    start: np.ndarray
    value: np.ndarray
    slope: np.ndarray
    end: int

    @staticmethod
    def of(pieces: list, end: int) -> Table:
        return Table(*(np.array(c, np.int64) for c in zip(*pieces)), end)

    @staticmethod
    def identity(limit: int, signed: bool) -> Table:
        low = 1 - limit if signed else 0
        return Table.of([(low, low, 1)], limit - 1)

    @staticmethod
    def kept(limit: int, signed: bool) -> Table:
        """Low-order digits of sums, and no sign in an unsigned field."""
        pieces = []
        for k in range(3, -1, -1):  # -(k + 1) limit < a <= -k limit
            pieces.append((1 - (k + 1) * limit, 1 - limit, 1) if signed else (1 - (k + 1) * limit, limit - 1, -1))
        pieces += [(k * limit, 0, 1) for k in range(4)]
        return Table.of(pieces, 4 * limit - 1)

    @staticmethod
    def step(c: int, up: int, down: int, limit: int, signed: bool) -> Table:
        """a + up where a + c >= 0, else a + down, before digits are cut."""
        low, high = 1 - limit if signed else 0, limit - 1
        turn = -c
        if turn <= low:
            return Table.of([(low, low + up, 1)], high)
        if turn > high:
            return Table.of([(low, low + down, 1)], high)
        return Table.of([(low, low + down, 1), (turn, turn + up, 1)], high)

    def _ends(self) -> np.ndarray:
        return np.r_[self.start[1:] - 1, self.end]

    def then(self, later: Table) -> Table:
        """later(self(a)): each piece is cut where its values pass a start of later's pieces."""
        last = self.value + self.slope * (self._ends() - self.start)
        low, high = np.minimum(self.value, last), np.maximum(self.value, last)
        first, final = (np.searchsorted(later.start, v, "right") - 1 for v in (low, high))
        count = final - first + 1
        row = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        falls = self.slope[row] < 0
        piece = np.where(falls, final[row] - at, first[row] + at)
        value = np.where(falls, np.minimum(high[row], later._ends()[piece]), np.maximum(low[row], later.start[piece]))
        start = self.start[row] + np.abs(value - self.value[row])
        value, slope = later.value[piece] + later.slope[piece] * (value - later.start[piece]), self.slope[row] * later.slope[piece]
        slope[np.r_[start[1:] - 1, self.end] == start] = 0  # single points
        goes_on = np.r_[False, (slope[1:] == slope[:-1]) & (value[1:] == value[:-1] + slope[:-1] * np.diff(start))]
        return Table(start[~goes_on], value[~goes_on], slope[~goes_on], self.end)

    def __call__(self, a: int) -> int:
        i = int(np.searchsorted(self.start, a, "right")) - 1
        return int(self.value[i] + self.slope[i] * (a - self.start[i]))

    def pack(self) -> bytes:
        return b"T" + np.r_[self.end, self.start, self.value, self.slope].astype("<i8").tobytes()


def unpack(raw: bytes) -> Walk | Table:
    if raw[:1] == b"W":
        return Walk(*json.loads(raw[1:]))
    end, *rest = np.split(np.frombuffer(raw, "<i8", offset=1), [1, *((len(raw) // 8 - 1) // 3 * k + 1 for k in (1, 2))])
    return Table(*rest, int(end[0]))


class Summary:
    """What the steps of a run of records do to any total, block by block."""

    def __init__(self, limit: int, signed: bool):
        self.limit, self.signed, self.walk, self.table = limit, signed, Walk(limit) if signed else None, None
        self.held: list = []

    def add(self, steps: tuple) -> None:
        self.held.append(steps)
        if len(self.held) >= (1 << 16 if self.table is None and self.signed else BLOCK):
            self._take()

    def _take(self) -> None:
        if not self.held:
            return
        rows = np.array(self.held, np.int64)
        self.held = []
        on_grid = bool((rows == rows[:, :1]).all())
        if self.table is None and self.signed and on_grid:
            self.walk = self.walk.then(Walk.of(rows[:, 0], self.limit))
            return
        kept = Table.kept(self.limit, self.signed)
        if self.table is None:
            self.table = Table.identity(self.limit, self.signed)
            if self.signed and self.walk != Walk(self.limit):
                self.table = as_table(self.walk)
        for at in range(0, len(rows), BLOCK):
            maps = [Table.step(*map(int, r), self.limit, self.signed).then(kept) for r in rows[at : at + BLOCK]]
            while len(maps) > 1:
                maps = [a.then(b) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) // 2 * 2 :]
            self.table = self.table.then(maps[0])

    def pack(self) -> bytes:
        self._take()
        return (self.walk if self.table is None else self.table).pack()


def as_table(walk: Walk) -> Table:
    """A walk as a piecewise map, from its values at the few places where they jump."""
    n = walk.limit
    cuts = {1 - n, 0}
    for jump in (0, walk.below + 1, n - walk.above):  # of the rest (a + total) modulo limit
        for k in (-1, 0, 1):
            a = (jump - walk.total) % n + k * n
            if 1 - n <= a < n:
                cuts.add(a)
    return Table.of([(a, walk(a), 1) for a in sorted(cuts)], n - 1)


def stepped(a: int, c: int, up: int, down: int, limit: int, signed: bool) -> int:
    """One record's step."""
    a = a + up if a + c >= 0 else a + down
    return a % limit if a >= 0 else -(-a % limit) if signed else -a % limit


def step(x: Column, p: Picture, scale: int, rounded: bool = False) -> Column:
    """What `ADD x TO field` does, x having `scale` fraction digits, in units of the field's last place: struct(c, up, down). The total a becomes a + up if a + c >= 0, that is if the exact sum
    is not negative, else a + down; null adds nothing. Sums beyond twice the field's size keep sign and low-order digits only."""
    if p.digits > 18:
        raise NotModelled(f"{p.text}: totals of more than 18 digits")
    limit = 10**p.digits
    x = F.coalesce(x, V.decimal_lit(0)).cast(f"decimal({36 - abs(p.scale)},{scale})")  # so that no product passes 38 digits
    n = x * V.power_of_ten(p.scale)
    half = V.decimal_lit("0.5")
    c = F.floor(n).cast("decimal(38,0)")
    up = F.floor(n + half).cast("decimal(38,0)") if rounded else c
    down = (F.ceil(n - half) if rounded else F.ceil(n)).cast("decimal(38,0)")
    size = V.decimal_lit(limit)

    def near(v: Column) -> Column:
        return F.when(F.abs(v) < 2 * limit, v).otherwise(F.signum(v).cast("decimal(1,0)") * (F.abs(v) % size + size)).cast("long")

    return F.struct(F.greatest(F.least(c, size), -size).cast("long").alias("c"), near(up).alias("up"), near(down).alias("down"))


def _groups(batches, keys: int):
    """(key, column index -> list) of stretches of equal keys in sorted batches; a key may come in several stretches one after another."""
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        lo, n = 0, batch.num_rows
        while lo < n:
            key = tuple(c[lo] for c in cols[:keys])
            hi = lo + 1
            while hi < n and all(c[hi] == k or c[hi] != c[hi] and k != k for c, k in zip(cols[:keys], key)):
                hi += 1
            yield batch, lo, hi, key, cols
            lo = hi


def _same(a: tuple | None, b: tuple) -> bool:
    return a is not None and all(x == y or x != x and y != y for x, y in zip(a, b))


def _summaries(keys: int, limit: int, signed: bool, initial: int, kinds):
    """Sorted rows (keys, part, c, up, down) -> (keys, part, summary or null, total or null, done)."""

    def run(batches):
        def found():
            key, part, first, summary, a = None, None, True, Summary(limit, signed), initial
            for _, lo, hi, k, cols in _groups(batches, keys):
                if not _same(key, k):
                    if key is not None:
                        yield (*key, part, summary.pack() if first else None, None if first else a, not first)
                        first = False
                    key, part, a = k, cols[keys][lo], initial
                steps = zip(*(c[lo:hi] for c in cols[keys + 1 :]))
                if first:
                    for s in steps:
                        summary.add(s)
                else:
                    for c, up, down in steps:
                        a = stepped(a, c, up, down, limit, signed)
            if key is not None:  # the last key may go on in the next partition
                yield (*key, part, summary.pack() if first else None, None if first else a, False)

        yield from batches_of(found(), kinds)

    return run


def _composed(keys: int, initial: int, kinds):
    """Rows (keys, part, summary, total) sorted by key and part -> (keys, part, total before, total after)."""

    def run(batches):
        def found():
            key, a = None, initial
            for _, lo, hi, k, cols in _groups(batches, keys):
                if not _same(key, k):
                    key, a = k, initial
                for part, summary, total in zip(*(c[lo:hi] for c in cols[keys : keys + 3])):
                    before = a
                    a = total if summary is None else unpack(summary)(a)
                    yield (*k, part, before, a)

        yield from batches_of(found(), kinds)

    return run


def _prepared(df: DataFrame, keys: list[str], order: list, p: Picture, initial: int):
    """(sorted rows with their partition, rows of whole keys, composed rows of the first and last keys of partitions)."""
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = settled(spread.withColumn("part__", F.spark_partition_id()))
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys)
    limit = 10**p.digits
    schema = f"{kinds}, part int, summary binary, total long, done boolean"
    own = rows.select(*keys, "part__", "step__.c", "step__.up", "step__.down")
    ordered = [k for k, _ in df.dtypes if k in keys]
    found = settled(own.select(*ordered, "part__", "c", "up", "down").mapInArrow(_summaries(len(keys), limit, p.signed, initial, arrow_schema(schema)), schema))
    open_ones = found.where("not done").repartition(*keys).sortWithinPartitions(*ordered, "part")  # at most two rows a partition
    schema = f"{kinds}, part int, before long, after long"
    chain = open_ones.drop("done").mapInArrow(_composed(len(keys), initial, arrow_schema(schema)), schema)
    return rows, found.where("done").select(*ordered, F.col("total").alias("after")), chain


def _number(units: Column, p: Picture) -> Column:
    return (units.cast("decimal(18,0)") * V.power_of_ten(-p.scale)).cast(p.spark_type)


def totals(df: DataFrame, keys: list[str], order: list[str], steps: Column, name: str, p: Picture, initial: int = 0) -> DataFrame:
    """keys and the field `name` (picture p, first value `initial` in units of its last place) after the steps of each key's records in order.

    steps: step(...) of a record, or an array of them. order must be total among records that do not commute. Null keys are a key; an empty table gives no
    rows; a key of any number of records is spread over partitions.
    """
    own = df.select(*keys, *order, steps.alias("step__"))
    if dict(own.dtypes)["step__"].startswith("array"):
        own = own.select(*keys, *order, F.posexplode_outer("step__").alias("at__", "step__"))
        nothing = F.lit(0).cast("long")
        own = own.withColumn("step__", F.coalesce("step__", F.struct(nothing.alias("c"), nothing.alias("up"), nothing.alias("down"))))
        order = [*order, "at__"]
    _, whole, chain = _prepared(own, keys, order, p, initial)
    rest = chain.groupBy(*keys).agg(F.max_by("after", "part").alias("after"))
    return whole.unionByName(rest).select(*keys, _number(F.col("after"), p).alias(name))


def _traced(keys: int, at: int, limit: int, signed: bool, initial: int):
    """Batches with a last column `start__` and the step's three columns from `at` on -> the batches' first columns and the total before each row."""

    def run(batches):
        import pyarrow as pa

        key, first, a = None, True, initial
        values: list = []
        for batch, lo, hi, k, cols in _groups(batches, keys):
            if lo == 0:
                values = []
            if not _same(key, k):
                first = key is None
                a = cols[-1][lo] if first and cols[-1][lo] is not None else initial
                key = k
            for c, up, down in zip(*(col[lo:hi] for col in cols[at : at + 3])):
                values.append(a)
                a = stepped(a, c, up, down, limit, signed)
            if hi == batch.num_rows:
                names = [*batch.schema.names[:at], "total__"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values, pa.int64())], names=names)

    return run


def trace(df: DataFrame, keys: list[str], order: list[str], steps: Column, name: str, p: Picture, initial: int = 0) -> DataFrame:
    """df with `name`: the total as the READ of each record finds it, before its own step. As totals() in all else."""
    others = [c for c in df.columns if c not in keys]
    own = df.select(*keys, *others, steps.alias("step__"))
    rows, _, chain = _prepared(own, keys, order, p, initial)
    firsts = rows.groupBy("part__").agg(F.min_by(F.struct(*keys), F.struct(*keys, *order)).alias("key__"))
    same = [F.col(f"key__.`{k}`").eqNullSafe(F.col(f"chain.`{k}`")) for k in keys]
    on = F.col("part__") == F.col("chain.part")
    for s in same:
        on = on & s
    starts = firsts.join(chain.alias("chain"), on).select("part__", F.col("before").alias("start__"))  # one row a partition
    with_start = rows.join(F.broadcast(starts), "part__", "left").select(*keys, *others, "step__.c", "step__.up", "step__.down", "start__")
    kinds = ", ".join(f"`{c}` {t}" for c, t in (*((c, dict(df.dtypes)[c]) for c in (*keys, *others)), ("total__", "long")))
    out = with_start.mapInArrow(_traced(len(keys), len(keys) + len(others), 10**p.digits, p.signed, initial), kinds)
    return out.select(*df.columns, _number(F.col("total__"), p).alias(name))
