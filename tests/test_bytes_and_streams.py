"""Numbers in bytes, record files and their splits, ordered streams, concurrent retrieval."""

import random
import struct
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.bytes import ByteLayout, decode, encode
from tallyframe.functions.picture import parse_picture, store_value
from tallyframe.operators import scan
from tallyframe.sources import estate, record_file
from tallyframe.streaming import totals

FIELDS = [("S9(7)V99", "COMP-3"), ("9(4)", "COMP-3"), ("S9(4)", "COMP"), ("9(4)", "COMP"), ("S9(9)V9", "COMP-5"), ("S9(18)", "BINARY"), ("9(18)", "COMP"), ("S9(3)V99", "DISPLAY"), ("9(3)PP", "COMP-3"), ("9(5)", "DISPLAY")]


def plain_bytes(x, p):
    units = int((x or D(0)).scaleb(p.scale))
    if p.usage == "COMP-3":
        n = p.digits // 2 + 1
        return bytes.fromhex(f"{abs(units):0{2 * n - 1}d}" + ("F" if not p.signed else "D" if units < 0 else "C"))
    if p.usage != "DISPLAY":
        n = 2 if p.digits <= 4 else 4 if p.digits <= 9 else 8
        return units.to_bytes(n, "big", signed=p.signed)
    text = f"{abs(units):0{p.digits}d}"
    return (text[:-1] + chr(ord("p") + int(text[-1])) if units < 0 else text).encode()


def test_numbers_as_bytes(spark):
    rng = random.Random(5)
    values = [None, D(0), D(1), D(-1), D("0.01"), D("-0.05"), *(D(rng.randint(-(10**19), 10**19)).scaleb(-rng.randrange(12)) for _ in range(40))]
    df = spark.createDataFrame([(i, None if v is None else v.quantize(D("0.01"), "ROUND_DOWN")) for i, v in enumerate(values)], "i int, x decimal(24,2)")
    for text, usage in FIELDS:
        p = parse_picture(text, usage)
        rows = df.withColumn("b", encode(F.col("x"), p)).withColumn("y", decode(F.col("b"), p)).collect()
        for r in rows:
            want = store_value(r.x if r.x is not None else D(0), p)
            assert bytes(r.b) == plain_bytes(want, p) and r.y == want, (text, usage, r)


def test_bytes_that_hold_no_number(spark):
    bad = {"COMP-3": [b"\x12\x3f\xff", b"\x1a\x2c", b"\x12\x30", b""], "DISPLAY": [b"12 4", b"p123", b"", None]}
    for usage, raws in bad.items():
        p = parse_picture("S9(3)" if usage == "COMP-3" else "S9(4)", usage)
        assert [r[0] for r in spark.createDataFrame([(x,) for x in raws], "b binary").select(decode(F.col("b"), p)).collect()] == [None] * len(raws)
    text = parse_picture("X(4)")
    rows = spark.createDataFrame([("é",), (None,), ("abcdef",)], "t string").select(encode(F.col("t"), text).alias("b"))
    assert [bytes(r.b) for r in rows.collect()] == [b"\xe9   ", b"    ", b"abcd"]


@pytest.mark.parametrize("form", ["F", "V"])
def test_record_files_split_at_records(spark, tmp_path, form):
    rng = random.Random(6)
    rows = [bytes(rng.randrange(256) for _ in range(20 if form == "F" else rng.choice((0, 1, 300, 4000, 32_756)))) for _ in range(500)]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "i int, record binary, file string").repartition(2)
    path = f"file://{tmp_path}/{form}"
    record_file.write(df, "record", path, form=form, size=20, step_kb=2)
    got = record_file.read(spark, path, form=form, size=20, split_kb=3)
    assert got.rdd.getNumPartitions() > 2 and sorted(bytes(r.record) for r in got.collect()) == sorted(rows)
    assert got.groupBy("file", "at").count().where("count > 1").isEmpty()
    record_file.write(df.where("false"), "record", f"{path}-none", form=form, size=20)
    assert record_file.read(spark, f"{path}-none", form=form, size=20).collect() == []
    with pytest.raises(Exception, match="a record of"):
        record_file.write(spark.createDataFrame([(b"x" * 40_000,)], "record binary"), "record", f"{path}-bad", form=form, size=20)


def test_files_from_elsewhere(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"".join(struct.pack(">HH", len(x) + 4, 0) + x for x in (b"one", b"", b"three")))
    path = f"file://{tmp_path}"
    assert [bytes(r.record) for r in record_file.read(spark, path, form="V").orderBy("at").collect()] == [b"one", b"", b"three"]
    (tmp_path / "a.dat").write_bytes(struct.pack(">HH", 30, 0) + b"short")
    with pytest.raises(Exception, match="ends beyond the file"):
        record_file.read(spark, path, form="V").collect()
    (tmp_path / "a.dat").write_bytes(b"\0\1\0\0zz")
    with pytest.raises(Exception, match="no record length"):
        record_file.read(spark, path, form="V").collect()
    with pytest.raises(Exception, match="no whole number"):
        record_file.read(spark, path, form="F", size=4).collect()


def test_layout_of_mixed_fields(spark):
    layout = ByteLayout([("A-KEY", "X(3)", "DISPLAY"), ("N", "S9(3)", "COMP-3"), ("TAIL", "X(9)", "DISPLAY")])
    df = spark.createDataFrame([("k", D(-12), "tail"), (None, None, None)], "a_key string, n decimal(3,0), tail string").select(layout.record().alias("r"))
    assert layout.size == 14 and [tuple(r) for r in layout.read(df, "r").collect()] == [("k  ", D(-12), "tail     "), ("   ", D(0), " " * 9)]
    short = df.select(F.substring("r", 1, 7).alias("r"))
    assert layout.read(short, "r").first()[:] == ("k  ", D(-12), "ta")


def test_a_stream_in_any_order(spark, tmp_path):
    """Batches in which records come late, twice, and after the end; a key whose first record never comes."""
    p = parse_picture("S9(2)")
    batches = [
        [("a", 3, 60, False), ("a", 1, 50, False), ("b", 2, 1, False)], [("a", 1, 50, False), ("a", 5, 0, True), ("c", 1, 0, True)],
        [("a", 2, 45, False), ("a", 4, -80, False)], [("a", 6, 9, False), ("c", 1, 0, True), ("b", 3, 0, True)],
    ]
    schema = "key string, seq long, x int, last boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)  # files are read in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = totals.ordered_totals(stream, scan.step(F.col("x").cast("decimal(5,0)"), p, 0), p)
    got = sorted((r.key, r.seq, r.kind, r.units) for r in totals.drain(out, f"file://{tmp_path}/run").collect())
    a = 0
    for x in (50, 45, 60, -80):
        a = scan.stepped(a, x, x, x, 100, True)
    assert got == [("a", 1, "repeated", None), ("a", 5, "total", a), ("a", 6, "ignored", None), ("c", 1, "repeated", None), ("c", 1, "total", 0)]


class Kept:
    """The state calls of the processor over plain values."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def removeKey(self, k):
        del self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def keys(self):
        return iter(self.map)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_gap_is_told_once_it_has_lasted():
    import pandas as pd

    state = Kept()
    p = totals.OrderedTotals(100, True, 0, 250)
    p.init(state)
    late = pd.DataFrame([(2, 5, 5, 5, False)], columns=["seq", "c", "up", "down", "last"])
    assert [len(x) for x in p.handleInputRows(("k",), iter([late]), state)] == [0] and state.timers == [1250]
    assert [tuple(r)[:3] for x in p.handleExpiredTimer(("k",), state, None) for r in x.values] == [("k", 1, "gap")]
    rest = pd.DataFrame([(3, 0, 0, 0, True), (1, 7, 7, 7, False)], columns=["seq", "c", "up", "down", "last"])
    assert [tuple(r) for x in p.handleInputRows(("k",), iter([rest]), state) for r in x.values] == [("k", 3, "total", 12)]
    assert state.map == {} and [len(x) for x in p.handleExpiredTimer(("k",), state, None)] == [0]


def slow(folder):
    """A client whose early answers are its slowest, which fails at first for some names, and notes how many requests it has at once. Nested, so that it is shipped whole."""

    def client(name, kind):
        import os
        import time
        import uuid

        n = int(name[1:])
        mine = f"{folder}/now-{uuid.uuid4().hex}"
        open(mine, "w").close()
        busy = sum(f.startswith("now-") for f in os.listdir(folder))
        open(f"{folder}/busy-{busy}", "w").close()
        time.sleep(0.08 if n % 10 == 0 else 0.02)
        os.remove(mine)
        tried = f"{folder}/tried-{name}"
        if n % 9 == 4 and not os.path.exists(tried):
            open(tried, "w").close()
            raise OSError("try again")
        if n == 7:
            raise OSError("never")
        return f"text {n}" if kind == "cobol" else None

    return client


def test_requests_overlap_and_keep_their_order(spark, tmp_path):
    rows = [(f"m{i}", ["asm", "cobol"], 100 - i) for i in range(40)] + [("m3", ["cobol"], 500), ("none", None, 900)]
    plan = spark.createDataFrame(rows, "name string, types array<string>, place int")
    got = estate.retrieve(plan.coalesce(1), slow(str(tmp_path)), jobs=5, tries=2, wait=0.01).collect()
    assert [r.name for r in got] == [f"m{i}" for i in range(39, -1, -1)]
    assert {r.name: r.outcome for r in got if r.outcome != "found"} == {"m7": "error"}
    most = max(int(f.name.split("-")[1]) for f in tmp_path.iterdir() if f.name.startswith("busy-"))
    assert 1 < most <= 5 * spark.sparkContext.defaultParallelism
    assert estate.retrieve(plan.where("false"), slow(str(tmp_path))).collect() == []
