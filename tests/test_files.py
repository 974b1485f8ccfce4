"""Keyed files, sums over earlier rows, generations, byte lineage, START and MERGE."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import byte_lineage, keyed, ordered, records
from tallyframe.plans import jobs


@pytest.fixture
def spread(spark):
    """Partitions as they are, however small."""
    ours = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_before_over_partitions(spread):
    rng = random.Random(1)
    rows = [(rng.choice(("hot", "hot", "a", None)), i, rng.choice((None, rng.randrange(9)))) for i in range(400)]
    df = spread.createDataFrame(rows, "k string, n int, v long").repartition(5)
    total, last = {}, {}
    want = set()
    for k, n, v in rows:
        want.add((k, n, v, total.get(k, 0), last.get(k)))
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = v if v is not None else last.get(k)
    got = ordered.last_before(ordered.sum_before(df, ["k"], ["n"], "v", "s"), ["k"], ["n"], "v", "l").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert ordered.sum_before(df.where("false"), ["k"], ["n"], "v", "s").collect() == []


def test_keyed_file_against_a_replay(spread):
    rng = random.Random(2)
    file = {k: (f"old{k}", 0) for k in (None, 1, 2, 5)}
    log = [(rng.choice((None, 1, 1, 1, 2, 3, 4)), i, rng.choice(("WRITE", "REWRITE", "DELETE")), f"v{i}", i) for i in range(300)]
    schema = "k int, text string, n int"
    held, want = dict(file), {}
    for k, i, verb, text, n in log:
        want[i] = ("22" if k in held else "00") if verb == "WRITE" else ("00" if k in held else "23")
        if want[i] == "00":
            held[k] = (text, n)
            if verb == "DELETE":
                del held[k]
    old = spread.createDataFrame([(k, *v) for k, v in file.items()], schema)
    steps = spread.createDataFrame(log, "k int, i int, verb string, text string, n int").repartition(4)
    told = keyed.statuses(old, steps, ["k"], ["i"])
    assert {r.i: r.status for r in told.collect()} == want and all(r.invalid_key == (r.status != "00") for r in told.collect())
    assert {r.k: (r.text, r.n) for r in keyed.applied(old, told, ["k"], ["i"]).collect()} == held
    none = keyed.statuses(old, steps.where("false"), ["k"], ["i"])
    assert none.collect() == [] and {r.k for r in keyed.applied(old, none, ["k"], ["i"]).collect()} == set(file)
    with pytest.raises(Exception, match="no such verb"):
        keyed.statuses(old, steps.withColumn("verb", F.lit("READ")), ["k"], ["i"]).collect()


def test_generations(spark):
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30)], "run int, then int")
    dd = [(1, "A(0)", "input"), (1, "A(+1)", "output"), (1, "A(+1)", "input"), (2, "A(0)", "input"), (2, "A(+2)", "output"), (3, "A(0)", "input"), (3, "A(-3)", "input"), (3, "B", "input"), (4, "A(-2)", "input"), (4, "A(1)", "input"), (4, None, "input")]
    got = jobs.generations(runs, spark.createDataFrame(dd, "run int, dataset string, direction string"), limit=2).collect()
    assert {(r.run, r.dataset, r.direction): (r.generation, r.status) for r in got} == {
        (1, "A(0)", "input"): (None, "missing"), (1, "A(+1)", "output"): (1, "made"), (1, "A(+1)", "input"): (1, "found"), (2, "A(0)", "input"): (1, "found"),
        (2, "A(+2)", "output"): (3, "made"), (3, "A(0)", "input"): (3, "found"), (3, "A(-3)", "input"): (None, "missing"), (3, "B", "input"): (None, None),
        (4, "A(-2)", "input"): (1, "rolled-off"), (4, "A(1)", "input"): (4, "missing"), (4, None, "input"): (None, None),
    }


def test_byte_lineage_against_single_bytes(spark):
    rng = random.Random(3)
    cards, want = [], {}
    for chain in range(12):
        now = None
        for step in range(rng.randrange(1, 8)):
            out = {}
            at = 1
            for place in range(rng.randrange(1, 6)):
                start, n = rng.choice((None, rng.randrange(1, 200))), rng.randrange(0, 150)
                cards.append((chain, step, place, start, n))
                for i in range(n):
                    got = None if start is None else start + i
                    if now is None or got is None:
                        out[at + i] = got
                    elif got in now:
                        out[at + i] = now[got]
                at += n
            now = out
        want[chain] = now
    df = spark.createDataFrame(cards, "chain int, step int, place int, in_start int, length int")
    got = {c: {} for c in want}
    for r in byte_lineage.traced(byte_lineage.parts_of(df, ["chain", "step"])).collect():
        for i in range(r.length):
            assert r.out_start + i not in got[r.chain]
            got[r.chain][r.out_start + i] = None if r.in_start is None else r.in_start + i
    assert got == want


def test_start_of_many_records_on_one_key(spark):
    file = spark.range(300_000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("id"))
    asks = spark.createDataFrame([(1, 7), (1, 8), (1, 599_999), (2, 0)], "k int, at long")
    began = time.perf_counter()
    assert {(r.k, r["at"]): r.n for r in records.start_read(asks, file, ["k"], "at", "id", "n").collect()} == {(1, 7): 8, (1, 8): 8, (1, 599_999): None, (2, 0): None}
    assert {(r.k, r["at"]): r.n for r in records.start_read(asks, file, ["k"], "at", "id", "n", previous=True).collect()} == {(1, 7): 6, (1, 8): 8, (1, 599_999): 599_998, (2, 0): None}
    assert time.perf_counter() - began < 60  # quadratic work would take far longer


def test_merge_numbers_groups_of_any_size(spread):
    a = spread.createDataFrame([("x", i) for i in range(0, 90, 2)] + [(None, 5)], "g string, v int")
    b = spread.createDataFrame([("x", i) for i in range(1, 90, 2)] + [("y", 3), (None, 4)], "g string, v int")
    got = {(r.g, r.v): r.seq for r in records.merge([a, b], ["g"], [("v", "D")], "seq").collect()}
    assert got == {("x", i): 90 - i for i in range(90)} | {("y", 3): 1, (None, 5): 1, (None, 4): 2}
