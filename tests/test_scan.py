"""Ordered totals over all tasks against the plain fold."""

import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.language import NotModelled
from tallyframe.functions.picture import parse_picture, store_value
from tallyframe.operators import fold, scan


def test_walks_compose():
    rng = random.Random(1)
    for _ in range(400):
        limit = rng.choice((10, 100))
        xs = [rng.randint(1 - 2 * limit, 2 * limit - 1) if rng.random() < 0.3 else rng.randint(-limit // 3, limit // 3) for _ in range(rng.randrange(1, 14))]
        walk = scan.Walk(limit)
        while_at = 0
        while while_at < len(xs):
            n = rng.randrange(1, 5)
            walk = walk.then(scan.Walk.of(np.array(xs[while_at : while_at + n]), limit))
            while_at += n
        table = scan.as_table(walk)
        assert scan.unpack(walk.pack()) == walk and walk.above + walk.below < limit
        for a in range(1 - limit, limit):
            b = a
            for x in xs:
                b = scan.stepped(b, x, x, x, limit, True)
            assert walk(a) == table(a) == b


@pytest.mark.parametrize("signed", [True, False])
def test_tables_compose(signed, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 7)
    rng = random.Random(2)
    for _ in range(60):
        limit, summary, steps = rng.choice((10, 100)), None, []
        summary = scan.Summary(limit, signed)
        for _ in range(rng.randrange(1, 40)):
            c = rng.randint(1 - 2 * limit, 2 * limit - 2)
            steps.append(rng.choice(((c, c, c), (c, c, c + 1), (c, c + 1, c + 1))))
            summary.add(steps[-1])
        f = scan.unpack(summary.pack())
        for a in range(1 - limit if signed else 0, limit):
            b = a
            for s in steps:
                b = scan.stepped(b, *s, limit, signed)
            assert f(a) == b


PICTURES = ["S9(3)V99", "9(3)V99", "S9(2)V9", "9(2)V9", "S9(3)", "S9(4)PP", "SV9(3)"]


@pytest.mark.parametrize("rounded", [False, True])
def test_steps_are_stores(spark, rounded):
    rng = random.Random(3)
    rows = [(Decimal(rng.randint(-(10**7), 10**7)).scaleb(-3),) for _ in range(60)] + [(Decimal(n).scaleb(-3),) for n in (0, 1, -1, 500, -500, 50, -50, 999999, -(10**9))] + [(None,)]
    df = spark.createDataFrame(rows, "x decimal(12,3)")
    for text in PICTURES:
        p = parse_picture(text)
        unit = Decimal(1).scaleb(-p.scale)
        for x, s in df.select("x", scan.step(F.col("x"), p, 3, rounded).alias("s")).collect():
            for a in (0, 1, 7, 10**p.digits - 1, *((-1, -8, 1 - 10**p.digits) if p.signed else ())):
                want = a * unit if x is None else store_value(a * unit + x, p, rounded)
                assert scan.stepped(a, *s, 10**p.digits, p.signed) * unit == want, (text, x, a)
    with pytest.raises(NotModelled):
        scan.step(F.col("x"), parse_picture("9(19)"), 0)


@pytest.mark.parametrize("picture", ["S9(3)V99", "9(3)V9", "S9(3)V9"])
def test_hot_and_small_keys_over_many_partitions(spark, picture):
    """A key with most rows, keys of one row, null keys and values; totals and the trace; other columns stay."""
    rng = random.Random(4)
    rows = [(rng.choice(("hot", "hot", "hot", "a", "b", None, f"k{i}")), i, None if i % 41 == 0 else Decimal(rng.randint(-90_000, 90_000)).scaleb(-2), f"n{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, n int, x decimal(9,2), note string").repartition(6)
    p = parse_picture(picture)
    want, before, a = {}, {}, defaultdict(lambda: Decimal(0))
    for k, n, x, _ in rows:
        before[n] = a[k]
        a[k] = store_value(a[k] + (x or 0), p)
        want[k] = a[k]
    steps = scan.step(F.col("x"), p, 2)
    ours = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        got = {r.k: r.total for r in scan.totals(df, ["k"], ["n"], steps, "total", p).collect()}
        trace = scan.trace(df, ["k"], ["n"], steps, "total", p)
        seen = trace.collect()
        assert trace.rdd.getNumPartitions() > 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and trace.columns == ["k", "n", "x", "note", "total"]
    assert {r.n: r.total for r in seen} == before and {r.note for r in seen} == {r[3] for r in rows}
    assert scan.totals(df.where("false"), ["k"], ["n"], steps, "total", p).count() == 0
    assert scan.trace(df.where("false"), ["k"], ["n"], steps, "total", p).count() == 0


def test_safe_total_takes_the_scan_only_where_order_matters(spark):
    rows = [("one sign", i, Decimal(990)) for i in range(5)] + [("mixed", i, Decimal(-990 if i % 3 else 995)) for i in range(50)] + [(None, 1, Decimal(5))]
    df = spark.createDataFrame(rows, "k string, n int, x decimal(9,2)")
    got = {r.k: r.t for r in fold.safe_total(df, ["k"], ["n"], "x", "t", "S9(3)").collect()}
    a = Decimal(0)
    for _, _, x in rows[5:55]:
        a = store_value(a + x, parse_picture("S9(3)"))
    assert got == {"one sign": Decimal(950), "mixed": a, None: Decimal(5)}
