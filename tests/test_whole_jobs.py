"""Queries and operators do the whole job: every key, every record of hot groups, chains of any depth."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import foldplan
from tallyframe.plans import data_queries, machine, program_queries, samples, views
from tallyframe.plans.parse import parse_programs
from tallyframe.sources import estate
from tallyframe.streaming import reactive
from tests_support import program

SF = "/root/testdata/sf0.001"


def test_programs_run_on_every_customer(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).alias("t")).collect()
    want = {r.o_custkey: D(r.t) for r in orders}
    assert max(want) > 40
    got = program_queries.QUERIES["program_on_files"](spark, SF).collect()
    assert {r.o_custkey: r.ws_sum for r in got} == want and {r.halted for r in got} == {"done"} and len(got) == len(want)
    got = program_queries.QUERIES["stream_batch_equal"](spark, SF).collect()
    assert {int(r.key): D(r.value) for r in got} == want and len(got) == len(want)


def test_step_limit_is_for_endless_loops_only():
    p = parse_programs(samples.TOTALS)[0]
    got = machine.drive(p, {"PAY-FILE": [{"PAY-AMT": "1.00"}] * 200}, steps=100)
    assert got["halted"] == "done" and got["context"]["WS-SUM"] == 200 and got["steps"] > 1000
    code = machine.Code(p)
    state, _ = reactive.step(code, None, [(1, "GET.FILE.PAY-FILE", {"PAY-AMT": "1"})])
    kept, buffered, nxt = reactive.unpack_state(state)
    state = reactive.pack_state(kept | {"steps": machine.STEPS}, buffered, nxt)  # as after many records
    _, out = reactive.step(code, state, [(2, "GET.FILE.PAY-FILE", {"PAY-AMT": "2"}), (3, "END.FILE.PAY-FILE", {})])
    assert [r[3] for r in out if r[1] == "display"] == ["3.00"]


def test_endless_programs_raise(spark):
    text = program("01 A PIC 9.", "M1.\n    GO TO M1.")
    with pytest.raises(machine.Endless):
        reactive.step(machine.Code(parse_programs(text)[0]), None, [])
    df = spark.createDataFrame([(1, 1, D(1))], "k int, i int, x decimal(9,2)")
    with pytest.raises(Exception, match="reads no record"):
        reactive.run_files(df, ["k"], ["i"], "F1", text, {"A": "decimal(1,0)"}).collect()


def test_hot_group_in_order(spark):
    """More records than a million steps used to reach, with signs mixed so that the group cannot be summed at once."""
    n = 90_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("ord_status"), F.lit(D("300000.10")).cast("decimal(9,2)").alias("ord_amt"))
    (r,) = foldplan.run(samples.ORDERS, df, ["k"], ["i"]).collect()
    assert (r.all_count, r.big_count, r.open_sum, r.net, r.last_status) == (n, n // 2, n // 2 * D("300000.10"), 0, "F")


def test_estate_chains_of_any_depth(spark):
    moves = "\n".join(f"    MOVE F{i + 1} TO F{i}" for i in range(25))
    fields = "\n".join(f"01 F{i} PIC X(8)." for i in range(25))
    calls = program(fields, f"M1.\n{moves}\n    CALL F0\n    STOP RUN.", linkage="01 F25 PIC X(8).")
    levels = "01 REC.\n    02 G2 OCCURS 2.\n" + "\n".join(f"    {i:02d} G{i}." for i in range(3, 13)) + "\n    13 LEAF PIC X(3).\n    02 LAST1 PIC X."
    n = 120
    ring = "\n".join(f"P{i}.\n    PERFORM P{(i + 1) % n}." for i in range(n))
    texts = [(k, t.replace("CASE1", k)) for k, t in (("CALLS", calls), ("DEEP", program(levels, "M1.\n    STOP RUN.")), ("RING", program("01 A PIC X.", f"M1.\n    PERFORM P0\n    STOP RUN.\n{ring}")))]
    facts = estate.parse_estate(spark.createDataFrame(texts, "name string, text string")).cache()
    got = {r.operand: (r.outcome, r.steps) for r in views.dynamic_calls(facts.where("program = 'CALLS'")).collect()}
    assert got == {"F0": ("caller", 25)}
    got = {r.name: (r.start, r.length, r.record_size) for r in views.record_layout(facts.where("program = 'DEEP'")).collect()}
    assert got == {"LEAF": (1, 3, 7), "LAST1": (7, 1, 7)}
    got = {r.paragraph for r in views.perform_cycles(facts.where("program = 'RING'")).collect()}
    assert got == {f"P{i}" for i in range(n)}


def test_all_orders_are_joined(spark):
    got = data_queries.QUERIES["join_keys"](spark, SF).select("o_orderkey").collect()
    assert sorted(r.o_orderkey for r in got) == sorted(r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
