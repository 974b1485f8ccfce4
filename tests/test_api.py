"""Whole-estate entry points and read loops compiled to aggregations."""

import json
import random
from decimal import Decimal as D

import pytest

from tallyframe import __main__ as command
from tallyframe import api
from tallyframe.functions.language import NotModelled
from tallyframe.operators import foldplan
from tallyframe.plans import samples
from tallyframe.plans.parse import parse_programs
from tallyframe.sources import estate
from tallyframe.streaming import reactive
from tests_support import program


def test_views_from_files_to_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for n, t in samples.PROGRAMS.items():
        (tmp_path / "src" / f"{n}.cbl").write_text(t)
    (tmp_path / "src" / "ACCTREC.cpy").write_text(samples.ACCTREC)
    assert command.main([str(tmp_path / "src"), "--out", str(tmp_path / "out"), "--view", "artifacts", "--view", "lineage"]) == 0
    assert {r.program for r in spark.read.json(str(tmp_path / "out" / "artifacts")).select("program").distinct().collect()} == {"TOTALS", "RULES", "RATES"}
    a = api.analyze_path(spark, str(tmp_path / "src"))
    rows = json.loads(a.document("sql-columns", "RATES"))
    assert {r["status"] for r in rows} == {"mapped", "derived", "refused: an indicator variable"}
    assert json.loads(a.document("perimeter", "LOOPS")) == []
    assert command.main([str(tmp_path / "nowhere"), "--out", str(tmp_path / "x")]) == 1


def test_gather_asks_only_for_what_is_planned(spark, tmp_path):
    programs = spark.createDataFrame([(n, t) for n, t in samples.PROGRAMS.items()], "name string, text string")
    plan = api.gather(programs, lambda name, kind: f"{kind} of {name}" if name == "ACCOUNT" else None, f"{tmp_path}/b")
    planned = {r.name for r in plan.where("status = 'planned'").collect()}
    got = {r.name: (r.outcome, r.text) for r in estate.replay(spark, f"{tmp_path}/b", plan.where("status = 'planned'")).collect()}
    assert set(got) == planned and got["ACCOUNT"] == ("found", "ddl of ACCOUNT") and got["ACCTREC"] == ("absent", None)


@pytest.mark.parametrize("source,file", [(samples.ORDERS, "ORD-FILE"), (samples.TOTALS, "PAY-FILE")])
def test_aggregation_equals_the_run(spark, source, file):
    rng = random.Random(file)
    rows = [(k, i, rng.choice("OFP"), D(rng.randrange(0, 10**8)).scaleb(-2)) for k in range(30) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "k int, i int, ord_status string, ord_amt decimal(9,2)").withColumnRenamed("ord_amt", "ord_amt" if "ORDERS" in source else "pay_amt")
    fast = foldplan.run(source, df, ["k"], ["i"])
    p = foldplan.plan(parse_programs(source)[0])
    out = {s.target: foldplan.Code(p.program).pictures[s.target].spark_type for s in p.steps}
    slow = reactive.run_files(df, ["k"], ["i"], file, source, out).select(*fast.columns)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


@pytest.mark.parametrize(
    "body,why",
    [
        ("ADD A TO S\n                IF S > 10\n                    ADD 1 TO N\n                END-IF", "which the loop writes"), ("COMPUTE S = S * 2 + A", "computed from itself"), ("DISPLAY A", "DISPLAY in the loop"),
        ("ADD X TO S", "more than the record"), ("ADD A TO S\n                MOVE 0 TO S", "both added to and replaced"), ("MOVE 'Y' TO E", "more than the record"),
    ],
)
def test_reasons_for_no_plan(body, why):
    text = program(
        "01 S PIC 9(5).\n01 N PIC 9(5).\n01 X PIC 9(5).\n01 E PIC X VALUE 'N'.",
        f"M1.\n    PERFORM UNTIL E = 'Y'\n        READ F1\n            AT END MOVE 'Y' TO E\n            NOT AT END\n                {body}\n        END-READ\n    END-PERFORM\n    STOP RUN.", "FD F1.\n01 R1.\n    05 A PIC 9(3).",
    )
    with pytest.raises(NotModelled, match=why):
        foldplan.plan(parse_programs(text)[0])
