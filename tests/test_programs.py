"""Whole programs on records against results worked out by hand, in batch, by events and as a stream."""

from decimal import Decimal as D

import pytest

from tallyframe.plans import samples
from tallyframe.plans.machine import Refused, drive
from tallyframe.plans.parse import parse_programs
from tallyframe.streaming import reactive
from tests_support import program


def context(working: str, code: str, **k) -> dict:
    p = parse_programs(program(working, code))[0]
    assert not [q for q in p.paragraphs if q.error], [q.error for q in p.paragraphs]
    got = drive(p, **k)
    assert got["halted"] == "done"
    return got["context"]


@pytest.mark.parametrize(
    "rows,total,shown,trace",
    [
        (["0.10", "0.20", "100.55", "12.34", "0.01"], "113.20", "113.20", ["0", "0.10", "0.30", "100.85", "113.19", "113.20"]),
        ([], "0", "0", ["0"]), (["5"], "5.00", "5.00", ["0", "5.00"]), (["1.00", "2.00", "3.00"], "6.00", "6.00", ["0", "1.00", "3.00", "6.00"]),
    ],
)
def test_read_loop_totals(rows, total, shown, trace):
    got = drive(parse_programs(samples.TOTALS)[0], {"PAY-FILE": [{"PAY-AMT": r} for r in rows]})
    assert got["context"]["WS-SUM"] == D(total) and got["display"] == [shown] and got["steps"] < 1000
    assert [format(c["WS-SUM"], "f") for c in got["cycles"]] == trace


def test_loops():
    c = context("01 I PIC 9(4).\n01 S PIC 9(6).", "M1.\n    PERFORM P1 UNTIL I = 5\n    STOP RUN.\nP1.\n    ADD 1 TO I\n    ADD I TO S.")
    assert (c["I"], c["S"]) == (5, 15)
    c = context("01 I PIC 99.\n01 S PIC 999.", "M1.\n    PERFORM P1 VARYING I FROM 1 BY 1 UNTIL I > 5\n    STOP RUN.\nP1.\n    ADD I TO S.")
    assert (c["I"], c["S"]) == (6, 15)
    c = context("01 A PIC 9(4).\n01 B PIC 9(4).", "M1.\n    PERFORM P1 5 TIMES\n    PERFORM 5 TIMES\n        ADD 1 TO B\n    END-PERFORM\n    STOP RUN.\nP1.\n    ADD 1 TO A.")
    assert (c["A"], c["B"]) == (5, 5)
    c = context("01 I PIC 9(4).\n01 J PIC 9(4).\n01 S PIC 9(4).", "M1.\n    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3\n        AFTER J FROM 1 BY 1 UNTIL J > 2\n        ADD 1 TO S\n    END-PERFORM\n    STOP RUN.")
    assert c["S"] == 6
    c = context("01 I PIC 9(4).\n01 T PIC 9(4).", "M1.\n    PERFORM WITH TEST AFTER UNTIL I > 0\n        ADD 1 TO I\n    END-PERFORM\n    PERFORM UNTIL I > 9\n        ADD 1 TO I\n        IF I = 4\n            EXIT PERFORM CYCLE\n        END-IF\n        IF I = 6\n            EXIT PERFORM\n        END-IF\n        ADD 1 TO T\n    END-PERFORM\n    STOP RUN.")
    assert (c["I"], c["T"]) == (6, 3)


def test_ranges_sections_and_calls():
    c = context("01 N PIC 9(4).", "M1.\n    PERFORM A1 THRU C1\n    STOP RUN.\nA1.\n    COMPUTE N = N * 10 + 1.\nB1.\n    COMPUTE N = N * 10 + 2.\nC1.\n    COMPUTE N = N * 10 + 3.")
    assert c["N"] == 123
    c = context("01 A PIC 9(4).\n01 B PIC 9(4).", "M0 SECTION.\nM1.\n    PERFORM CALC\n    MOVE A TO B\n    STOP RUN.\nCALC SECTION.\nC1.\n    ADD 5 TO A.\nC2.\n    ADD 7 TO A.\nPOST SECTION.\nP1.\n    ADD 100 TO A.")
    assert (c["A"], c["B"]) == (12, 12)
    c = context("01 N PIC S9(5).", "M1.\n    PERFORM A1\n    PERFORM BUMP\n    PERFORM B1\n    PERFORM BUMP\n    PERFORM C1\n    PERFORM C1\n    STOP RUN.\nA1.\n    ADD 0 TO N.\nB1.\n    MULTIPLY 10 BY N.\nC1.\n    ADD 2 TO N.\nBUMP.\n    ADD 1 TO N.")
    assert c["N"] == 15
    c = context("01 A PIC 9(4).\n01 R PIC X.\n01 X PIC 9 VALUE 1.", "M1.\n    PERFORM P1\n    STOP RUN.\nP1.\n    IF X = 1\n        MOVE 'A' TO R\n        EXIT PARAGRAPH\n    END-IF\n    MOVE 'B' TO R.")
    assert c["R"] == "A"


def test_transfers():
    c = context("01 B PIC 9 VALUE 2.\n01 R PIC X.", "M1.\n    GO TO P1 P2 P3 DEPENDING ON B.\nF1.\n    MOVE 'F' TO R\n    STOP RUN.\nP1.\n    MOVE 'A' TO R\n    STOP RUN.\nP2.\n    MOVE 'B' TO R\n    STOP RUN.\nP3.\n    MOVE 'C' TO R\n    STOP RUN.")
    assert c["R"] == "B"
    c = context("01 F PIC 9(3).\n01 N PIC 9(3).", "M1.\n    PERFORM SW THRU SX 3 TIMES\n    STOP RUN.\nSW.\n    GO TO FIRST1.\nFIRST1.\n    ADD 1 TO F\n    ALTER SW TO PROCEED TO NORM\n    GO TO SX.\nNORM.\n    ADD 1 TO N.\nSX.\n    EXIT.")
    assert (c["F"], c["N"]) == (1, 2)


def test_tables_division_and_text():
    c = context("01 T-AREA.\n    05 T PIC 9(3) OCCURS 5.\n01 S PIC 9(4).\n01 I PIC 9(2).", "M1.\n    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 5\n        COMPUTE T(I) = I * 10\n    END-PERFORM\n    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 5\n        ADD T(I) TO S\n    END-PERFORM\n    STOP RUN.")
    assert c["S"] == 150 and c["T"] == [10, 20, 30, 40, 50]
    c = context("01 Q PIC 9(4).\n01 R PIC 9(4).\n01 RATE PIC V9(8) VALUE 0.00000001.\n01 NM PIC X(5).", "M1.\n    DIVIDE 7 BY 2 GIVING Q REMAINDER R\n    MOVE 'TO BE' TO NM\n    MOVE 'x' TO NM(4:1)\n    STOP RUN.")
    assert (c["Q"], c["R"], c["RATE"], c["NM"]) == (3, 1, D("0.00000001"), "TO xE")
    with pytest.raises(IndexError):
        context("01 A1.\n    05 T PIC 9 OCCURS 2.\n01 I PIC 9 VALUE 3.\n01 S PIC 9.", "M1.\n    MOVE T(I) TO S\n    STOP RUN.")


NOTEND = program(
    "01 WS-CNT PIC 9(3).\n01 WS-SUM PIC 9(5)V99.\n01 WS-END PIC X VALUE 'N'.",
    "M1.\n    PERFORM UNTIL WS-END = 'Y'\n        READ IN-FILE\n            AT END MOVE 'Y' TO WS-END\n            NOT AT END\n                ADD 1 TO WS-CNT\n                ADD IN-AMT TO WS-SUM\n        END-READ\n    END-PERFORM\n    STOP RUN.",
    "FD IN-FILE.\n01 IN-REC.\n    05 IN-AMT PIC 9(3)V99.", control="    SELECT IN-FILE ASSIGN TO INF.",
)
INTO = program(
    "01 WS-REC.\n    05 WS-KEY PIC X(8).\n    05 WS-AMT PIC 9(5).\n01 WS-CNT PIC 9(3).\n01 WS-SUM PIC 9(7).\n01 OUT-KEY PIC X(8).\n01 E PIC X.",
    "M1.\n    PERFORM UNTIL E = 'Y'\n        READ F1 INTO WS-REC\n            AT END MOVE 'Y' TO E\n            NOT AT END\n                ADD 1 TO WS-CNT\n                ADD WS-AMT TO WS-SUM\n                MOVE WS-KEY TO OUT-KEY\n        END-READ\n    END-PERFORM\n    STOP RUN.",
    "FD F1.\n01 F1-REC.\n    05 F1-KEY PIC X(8).\n    05 F1-AMT PIC 9(5).",
)


def test_handlers_and_into():
    c = drive(parse_programs(NOTEND)[0], {"IN-FILE": [{"IN-AMT": x} for x in ("1.50", "2.25", "3.00")]})["context"]
    assert (c["WS-CNT"], c["WS-SUM"], c["WS-END"]) == (3, D("6.75"), "Y")
    c = drive(parse_programs(NOTEND)[0])["context"]
    assert (c["WS-CNT"], c["WS-END"]) == (0, "Y")
    rows = [{"F1-KEY": k, "F1-AMT": a} for k, a in (("AAAA1111", "21"), ("BBBB2222", "100"), ("CCCC3333", "7"))]
    c = drive(parse_programs(INTO)[0], {"F1": rows})["context"]
    assert (c["WS-CNT"], c["WS-SUM"], c["OUT-KEY"]) == (3, 128, "CCCC3333")


def test_external_inputs_and_step_limit():
    p = parse_programs(program("01 A PIC 9(3).\n01 B PIC X(3).", "M1.\n    ACCEPT A\n    ACCEPT B\n    IF FUNCTION FOO(A) > 1\n        MOVE 'yes' TO B\n    END-IF\n    STOP RUN."))[0]
    got = drive(p, external={"A": "7", "B": "q"})
    assert got["context"]["A"] == 7 and got["context"]["B"] == "q  " and any("FOO" in f for f in got["flags"])
    loop = parse_programs(program("01 A PIC 9.", "M1.\n    GO TO M1."))[0]
    assert drive(loop, steps=50)["halted"] == "steps"


# events


def feed(events, source=samples.TOTALS, cuts=()):
    p = reactive.compile_reactive(source)
    state, out, rows = None, [], [(i + 1, *e) for i, e in enumerate(events)]
    for part in (rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))):
        state, more = reactive.step(reactive.Code(p), state, part)
        out += more
    return out


def test_events_give_the_batch_total_however_they_are_cut():
    ev = [("GET.FILE.PAY-FILE", {"PAY-AMT": x}) for x in ("0.10", "0.20", "100.55", "12.34", "0.01")] + [("END.FILE.PAY-FILE", {})]
    for cuts in ((), (1,), (2, 5), (1, 2, 3, 4, 5)):
        out = feed(ev, cuts=cuts)
        assert [r[3] for r in out if r[1] == "display"] == ["113.20"]
        assert ("done", "WS-SUM", "113.20") in [r[1:] for r in out]
    assert [r[3] for r in feed([("END.FILE.PAY-FILE", {})]) if r[1] == "display"] == ["0"]


def test_events_out_of_order_wait_and_repeats_are_told():
    p = reactive.compile_reactive(samples.TOTALS)
    e = lambda n, x: (n, "GET.FILE.PAY-FILE", {"PAY-AMT": x})
    state, out = reactive.step(reactive.Code(p), None, [e(2, "2"), e(3, "3")])
    assert [r[1] for r in out] == ["gap"]
    state, out = reactive.step(reactive.Code(p), state, [e(1, "1"), e(2, "9"), (4, "END.FILE.PAY-FILE", {})])
    assert [r[1] for r in out if r[1] != "done"] == ["repeated", "display"] and [r[3] for r in out if r[1] == "display"] == ["6.00"]
    state, out = reactive.step(reactive.Code(p), state, [e(5, "1")])
    assert [r[1] for r in out] == ["ignored"]


def test_refusals_and_manifest():
    with pytest.raises(Refused):
        reactive.compile_reactive(samples.LOOPS)
    handlers = program("01 N PIC 9.", "DECLARATIVES.\nH1 SECTION.\n    USE AFTER STANDARD ERROR PROCEDURE ON F1.\nH2.\n    ADD 1 TO N.\nEND DECLARATIVES.\nM1.\n    STOP RUN.")
    with pytest.raises(Refused):
        reactive.compile_reactive(handlers)
    names = [r["event"] for r in reactive.manifest(parse_programs(samples.TOTALS)[0])]
    assert names == ["CREATE.CONSOLE.SYSOUT", "GET.FILE.PAY-FILE", "END.FILE.PAY-FILE"]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", i + 1, "GET.FILE.PAY-FILE", {"PAY-AMT": str(i)}) for i in range(4)] + [("a", 5, "END.FILE.PAY-FILE", {}), ("b", 1, "END.FILE.PAY-FILE", {})]
    df = spark.createDataFrame(rows, reactive.EVENT)
    for k, part in enumerate((df.where("seq in (1, 3)"), df.where("seq not in (1, 3)"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = reactive.run_stream(stream, samples.TOTALS).writeStream.format("memory").queryName("reacted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.key, r.value) for r in spark.table("reacted").where("kind = 'display'").collect()}
    want = {(r.key, r.value) for r in reactive.run_batch(df, samples.TOTALS).where("kind = 'display'").collect()}
    assert got == want == {("a", "6.00"), ("b", "0")}


CREDIT = program(
    "01 WS-ID PIC X(4).\n01 WS-BAL PIC 9(5)V99.\n01 WS-OK PIC X.",
    """M1.
    ACCEPT WS-ID
    EXEC SQL
        SELECT BAL INTO :WS-BAL FROM ACCOUNT WHERE ID = :WS-ID
    END-EXEC
    IF SQLCODE = 100
        MOVE 'N' TO WS-OK
    ELSE
        ADD 1 TO WS-BAL
        EXEC SQL
            UPDATE ACCOUNT SET BAL = :WS-BAL WHERE ID = :WS-ID
        END-EXEC
        IF SQLCODE = 0
            MOVE 'Y' TO WS-OK
        ELSE
            MOVE 'E' TO WS-OK
        END-IF
    END-IF
    CALL 'AUDIT' USING WS-OK
    STOP RUN.""",
)


@pytest.mark.parametrize("answer,update,ok,balance", [({"WS-BAL": "12.345", "SQLCODE": "0"}, "0", "Y", "13.34"), ({"WS-BAL": "1"}, "-911", "E", "2.00"), (None, None, "N", "0")])
def test_programs_wait_for_what_comes_in_and_publish_what_goes_out(answer, update, ok, balance):
    ev = [("GET.CONSOLE.SYSIN", {"WS-ID": "A1"}), ("GET.DB2.ACCOUNT", answer) if answer else ("END.DB2.ACCOUNT", {})]
    if answer and "SQLCODE" not in answer:  # the reply comes as an event of its own
        ev.append(("GET.RESPONSE.DB2", {"SQLCODE": "0"}))
    if update:
        ev.append(("GET.RESPONSE.DB2", {"SQLCODE": update}))
    for cuts in ((), tuple(range(1, len(ev)))):
        out = feed(ev, CREDIT, cuts)
        done = {r[2]: r[3] for r in out if r[1] == "done"}
        assert (done["WS-OK"].strip(), D(done["WS-BAL"])) == (ok, D(balance)) and not [r for r in out if r[1] == "ignored"]
        sent = [(r[2], r[3]) for r in out if r[1] == "publish"]
        assert sent[-1] == ("CREATE.PROGRAM.AUDIT", f'{{"WS-OK": "{ok}"}}') and [n for n, _ in sent] == (["CREATE.DB2.ACCOUNT"] if update else []) + ["CREATE.PROGRAM.AUDIT"]
    assert [r[1:] for r in feed([("GET.DB2.ACCOUNT", {})], CREDIT)] == [("ignored", "GET.DB2.ACCOUNT", "waiting for GET.CONSOLE.SYSIN")]
