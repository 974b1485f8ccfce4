"""Source reading, fact tables, flow, views, closure and retrieval."""

import sys

import pytest
from pyspark import cloudpickle

from tallyframe.plans import data_queries, estate_queries, flow, samples, views
from tallyframe.plans.facts import Facts, program_facts
from tallyframe.plans.parse import parse_programs
from tallyframe.plans.source_text import copy_members, detect_format, logical_lines, preprocess, replaced
from tallyframe.sources import estate
from tests_support import program


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the client below runs on the executors


@pytest.fixture(scope="module")
def facts(spark):
    return estate_queries.sample_facts(spark)


# text


def test_formats():
    assert detect_format(samples.TOTALS)[0] == "fixed"
    assert detect_format("IDENTIFICATION DIVISION.\nPROGRAM-ID. A.\nPROCEDURE DIVISION.\nDISPLAY 'x'.\n")[0] == "free"
    assert detect_format("      >>SOURCE FORMAT IS FREE\nx")[:2] == ("free", 1.0)
    assert detect_format("")[0] == "fixed"


def test_logical_lines():
    text = "      * note\n       MOVE 'it''s *> no' TO A *> yes\n      D    DISPLAY B\n       MOVE 'long\n      -    'er' TO C\n       CBL LIB\n"
    lines = [ln.text.strip() for ln in logical_lines(text, "fixed")]
    assert lines[0] == "MOVE 'it''s *> no' TO A" and len(lines) == 2 and lines[1].startswith("MOVE 'long") and lines[1].endswith("er' TO C")


def test_copy_replace_cycle_and_missing():
    members = {"A": "       01 :T:-REC. COPY B.\n", "B": "       05 OLD PIC X(3) VALUE 'OLD'.\n       COPY A.\n"}
    text = "       COPY A REPLACING ==:T:== BY ==NEW== OLD BY FRESH.\n       COPY NOPE.\n       DISPLAY 'COPY FAKE.'.\n"
    lines, copies = preprocess(text, members, "fixed")
    assert [(c["member"], c["status"], c["via"], c["replacing"]) for c in copies] == [("A", "found", None, True), ("B", "found", "A", False), ("A", "cycle", "B", False), ("NOPE", "missing", None, False)]
    assert any("NEW-REC" in ln.text for ln in lines)
    assert replaced("MOVE OLD TO 'OLD' OLD-1", [("OLD", "X")]) == "MOVE X TO 'OLD' OLD-1"
    assert copy_members(text, "fixed") == ["A", "NOPE"]
    kept = preprocess("       REPLACE ==AA== BY ==BB==.\n       MOVE AA TO C.\n       REPLACE OFF.\n       MOVE AA TO D.\n", {}, "fixed")[0]
    assert [ln.text.strip() for ln in kept] == ["MOVE BB TO C.", "MOVE AA TO D."]


def test_unreadable_paragraph_is_one_opaque_statement():
    p = parse_programs(program("01 A PIC 9.", "M1.\n    MOVE 1 TO A.\nBAD.\n    )( MOVE.\nEND1.\n    STOP RUN."))[0]
    bad = next(q for q in p.paragraphs if q.name == "BAD")
    assert bad.error and [s.kind for s in bad.body] == ["OPAQUE"] and any("did not parse" in f[2] for f in p.flags)


def test_contained_programs_and_duplicate_names():
    inner = "\n       IDENTIFICATION DIVISION.\n       PROGRAM-ID. INNER.\n       PROCEDURE DIVISION.\n       I1.\n           GOBACK.\n       END PROGRAM INNER.\n       END PROGRAM CASE1.\n"
    got = parse_programs(program("01 A PIC 9.", "S1 SECTION.\nP1.\n    ADD 1 TO A.\nS2 SECTION.\nP1.\n    CALL 'INNER'\n    STOP RUN.") + inner)
    assert [(p.name, p.inside) for p in got] == [("CASE1", None), ("INNER", "CASE1")]
    assert [q.name for q in got[0].paragraphs if q.body] == ["P1", "P1_OF_S2"]


def test_missing_target_is_flagged():
    rows = program_facts(parse_programs(program("01 A PIC 9.", "M1.\n    GO TO NOWHERE."))[0], "X")
    assert any("NOWHERE does not exist" in r["message"] for f, r in rows if f == "flag")


def test_conditions_that_cannot_be_read_are_flagged():
    code = "M1.\n    IF FUNCTION F1(A) = 1\n        DISPLAY A\n    END-IF\n    EVALUATE A\n        WHEN FUNCTION F2(A)\n            DISPLAY A\n    END-EVALUATE\n    PERFORM UNTIL A = HIGH-VALUE\n        ADD 1 TO A\n    END-PERFORM\n    STOP RUN."
    rows = program_facts(parse_programs(program("01 A PIC 9.", code))[0], "X")
    assert len([r for f, r in rows if f == "flag" and r["message"].startswith("condition is not modelled")]) == 3


# flow


def wide(n: int) -> str:
    """n performed paragraphs, each with one IF and ELSE that meet again."""
    fields = "\n".join(f"01 W{i} PIC X." for i in range(n))
    calls = "\n".join(f"    PERFORM P{i}" for i in range(n))
    paras = "\n".join(f"P{i}.\n    IF W{i} = 'A'\n        MOVE 'B' TO W{i}\n    ELSE\n        MOVE 'C' TO W{i}\n    END-IF\n    DISPLAY W{i}." for i in range(n))
    return program(fields, f"M1.\n{calls}\n    STOP RUN.\n{paras}")


@pytest.mark.parametrize("n", [3, 40])
def test_conditions_are_a_fixpoint_and_visits_stay_bounded(n):
    f = Facts(parse_programs(wide(n))[0], "X")
    out, _, guards = flow.successors(f.code)
    must, may, settled = flow.conditions(out, len(guards))
    assert settled and len(guards) == n and set(must) == set(out)
    for node, edges in out.items():
        for nxt, _, g, negated in edges:
            m = must[node] if g is None else (must[node] & ~(1 << (2 * g + (not negated)))) | 1 << (2 * g + negated)
            assert must[nxt] & m == must[nxt] and must[nxt] & ~may[nxt] == 0
    shown = [node for node in out if f.code.code[node[0]][0] == "do" and f.code.code[node[0]][1].kind == "DISPLAY"]
    assert len(shown) == n and all(must[s] == 0 for s in shown)


def test_business_walk_stays_linear_on_diamonds():
    n = 60
    fields = "\n".join(f"01 D{i} PIC X." for i in range(n))
    ifs = "\n".join(f"    IF FUNCTION F(D{i}) = 1\n        MOVE 'B' TO D{i}\n    END-IF" for i in range(n))
    f = Facts(parse_programs(program(fields, f"M1.\n    DISPLAY 'A'\n{ifs}\n    IF D1 = 'A'\n        DISPLAY 'Z'\n    END-IF\n    STOP RUN."))[0], "X")
    rows = flow.analyse(f)
    steps = [r for k, r in rows if k == "business_step"]
    assert [(r["rule"], r["partial"]) for r in steps if r["source"] and r["target"] and r["source"] != r["target"]] == [(["D1 = 'A'"], False)]
    assert not [r for k, r in rows if k == "flag" and "budget" in r["message"]]


def test_unreached_is_not_unconditional():
    rows = program_facts(parse_programs(program("01 A PIC 9.", "M1.\n    STOP RUN.\nDEAD.\n    DISPLAY A."))[0], "X")
    assert not [r for f, r in rows if f == "lineage"] and any("DEAD is never reached" in r["message"] for f, r in rows if f == "flag")


def test_call_arguments_may_come_from_the_callee():
    rows = program_facts(parse_programs(program("01 A PIC X.\n01 B PIC X.", "M1.\n    ACCEPT A\n    CALL 'SUBP' USING A\n    STRING A DELIMITED BY SIZE INTO B\n    DISPLAY B\n    STOP RUN."))[0], "X")
    shown = next(r for f, r in rows if f == "lineage" and r["event"] == "CREATE.CONSOLE.SYSOUT")
    assert {(o["event"], o["maybe"], o["resolved_by"]) for o in shown["origins"]} == {("GET.CONSOLE.SYSIN", False, None), ("GET.PROGRAM.SUBP", True, "SUBP")}


def test_loop_references_come_back_to_the_source():
    rows = program_facts(parse_programs(samples.TOTALS)[0], "X")
    shown = next(r for f, r in rows if f == "lineage" and r["event"] == "CREATE.CONSOLE.SYSOUT")
    assert [o["event"] for o in shown["origins"]] == ["GET.FILE.PAY-FILE"] and {c["kind"] for c in shown["conditions"]} == {"control"}


# views


def test_views_do_not_depend_on_partitioning(spark):
    programs = spark.createDataFrame(sorted(samples.PROGRAMS.items()), "name string, text string")
    members = spark.createDataFrame(sorted(samples.MEMBERS.items()), "name string, text string")
    seen = []
    for n in (1, 7):
        f = estate.parse_estate(programs.repartition(n), members).cache()
        seen.append([sorted(map(str, v(f).collect())) for v in (views.artifacts, views.calls, views.lineage, views.record_layout)])
    assert seen[0] == seen[1]


def test_unreadable_program_gives_a_flag(spark):
    programs = spark.createDataFrame([("GOOD", samples.LOOPS), ("NONE", None), ("EMPTY", "")], "name string, text string")
    f = estate.parse_estate(programs)
    assert {r.program for r in estate.fact_table(f, "program").collect()} >= {"LOOPS"}


def test_handlers_give_no_business_view(spark):
    text = program("01 N PIC 9.", "DECLARATIVES.\nH1 SECTION.\n    USE AFTER STANDARD ERROR PROCEDURE ON F1.\nH2.\n    ADD 1 TO N.\nEND DECLARATIVES.\nM1.\n    DISPLAY N\n    STOP RUN.")
    f = estate.parse_estate(spark.createDataFrame([("H", text)], "name string, text string"))
    assert [r.event for r in views.business_rules(f).collect()] == ["<handlers run beside the main flow: not distilled>"]


def test_dynamic_call_outcomes(spark):
    text = program(
        "01 P1 PIC X(8).\n01 P2 PIC X(8) VALUE 'A'.\n01 P3 PIC X(8).\n    88 IS-B VALUE 'B'.\n01 P4 PIC X(8).\n01 P5 PIC X(8).",
        "M1.\n    MOVE LK TO P1\n    CALL P1\n    MOVE 'C' TO P2\n    CALL P2\n    CALL P3\n    CALL P4\n    CALL P6\n    CALL 'FILLER' USING P5\n    MOVE P5 TO P4\n    STOP RUN.", linkage="01 LK PIC X(8).",
    )
    f = estate.parse_estate(spark.createDataFrame([("D", text)], "name string, text string"))
    got = {r.operand: r.outcome for r in views.dynamic_calls(f).collect()}
    assert got == {"P1": "caller", "P2": "candidates", "P3": "declared-candidates", "P4": "called-program", "P6": "chain-broken"}


def test_categories(spark):
    text = program("01 A PIC X.", "M1.\n    CALL 'MQPUT'\n    CALL 'DSNTIAR'\n    CALL 'CEELOCT'\n    CALL 'DFHEI1'\n    CALL 'MINE'\n    EXEC CICS LINK PROGRAM('NEXT1') COMMAREA(A) END-EXEC\n    STOP RUN.")
    f = estate.parse_estate(spark.createDataFrame([("C", text)], "name string, text string"))
    assert {r.callee: r.category for r in views.calls(f).collect()} == {"MQPUT": "ibm-mq", "DSNTIAR": "ibm-db2", "CEELOCT": "ibm-le", "DFHEI1": "ibm-cics", "MINE": "unresolved-program", "NEXT1": "unresolved-program"}


def test_cics_and_ims_events():
    code = "M1.\n" + "\n".join(f"    EXEC {x} END-EXEC" for x in (
        "CICS READ FILE('CUST') INTO(A)\n      RIDFLD(K)", "CICS WRITEQ TS QUEUE('Q1') FROM(A)", "CICS SEND MAP('M1') FROM(A)", "CICS RECEIVE MAP('M1') INTO(A)", "CICS START TRANSID('T1') FROM(A)", "CICS RETURN TRANSID('T1') COMMAREA(A)",
        "CICS READ FILE(A) INTO(K)", "DLI GU SEGMENT(S)", "DLI ISRT SEGMENT(S)", "SQL EXECUTE IMMEDIATE :A", "CICS ABEND ABCODE('AB1')",
    )) + "\n    STOP RUN."
    rows = [r for f, r in program_facts(parse_programs(program("01 A PIC X.\n01 K PIC X.", code))[0], "X") if f == "event"]
    assert [(r["event"], r["dynamic"]) for r in rows] == [
        ("GET.FILE.CUST", False), ("CREATE.QUEUE.Q1", False), ("CREATE.TERMINAL.M1", False), ("GET.TERMINAL.M1", False), ("CREATE.TRANSACTION.T1", False), ("CREATE.CALLER.CALLER", False), ("GET.FILE.A", True),
        ("GET.IMS.IMS-DB", False), ("CREATE.IMS.IMS-DB", False), ("GET.DB2.<dynamic-sql>", True), ("CREATE.DB2.<dynamic-sql>", True), ("CREATE.CONDITION.AB1", False),
    ]
    assert rows[0]["params"] == ["K"]


# closure and retrieval


def test_copy_closure_by_levels(spark):
    programs = spark.createDataFrame([("P", "       COPY A.\n"), ("Q", "       COPY C.\n")], "name string, text string")
    members = spark.createDataFrame([("A", "       COPY B.\n"), ("B", "       COPY A.\n       COPY C.\n")], "name string, text string")
    got = {(r.source, r.member, r.level, r.status) for r in estate.copy_closure(programs, members).collect()}
    assert got == {("P", "A", 0, "found"), ("P", "B", 1, "found"), ("P", "C", 2, "missing"), ("Q", "C", 0, "missing")}


def client(name, kind):
    if name == "ERR":
        raise OSError("down")
    return {"ONE": {"cobol": "text"}, "ASM": {"asm": "asm text"}, "TWO": {"cobol": ["TWO.A", "TWO.B"]}, "SWAP": {"cobol": {"text": "x", "type": "pli"}}, "RAW": {"cobol": b"caf\xe9"}}.get(name, {}).get(kind)


def test_retrieval_outcomes_and_replay(spark, tmp_path):
    names = ["ONE", "ASM", "TWO", "SWAP", "RAW", "NONE", "ERR", "ONE"]
    plan = spark.createDataFrame([(n, ["cobol", "asm"]) for n in names], "name string, types array<string>")
    answers = estate.retrieve(plan, client)
    want = {"ONE": ("found", "cobol"), "ASM": ("found", "asm"), "TWO": ("alternatives", None), "SWAP": ("found-as-other-type", "pli"), "RAW": ("found", "cobol"), "NONE": ("absent", None), "ERR": ("error", None)}
    assert {r.name: (r.outcome, r.found_type) for r in answers.collect()} == want
    estate.write_bundle(answers, f"{tmp_path}/bundle")
    asked = plan.unionByName(spark.createDataFrame([("NEW", ["cobol"])], plan.schema))
    again = {r.name: r.outcome for r in estate.replay(spark, f"{tmp_path}/bundle", asked).collect()}
    assert again == {n: o for n, (o, _) in want.items()} | {"NEW": "not-recorded"}
    assert {r.name: r.text for r in answers.collect()}["RAW"] == "café"


def test_read_members(spark, tmp_path):
    (tmp_path / "TOTALS.cbl").write_text(samples.TOTALS)
    (tmp_path / "REC.cpy").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "RUN.cntl").write_text("//RUN1 JOB (A)\n")
    got = {r.name: (r.type, r.text[:5].strip()) for r in estate.read_members(spark, str(tmp_path)).collect()}
    assert {n: k for n, (k, _) in got.items()} == {"TOTALS": "cobol", "REC": "copybook", "RUN": "jcl"} and got["REC"][1] == "café"


def test_every_query_has_a_name_of_its_own():
    assert not set(data_queries.QUERIES) & set(estate_queries.QUERIES)


# what is easily taken for something else


def test_names_that_look_like_directives():
    code = "PROCESS-RECORD.\n    MOVE 1 TO A.\nTITLE-PARA.\n    MOVE 2 TO A.\nSKIP1-X.\n    MOVE 3 TO A.\nEJECT-ALL.\n    MOVE 4 TO A.\nCBL-END.\n    STOP RUN."
    text = "CBL LIB,APOST\n       PROCESS NOSEQ\n" + program("01 A PIC 9.", code).replace("       PROGRAM-ID", "       TITLE 'ONE. TWO'.\n       EJECT\n       SKIP2.\n       PROGRAM-ID", 1)
    (p,) = parse_programs(text)
    assert [q.name for q in p.paragraphs] == ["PROCESS-RECORD", "TITLE-PARA", "SKIP1-X", "EJECT-ALL", "CBL-END"] and p.name == "CASE1"
    (p,) = parse_programs(program("01 A PIC 9.", "PROCESS.\n    STOP RUN."))
    assert [q.name for q in p.paragraphs] == ["PROCESS"]


def test_copy_over_several_lines():
    text = "       COPY\n           A\n           REPLACING ==X. Y== BY ==P. Q==\n               OLD BY NEW.\n       EXEC SQL\n           INCLUDE B\n       END-EXEC.\n       ADD 1 TO CTR-COPY.\n       MOVE 'X' TO A. COPY C. COPY D.\n"
    members = {"A": "       05 OLD PIC X.\n       COPY E.\n", "E": "       05 OLD-E PIC X. 05 OLD PIC 9.\n"}
    lines, copies = preprocess(text, members, "fixed")
    assert [(c["member"], c["status"], c["replacing"]) for c in copies] == [("A", "found", True), ("E", "found", False), ("B", "missing", False), ("C", "missing", False), ("D", "missing", False)]
    assert [(ln.text.strip(), ln.member) for ln in lines] == [("05 NEW PIC X.", "A"), ("05 OLD-E PIC X. 05 NEW PIC 9.", "E"), ("ADD 1 TO CTR-COPY.", None), ("MOVE 'X' TO A.", None)]
    assert copy_members(text, "fixed") == ["A", "B", "C", "D"]
    assert replaced("MOVE 'OLD' TO PRE-A A-PRE 'OLD''S'", [("'OLD'", "'NEW'"), ("PRE", "X", "LEADING")]) == "MOVE 'NEW' TO X-A A-PRE 'OLD''S'"


def test_members_have_the_format_of_their_program():
    member = "05 WS-LONG-NAME-A PIC X(3).\n05 WS-B PIC 9(2).\n"  # in fixed format the first six columns would be cut off
    free = "IDENTIFICATION DIVISION.\nPROGRAM-ID. FREE1.\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n01 REC.\nCOPY M1.\nPROCEDURE DIVISION.\nMAIN-PARA.\n    STOP RUN.\n"
    (p,) = parse_programs(free, {"M1": member})
    assert [i.name for i in p.items] == ["REC", "WS-LONG-NAME-A", "WS-B"]
    (p,) = parse_programs(free, {"M1": "      >>SOURCE FORMAT IS FIXED\n000100 05 WS-A PIC X.\n000200*05 WS-C PIC X.\n"})
    assert [i.name for i in p.items] == ["REC", "WS-A"]


def test_formats_by_each_signal():
    assert detect_format("123456*  note\nAB0001 MOVE A TO B.\n")[:2] == ("fixed", 0.97)
    assert detect_format("       DATA DIVISION.\n      Q    x\n")[:2] == ("fixed", 0.95)
    assert detect_format("MOVE A TO B.\n" + "X" * 90)[:2] == ("free", 0.85)
    assert detect_format("DISPLAY A.\n")[:2] == ("free", 0.9)
    assert detect_format("       A\n" * 20 + "      Q\n")[:2] == ("fixed", 0.6)


def test_member_priority_and_bundle_keys(spark, tmp_path):
    rows = [("A", "client", "client", None, None), ("A", "late", "path", "/b", "cpy"), ("A", "cbl", "path", "/a", "cbl"), ("A", "cpy", "path", "/a", "cpy"), ("A", "out", "path", "/z", "cpy"), ("B", "old", "cache", None, None), ("b", "kept", "store", None, None)]
    got = estate.resolve_members(spark.createDataFrame(rows, "name string, text string, origin string, path string, suffix string"), ["/a", "/b"])
    assert {(r.name, r.text, r.alternatives) for r in got.collect()} == {("A", "cpy", 3), ("B", "kept", 1)}
    answers = spark.createDataFrame([("P", "cobol", "absent", None, None, [], None), ("P", "asm", "found", "asm", "x", [], None)], estate.ANSWER)
    estate.write_bundle(answers, str(tmp_path / "b"))
    plan = spark.createDataFrame([("P", "cobol"), ("P", "asm"), ("Q", "cobol")], "name string, type string")
    assert {(r.name, r.type, r.outcome) for r in estate.replay(spark, str(tmp_path / "b"), plan).collect()} == {("P", "cobol", "absent"), ("P", "asm", "found"), ("Q", "cobol", "not-recorded")}
    with pytest.raises(KeyError, match="Q cobol"):
        estate.replay(spark, str(tmp_path / "b"), plan, strict=True)
