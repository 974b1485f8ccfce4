"""Names, hierarchy, sources of dynamic calls, run conditions, byte-range utilities and streamed folds."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyframe.operators import fold, records
from tallyframe.plans import jobs, samples, views
from tallyframe.sources import estate
from tests_support import program


def parsed(spark, *texts, members=None):
    rows = spark.createDataFrame(list(texts), "name string, text string")
    found = None if members is None else spark.createDataFrame(members, "name string, text string")
    return estate.parse_estate(rows, found).cache()


def test_slugs(spark):
    texts = ["A >= 1", "IF A<>'b c'", "   ", "'()'", "x" * 70, "A - B_ C", "a  =  b"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(views.slug(F.col("t")).alias("s")).collect()]
    assert got == ["A_ge_1", "IF_A_ne_b_c", "x", "x", "x" * 60, "A_-_B_C", "a_eq_b"]
    one = spark.createDataFrame([("move 'Err' to a", "MOVE 'Err' TO A"), ("move 'Err' to a", "MOVE 'ERR' TO A")], "a string, b string")
    assert [r[0] for r in one.select(views.signature(F.col("a")) == views.signature(F.col("b"))).collect()] == [True, False]


def test_names_are_unique_and_repeated_texts_share_one(spark):
    code = "M1.\n    MOVE 'y' TO A\n    MOVE 'Y' TO A\n    move 'y' to A\n    MOVE 'Y' TO A-2\n    MOVE '(Y' TO A\n    STOP RUN."
    got = views.names(parsed(spark, ("N", program("01 A PIC X.\n01 A-2 PIC X.", code)))).where("kind = 'action'").orderBy("line").collect()
    assert [(r.name, r.text) for r in got][:2] == [("MOVE_y_TO_A", "MOVE 'y' TO A"), ("MOVE_Y_TO_A", "MOVE 'Y' TO A")]
    assert len({r.name for r in got}) == len(got) == 5 and "MOVE_Y_TO_A_2" in {r.name for r in got}


def test_hierarchy_and_members(spark):
    facts = parsed(spark, ("H", program("    COPY M1.\n    COPY M9.", "S1 SECTION.\nP1.\n    IF X1 = 1\n        DISPLAY X1\n    END-IF.\nP2.\n    COPY M2.")), members=[("M1", "       01 X1 PIC 9.\n       01 X2 PIC 9.\n"), ("M2", "           ADD 1 TO X1\n           STOP RUN.\n")])
    got = {r.paragraph: (r.section, r.compound, r.initial == r.states[0].state) for r in views.hierarchy(facts).collect()}
    assert got["P1"] == ("S1", True, True) and got["P2"][0] == "S1"
    got = {(r.member, r.status, r["items"], r.paragraphs, r.statements) for r in views.member_counts(facts).collect()}
    assert got == {("M1", "found", 2, 0, 0), ("M9", "missing", 0, 0, 0), ("M2", "found", 0, 1, 2)}


def test_sources_of_dynamic_calls(spark):
    working = "01 W-PGM PIC X(8).\n01 W-MID PIC X(8).\n01 W-REF PIC X(8).\n01 W-CAND PIC X(8).\n01 W-END PIC X(8).\n01 W-FROM PIC X(8)."
    code = (
        "M1.\n    EXEC SQL SELECT PNAME INTO :W-MID FROM PGMS END-EXEC\n    MOVE W-MID TO W-PGM\n    CALL W-PGM\n    CALL 'SUBP' USING W-REF\n    CALL W-REF\n    MOVE 'ONE' TO W-CAND\n    MOVE 'TWO' TO W-CAND\n"
        "    CALL W-CAND\n    MOVE W-FROM TO W-END\n    CALL W-END\n    CALL W-NONE\n    CALL LK-P\n    STOP RUN."
    )
    facts = parsed(spark, ("D", program(working + "\n    COPY GONE.", code, linkage="01 LK-P PIC X(8).").replace("PROCEDURE DIVISION.", "PROCEDURE DIVISION USING LK-P.")))
    calls = {r.operand: r for r in views.dynamic_calls(facts).collect()}
    assert {k: v.outcome for k, v in calls.items()} == {"W-PGM": "artifact", "W-REF": "called-program", "W-CAND": "candidates", "W-END": "dead-end", "W-NONE": "chain-broken", "LK-P": "caller"}
    assert calls["W-END"].dead_ends == ["W-FROM"] and calls["W-NONE"].provisional and calls["W-NONE"].missing_members == ["GONE"] and not calls["W-CAND"].variable
    got = {r.operand: r for r in views.call_sources(facts).collect()}
    assert set(got) == {"W-PGM", "W-REF", "LK-P"}
    assert (got["W-PGM"].kind, got["W-PGM"].run, got["W-PGM"].start) == ("db2-table", "SELECT DISTINCT PNAME FROM PGMS", None) and got["W-PGM"].route[0].startswith("W-MID -> W-PGM @")
    assert (got["W-REF"].kind, got["W-REF"].maybe, got["W-REF"].artifact) == ("called-program", True, "SUBP") and got["LK-P"].kind == "caller"
    plan = views.fetch_plan(facts, with_candidates=True).where("status = 'planned' and kind = 'program'")
    assert {r.name for r in plan.collect()} >= {"ONE", "TWO"} and {r.name for r in views.candidate_requests(facts).collect()} == {"ONE", "TWO"}


def test_run_conditions(spark):
    rows = [
        ("J", 3, 1, "EQ", 0, "if", False), ("J", 4, 1, "EQ", 0, "if", True), ("J", 5, 1, "EQ", 0, "if", False), ("J", 5, 2, "EQ", 0, "if", True), ("J", 6, None, "LT", 4, "cond", False), ("J", 7, None, "LT", 9, "cond", False),
        ("J", 8, None, "GE", 8, "if", False), ("K", 2, None, "EQ", 0, "even", False), ("K", 3, None, "EQ", 0, "only", False), ("K", 4, 9, "LT", 0, "cond", False), ("L", 2, None, "EQ", 0, "only", False),
    ]
    conds = spark.createDataFrame(rows, "job string, step int, tested int, operator string, value int, kind string, negated boolean")
    codes = spark.createDataFrame([("J", 1, 0, False), ("J", 2, 8, False), ("K", 1, None, True), ("L", 1, 0, False)], "job string, step int, code int, abended boolean")
    got = {(r.job, r.step): r.runs for r in jobs.runs(conds, codes).collect()}
    assert got == {("J", 3): True, ("J", 4): False, ("J", 5): True, ("J", 6): False, ("J", 7): True, ("J", 8): True, ("K", 2): True, ("K", 3): True, ("K", 4): False, ("L", 2): False}


def test_graph_names_hold_across_programs_only_where_proven(spark):
    two = [("RATES", samples.RATES), ("OTHER", samples.RATES.replace("PROGRAM-ID. RATES", "PROGRAM-ID. OTHER"))]
    nodes, edges = views.corpus_graph(parsed(spark, *two, members=list(samples.MEMBERS.items())))
    kinds = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["program"] == 2 and kinds["copybook"] == 1 and kinds["column"] == 3 and set(kinds) == {"program", "field", "copybook", "column", "event", "endpoint"}
    assert nodes.where("node like 'field:%/ACC-BAL'").count() == 2 and edges.where("edge = 'has' and a = 'db2-table:ACCOUNT'").count() == 2


def test_byte_utilities(spark):
    df = spark.createDataFrame([("ABCDEF",), ("abc",)], "rec string")
    assert [r.rec for r in records.generate(df, "rec", [(3, 4, 1), (2, "xy", 3), (1, 1, 6)], 7).collect()] == ["DExy A ", "  xy a "]
    assert [r.rec for r in records.repro(df, "rec", (1, 2), "AB", "AB").collect()] == ["ABCDEF"] and records.repro(df, "rec").count() == 2
    nums = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = records.numbered(nums, [F.col("x").desc()]).collect()
    assert len(got) == 1000 and all(r.position == 1000 - r.x for r in got)
    assert records.numbered(nums.where("false"), [F.col("x")]).count() == 0
    asks = spark.createDataFrame([("a", 5), ("a", 9), ("a", None), ("b", 1)], "k string, at long")
    file = spark.createDataFrame([("a", 5), ("a", 7), ("c", 1)], "k string, id long")
    assert {(r.k, r["at"], r.n) for r in records.start_read(asks, file, ["k"], "at", "id", "n").where("at is not null").collect()} == {("a", 5, 5), ("a", 9, None), ("b", 1, None)}
    assert {(r.k, r["at"], r.n) for r in records.start_read(asks, file, ["k"], "at", "id", "n", previous=True).where("at is not null").collect()} == {("a", 5, 5), ("a", 9, 7), ("b", 1, None)}


def test_ordered_fold_holds_one_record_at_a_time(spark):
    n = 60_000
    x = F.when(F.col("id") % 2 == 0, F.lit(D("900.05"))).otherwise(F.lit(D("-900.05"))).cast("decimal(9,2)")
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("i"), x.alias("x"))
    (r,) = fold.safe_total(df, ["k"], ["i"], "x", "total", "S9(3)V9").collect()
    assert (r.k, r.total) == ("hot", D("0.0"))


def test_tables_of_groups_lie_by_their_first_occurrence(spark):
    working = """01 REC.
    02 HEAD PIC X.
    02 OUTER OCCURS 3.
       03 A1 PIC XX.
       03 INNER OCCURS 2.
          04 B1 PIC X(4) OCCURS 5.
          04 B2 PIC X.
       03 A2 PIC X(3).
    02 LAST1 PIC X."""
    facts = parsed(spark, ("CASE1", program(working, "M1.\n    STOP RUN.")))
    got = {r.name: (r.start, r.length, r.occurs, r.record_size) for r in views.record_layout(facts).collect()}
    assert got == {"HEAD": (1, 1, 1, 143), "A1": (2, 2, 1, 143), "B1": (4, 20, 5, 143), "B2": (24, 1, 1, 143), "A2": (46, 3, 1, 143), "LAST1": (143, 1, 1, 143)}


def test_every_index_of_a_loop_is_assigned_and_tested(spark):
    working = "01 I PIC 99.\n01 J PIC 99.\n01 K PIC 99.\n01 N PIC 99."
    code = "M1.\n    DISPLAY N\n    PERFORM P2 VARYING I FROM 1 BY 1 UNTIL I > 3\n        AFTER J FROM K BY 2 UNTIL J > 9\n    STOP RUN.\nP2.\n    ADD 1 TO N."
    facts = parsed(spark, ("CASE1", program(working, code)))
    conditions = estate.fact_table(facts, "condition").collect()
    assert [(r.text, r.modelled) for r in conditions] == [("I > 3", True), ("J > 9", True)]
    got = {(r.target, r.literal, r.expr) for r in estate.fact_table(facts, "assignment").where("verb = 'PERFORM'").collect()}
    assert {(t, lit) for t, lit, _ in got} == {("I", "1"), ("I", None), ("J", None)} and len(got) == 4
    assert {r.item: r.status for r in views.constants(facts).collect()} == {"I": "runtime", "J": "runtime", "K": "never-assigned", "N": "runtime"}
    steps = {(r.source, r.target) for r in views.business_steps(facts).collect()}
    first = next(r.line for r in estate.fact_table(facts, "event").collect() if r.verb == "DISPLAY")
    assert steps == {(0, first), (first, None)}  # a program that begins by crossing has a first step
