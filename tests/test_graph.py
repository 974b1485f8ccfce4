"""Graph operators against plain walks, and the flow of small programs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyframe.operators import graph
from tallyframe.operators.settle import settled
from tallyframe.plans import estate_flow, views
from tallyframe.sources import estate


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    seen = {}
    for n in {x for e in edges for x in e}:
        todo, got = [n], set()
        while todo:
            for m in out[todo.pop()]:
                if m not in got:
                    got.add(m)
                    todo.append(m)
        seen[n] = got
    return seen


def test_components_of_a_long_chain_and_of_nothing(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "x"), ("z", "y"), ("y", "z")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x", "y"} and got["n120"] == "n000" and got["z"] == "y"
    assert graph.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_cycles_are_strong_components(spark):
    rng = random.Random(6)
    rows = [(g, rng.randrange(14), rng.randrange(14)) for g in ("p", "q", "r") for _ in range(17)] + [("s", i, i + 1) for i in range(9)] + [("t", 1, 1), ("t", 1, 2), ("t", 2, 1)]
    rows += [("u", i, (i + 1) % 40) for i in range(40)] + [("v", i, (i + 1) % 30) for i in range(30)] + [("v", 7, 50), ("v", 50, 50), ("v", 50, 51), ("v", 12, 12), ("w", 3, 3)]
    want = set()
    for g in {r[0] for r in rows}:
        to = reach([r[1:] for r in rows if r[0] == g])
        for n in to:
            if n in to[n]:
                want.add((g, n, min(m for m in to[n] if n in to[m])))
    got = graph.cycles(spark.createDataFrame(rows, "g string, a int, b int"), ["g"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert graph.cycles(spark.createDataFrame([], "g string, a int, b int"), ["g"]).collect() == []


def plain_must_and_may(edges, start):
    """(must, may) sets of (guard, negated) by iteration over all edges."""
    must, may = {start: frozenset()}, {start: frozenset()}
    changed = True
    while changed:
        changed = False
        for a, b, g, neg in edges:
            if a in must:
                add = {(g, neg)} if g is not None else set()
                m, y = (must[a] - ({(g, not neg)} if add else set())) | add, may[a] | add
                nm, ny = (must[b] & m, may[b] | y) if b in must else (m, y)
                if b not in must or nm != must[b] or ny != may[b]:
                    must[b], may[b], changed = frozenset(nm), frozenset(ny), True
    return must, may


def test_conditions_match_a_plain_fixpoint(spark):
    """Random graphs with more guards than one word holds, rings that nothing enters, several starts."""
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(3):
        edges = [(rng.randrange(12), rng.randrange(12), *rng.choice(((None, False), (rng.randrange(70), rng.random() < 0.5)))) for _ in range(20)]
        edges += [(50, 51, None, False), (51, 50, None, False), (0, 1, 40, False)]
        rows += [(g, *e) for e in edges]
        for start in (0, 3):
            if any(start in e[:2] for e in edges):
                want[g, start] = plain_must_and_may(edges, start)
    df = spark.createDataFrame(rows, "g int, a int, b int, guard int, negated boolean").distinct()
    starts = spark.createDataFrame([(g, s) for g, s in want], "g int, node int")
    found = defaultdict(lambda: (set(), set()))
    for r in graph.must_and_may(df, ["g"], starts).collect():
        for bit in range(62):
            for k, word in enumerate((r.must, r.may)):
                if word >> bit & 1:
                    found[r.g, r.origin, r.node][k].add((r.word * 31 + bit // 2, bool(bit % 2)))
        found[r.g, r.origin, r.node]
    assert {k: tuple(map(frozenset, v)) for k, v in found.items()} == {(g, s, n): (m[n], y[n]) for (g, s), (m, y) in want.items() for n in m}


NEST = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. NEST.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-A PIC 9.
       01  WS-B PIC 9.
       01  WS-C PIC 9.
       PROCEDURE DIVISION.
       A-MAIN.
           ACCEPT WS-A
           MOVE WS-A TO WS-B
           PERFORM B-PASS
           DISPLAY WS-B
           MOVE 1 TO WS-B
           PERFORM B-PASS
           DISPLAY WS-C
           PERFORM D-MAY
           DISPLAY WS-A
           STOP RUN.
       B-PASS.
           PERFORM C-COPY.
       C-COPY.
           MOVE WS-B TO WS-C.
       D-MAY.
           IF WS-C = 3
               DISPLAY WS-C
           END-IF.
"""


def test_what_is_performed_returns_to_its_caller(spark):
    facts = settled(estate.parse_estate(spark.createDataFrame([("NEST", NEST)], "name string, text string")))
    line = {r.text: r.line for r in estate.fact_table(facts, "statement").where("kind = 'DISPLAY' and parent_id is null").collect()}
    got = {(r.line, r.field): r.origin for r in estate_flow.origins(facts).collect()}
    # WS-B passes what is performed unchanged; the constant does not come back to the first DISPLAY; WS-C may hold either copy
    assert got[line["DISPLAY WS-B"], "WS-B"] == "GET.CONSOLE.SYSIN" and got[line["DISPLAY WS-C"], "WS-C"] == "GET.CONSOLE.SYSIN"
    steps = {(r.source, r.target): list(r.rule) for r in estate_flow.business_steps(facts).collect()}
    inner = next(r.line for r in estate.fact_table(facts, "statement").where("kind = 'DISPLAY' and parent_id is not null").collect())
    assert steps[line["DISPLAY WS-C"], inner] == ["WS-C = 3"] and steps[line["DISPLAY WS-C"], line["DISPLAY WS-A"]] == []
    assert steps[inner, line["DISPLAY WS-A"]] == [] and steps[line["DISPLAY WS-A"], None] == [] and len(steps) == 7
    assert views.perform_cycles(facts).collect() == [] and estate_flow.call_cycles(facts).collect() == []
    none = facts.where("false")
    assert estate_flow.event_conditions(none).collect() == [] and estate_flow.origins(none).collect() == []
