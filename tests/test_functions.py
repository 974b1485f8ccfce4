"""Storing, expressions, conditions and pictures: columns against an integer model, and parsing."""

import random
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import values as V
from tallyframe.functions.language import Assign, Effect, NotModelled, parse_condition, parse_expression, parse_verb, show
from tallyframe.functions.picture import initial_value, parse_picture, store_value
from tallyframe.operators import fold, records
from tallyframe.operators.rowprogram import RowProgram


def model(units: int, scale: int, p, rounded: bool) -> D:
    """Storing units * 10**-scale in p, on integers."""
    drop = scale - p.scale
    sign, n = (-1 if units < 0 else 1), abs(units)
    if drop > 0:
        n = (n + 5 * 10 ** (drop - 1)) // 10**drop if rounded else n // 10**drop
    else:
        n *= 10**-drop
    n %= 10**p.digits
    return D(sign * n if p.signed else n).scaleb(-p.scale)


@pytest.mark.parametrize("pic", ["9(3)V99", "S9(5)", "S9(2)V9(4)", "9(7)V9", "S99", "9(3)PPP", "V99", "SV9(4)"])
@pytest.mark.parametrize("rounded", [False, True])
def test_store_equals_the_integer_model(spark, pic, rounded):
    rng, p = random.Random(pic), parse_picture(pic)
    units = [rng.randrange(-(10**11), 10**11) for _ in range(1500)] + [0, 1, -1, 5, -5, 49, 50, 51, -50, 10**11 - 1]
    df = spark.createDataFrame([(i, D(u).scaleb(-4)) for i, u in enumerate(units)], "i int, x decimal(18,4)")
    got = {r.i: r.y for r in df.select("i", V.store(F.col("x"), p, rounded).alias("y")).collect()}
    for i, u in enumerate(units):
        want = model(u, 4, p, rounded)
        assert got[i] == want, (pic, u)
        assert store_value(D(u).scaleb(-4), p, rounded) == want


@given(st.integers(-(10**12), 10**12), st.integers(1, 10**6), st.booleans())
@settings(max_examples=300, deadline=None)
def test_store_value_is_idempotent(u, d, rounded):
    for pic in ("S9(4)V99", "9(3)", "9(2)PP"):
        p = parse_picture(pic)
        once = store_value(D(u).scaleb(-3), p, rounded)
        assert store_value(once, p) == once


def test_division_cuts(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-(10**12), 10**12), rng.choice([-1, 1]) * rng.randrange(1, 10**8)) for _ in range(2000)] + [(2, 3), (-2, 3), (1, 7)]
    df = spark.createDataFrame([(D(a).scaleb(-4), D(b).scaleb(-2)) for a, b in pairs], "a decimal(18,4), b decimal(18,2)")
    for (a, b), r in zip(pairs, df.select(V.divide(F.col("a"), F.col("b")).alias("q"), V.quotient(F.col("a"), F.col("b"), 2).alias("s")).collect()):
        n = abs(a) * 10**16 // abs(b)
        assert int(r.q.scaleb(18)) == (n if (a < 0) == (b < 0) else -n)
        m = abs(a) // abs(b)
        assert int(r.s.scaleb(2)) == (m if (a < 0) == (b < 0) else -m)


def test_compat_keeps_high_digits(spark):
    df = spark.createDataFrame([(D("12.34"),)], "x decimal(4,2)")
    assert df.select(V.store(F.col("x"), parse_picture("V99"))).first()[0] == D("0.34")
    assert df.select(V.store(F.col("x"), parse_picture("V99"), compat=True)).first()[0] == D("12.34")
    assert store_value(D("12.34"), parse_picture("V99"), compat=True) == D("12.34")


@pytest.mark.parametrize(
    "pic,usage,size", [("S9(7)V99", "DISPLAY", 9), ("S9(7)V99", "COMP-3", 5), ("S9(4)", "COMP", 2), ("S9(9)", "BINARY", 4), ("S9(18)", "COMP-5", 8), ("X(8)", "DISPLAY", 8), (None, "COMP-1", 4), (None, "COMP-2", 8)]
)
def test_sizes(pic, usage, size):
    assert parse_picture(pic, usage).bytes() == size


def test_pictures():
    assert parse_picture("S9(4)").bytes(sign_separate=True) == 5
    assert [parse_picture(p).category for p in ("9(3)", "ZZ9.99", "A(3)", "X", "XX/XX", None)] == ["numeric", "numeric-edited", "alphabetic", "alphanumeric", "alphanumeric-edited", "group"]
    assert (parse_picture("VPP99").scale, parse_picture("9PPP").scale, parse_picture("9PPP").spark_type) == (4, -3, "decimal(4,0)")
    assert initial_value(parse_picture("V9(8)"), "0.00000001") == D("0.00000001") and initial_value(parse_picture("X(3)"), "'ab'") == "ab" and initial_value(parse_picture("9"), "ZERO") == 0


@pytest.mark.parametrize(
    "text,tree",
    [
        ("A = 1 OR 2", "(A = 1 OR A = 2)"), ("A > B AND < C", "(A > B AND A < C)"), ("NOT (A = 1 AND B = 2)", "NOT ((A = 1 AND B = 2))"), ("A IS NOT NUMERIC", "NOT (A IS NUMERIC)"), ("A NOT = 1 AND 2", "(A <> 1 AND A <> 2)"),
        ("A GREATER THAN OR EQUAL TO 5", "A >= 5"), ("A + B * 2 > (C - 1) / 2", "(A + (B * 2)) > ((C - 1) / 2)"), ("X(1:3) = 'AND'", "X(1:3) = 'AND'"), ("T(I + 1) < 2 ** 3 ** 2", "T((I + 1)) < (2 ** (3 ** 2))"),
    ],
)
def test_conditions(text, tree):
    assert show(parse_condition(text)) == tree


def test_unreadable_conditions_are_raw():
    for text in ("FUNCTION LENGTH(A) > 3", "A =", "A B C", "X = HIGH-VALUES"):
        assert parse_condition(text)[0] == "raw"
    with pytest.raises(NotModelled):
        parse_expression("1 +")


@pytest.mark.parametrize(
    "text,want",
    [
        ("MOVE 'A TO B' TO X Y", [("X", "'A TO B'"), ("Y", "'A TO B'")]), ("ADD 1 A TO T ROUNDED", [("T", "((T + 1) + A)")]), ("ADD A TO B GIVING C", [("C", "(A + B)")]), ("SUBTRACT A B FROM T", [("T", "(T - (A + B))")]),
        ("DIVIDE A INTO B GIVING Q REMAINDER R", [("Q", "(B / A)"), ("R", "(B - (Q * A))")]), ("DIVIDE 2 INTO T", [("T", "(T / 2)")]), ("SET I UP BY 2", [("I", "(I + 2)")]), ("SET ON1 TO TRUE", [("F", "'Y'")]),
        ("COMPUTE X Y = A - -1", [("X", "(A - -1)"), ("Y", "(A - -1)")]), ("INITIALIZE N T", [("N", "0"), ("T", "''")]),
    ],
)
def test_verbs(text, want):
    got = parse_verb(text, {"ON1": ("F", ("str", "Y"))}, {"N": parse_picture("9"), "T": parse_picture("X(3)")})
    assert [(a.target[1], show(a.expr)) for a in got] == want and all(isinstance(a, Assign) for a in got)


def test_effects_keep_dependencies():
    e = parse_verb("STRING A DELIMITED BY SIZE B DELIMITED BY ' ' INTO C WITH POINTER P")[0]
    assert isinstance(e, Effect) and e.reads == ["A", "B"] and e.writes == ["C", "P"]


def test_row_program_order_and_refusals(spark):
    df = spark.createDataFrame([(D(5), "ab  ")], "n decimal(3,0), t string")
    fields = {"N": "9(3)", "T": "X(4)", "M": "9(3)"}
    out = RowProgram(fields, ["ADD 1 TO N", "COMPUTE M = N * 2", ("IF", "T = 'ab' AND N = 6", ["MOVE 'yes' TO T", "MOVE 0 TO N"], [])]).apply(df).first()
    assert (out.n, out.m, out.t) == (0, 12, "yes ")
    with pytest.raises(NotModelled):
        RowProgram(fields, ["INSPECT T REPLACING ALL 'a' BY 'b'"]).apply(df)
    with pytest.raises(NotModelled):
        RowProgram(fields, ["COMPUTE N = T + 1"]).apply(df)


# folds


@pytest.mark.parametrize("pic,low", [("S9(2)", -60), ("S9(3)V9", -500), ("9(3)", 0), ("9(2)", -40)])
def test_safe_total_equals_the_fold(spark, pic, low):
    rng, p = random.Random(pic), parse_picture(pic)
    rows = [(k, i, D(rng.randrange(low, 90)).scaleb(-1)) for k in range(40) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k int, i int, x decimal(6,1)")
    got = {r.k: r.acc for r in fold.safe_total(df, ["k"], ["i"], "x", "acc", pic).collect()}
    for k in range(40):
        acc = D(0)
        for _, _, x in sorted(r for r in rows if r[0] == k):
            acc = store_value(acc + x, p)
        assert got[k] == acc


def test_layout_round_trip(spark):
    layout = records.Layout([("ID", "X(4)"), ("AMT", "S9(5)V99"), ("QTY", "9(3)")])
    rows = [("ab", D("-12.34"), D(7)), ("", D("0.00"), D(0)), ("abcdef", D("99999.99"), D(999))]
    df = spark.createDataFrame(rows, "id string, amt decimal(7,2), qty decimal(3,0)")
    text = layout.write(df, "rec").select("rec")
    assert [r.rec for r in text.collect()] == ["ab  000123t007", "    0000000000", "abcd9999999999"]
    assert [(r.id.rstrip(), r.amt, r.qty) for r in layout.read(text, "rec").collect()] == [("ab", D("-12.34"), 7), ("", 0, 0), ("abcd", D("99999.99"), 999)]
    assert records.build_lineage([(5, 2), "xy", (1, 4)]) == [(1, 2, 5), (3, 2, None), (5, 4, 1)]
