"""Driver queries over the business tables: each applies one operator and has an independent SQL statement of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import values as V
from ..functions.picture import parse_picture
from ..operators import fold, records
from ..operators.rowprogram import RowProgram, as_field
from ..operators.settle import settled
from ..sources import estate
from . import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(df: DataFrame, keep: list, fields: dict, statements: list, conditions: dict | None = None, out: list | None = None) -> DataFrame:
    """keep: columns that pass through. Returns them and the fields."""
    p = RowProgram(fields, statements, conditions)
    names = out or [n.lower().replace("-", "_") for n in fields]
    return p.apply(df).select(*keep, *names)


# reading loops as aggregations


@query(
    "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) % 100000000000 AS DECIMAL(13,2)) AS ws_total FROM lineitem GROUP BY 1"
)
def control_total_by_flag(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", as_field(F.col("l_extendedprice"), "9(7)V99").alias("amt"))
    return fold.algebraic(df, ["l_returnflag"], [fold.Add("ws_total", "9(11)V99", F.col("amt"))])


@query("SELECT l_returnflag, CAST(COUNT(*) % 1000 AS DECIMAL(3,0)) AS ws_count FROM lineitem GROUP BY 1")
def record_count_truncated(spark, sf_dir):
    return fold.algebraic(table(spark, sf_dir, "lineitem").select("l_returnflag"), ["l_returnflag"], [fold.Add("ws_count", "9(3)", V.decimal_lit(1))])


@query(
    "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_totalprice > 100000 THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE 0 END) % 10000000000 AS DECIMAL(12,2)) AS big_total, "
    "CAST(SUM(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) % 10000000 AS DECIMAL(7,0)) AS big_count FROM orders GROUP BY 1"
)
def conditional_totals(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", as_field(F.col("o_totalprice"), "9(7)V99").alias("amt"))
    big = F.col("amt") > 100000
    return fold.algebraic(df, ["o_orderstatus"], [fold.Add("big_total", "9(10)V99", F.col("amt"), when=big), fold.Add("big_count", "9(7)", V.decimal_lit(1), when=big)])


@query(
    "SELECT o_custkey, CAST(arg_max(CAST(o_totalprice AS DECIMAL(15,2)), o_orderkey) % 10000000 AS DECIMAL(9,2)) AS last_amt, "
    "CAST(MAX(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(9,2)) AS top_amt FROM orders GROUP BY 1"
)
def last_and_greatest(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", as_field(F.col("o_totalprice"), "9(7)V99").alias("amt"))
    return fold.algebraic(df, ["o_custkey"], [fold.Last("last_amt", "9(7)V99", F.col("amt"), order="o_orderkey"), fold.Greatest("top_amt", "9(7)V99", F.col("amt"))])


SIGNED_FOLD = """
WITH RECURSIVE s AS (
  SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DECIMAL(15,2)) AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer
), r AS (
  SELECT c_nationkey, n, CAST(x % 10000 AS DECIMAL(15,2)) AS acc FROM s WHERE n = 1
  UNION ALL
  SELECT r.c_nationkey, s.n, CAST((r.acc + s.x) % 10000 AS DECIMAL(15,2)) FROM r JOIN s ON s.c_nationkey = r.c_nationkey AND s.n = r.n + 1
)
SELECT c_nationkey, CAST(arg_max(acc, n) AS DECIMAL(6,2)) AS ws_balance FROM r GROUP BY 1
"""


@query(SIGNED_FOLD)
def ordered_fold_signed(spark, sf_dir):
    """Mixed signs with overflow: the shortcut's conditions fail for these groups and the fold runs in order."""
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("x"))
    return fold.safe_total(df, ["c_nationkey"], ["c_custkey"], "x", "ws_balance", "S9(4)V99")


@query(
    "SELECT user_id, event_id, CAST(COALESCE(SUM(CAST(value AS DECIMAL(15,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(11,2)) AS before_read FROM events"
)
def running_trace(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").cast("decimal(15,2)").alias("x"))
    return fold.trace(df, ["user_id"], ["ts", "event_id"], "x", "before_read", "9(9)V99").select("user_id", "event_id", "before_read")


# storing


@query(
    "SELECT c_custkey, CAST(sign(x) * (abs(x) // 1000) AS DECIMAL(5,0)) AS cut, CAST(sign(x) * ((abs(x) + 500) // 1000) AS DECIMAL(5,0)) AS near, "
    "CAST(abs(x) / 100 AS DECIMAL(6,2)) AS unsigned, CAST(CAST(sign(x) * (abs(x) % 10000) AS DECIMAL(15,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,2)) AS low FROM "
    "(SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(15,2)) * 100 AS BIGINT) AS x FROM customer)"
)
def store_rules(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("x"))
    tenth = F.col("x") * V.decimal_lit("0.1")
    return df.select(
        "c_custkey",
        V.store(tenth, parse_picture("S9(5)")).alias("cut"),
        V.store(tenth, parse_picture("S9(5)"), rounded=True).alias("near"),
        V.store(F.col("x"), parse_picture("9(4)V99")).alias("unsigned"),
        V.store(F.col("x"), parse_picture("S99V99")).alias("low"),
    )


@query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 100 AS BIGINT) // 100000 * 1000 AS thousands FROM part")
def store_scaled_positions(spark, sf_dir):
    """PIC 9(3)PPP keeps whole thousands."""
    return table(spark, sf_dir, "part").select("p_partkey", V.store(F.col("p_retailprice").cast("decimal(15,2)"), parse_picture("9(3)PPP")).cast("bigint").alias("thousands"))


@query("SELECT c_custkey, rpad(c_name, 10, ' ') AS short_name, rpad(c_mktsegment, 20, ' ') AS long_seg FROM customer")
def move_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("in_name"), F.col("c_mktsegment").alias("in_seg"))
    return run(df, ["c_custkey"], {"IN-NAME": "X(40)", "IN-SEG": "X(20)", "SHORT-NAME": "X(10)", "LONG-SEG": "X(20)"}, ["MOVE IN-NAME TO SHORT-NAME", "MOVE IN-SEG TO LONG-SEG"], out=["short_name", "long_seg"])


@query("SELECT p_partkey, rpad(p_brand, 8, ' ') AS a, rpad(p_brand, 3, ' ') AS b, rpad(p_brand, 15, ' ') AS c FROM part")
def move_fanout(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return run(df, ["p_partkey"], {"BRAND": "X(10)", "A": "X(8)", "B": "X(3)", "C": "X(15)"}, ["MOVE BRAND TO A B C"], out=["a", "b", "c"])


# arithmetic verbs

LINE = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS HUGEINT) AS p, CAST(CAST(l_discount AS DECIMAL(15,2)) * 100 AS HUGEINT) AS d, CAST(CAST(l_tax AS DECIMAL(15,2)) * 100 AS HUGEINT) AS t, CAST(CAST(l_quantity AS DECIMAL(15,2)) AS HUGEINT) AS q"


def lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_orderkey", "l_linenumber",
        as_field(F.col("l_extendedprice"), "9(7)V99").alias("price"), as_field(F.col("l_discount"), "V99").alias("disc"),
        as_field(F.col("l_tax"), "V99").alias("tax"), as_field(F.col("l_quantity"), "9(3)").alias("qty"),
    )


LINE_FIELDS = {"PRICE": "9(7)V99", "DISC": "V99", "TAX": "V99", "QTY": "9(3)"}


@query(
    f"SELECT l_orderkey, l_linenumber, CAST(CAST(p * (100 - d) * (100 + t) // 10000 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(11,2)) AS net, "
    f"CAST(CAST((p * (100 - d) * (100 + t) + 5000) // 10000 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(11,2)) AS net_r FROM (SELECT l_orderkey, l_linenumber, {LINE} FROM lineitem)"
)
def compute_discounted_price(spark, sf_dir):
    fields = LINE_FIELDS | {"NET": "9(9)V99", "NET-R": "9(9)V99"}
    return run(lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], fields, ["COMPUTE NET NET-R ROUNDED = PRICE * (1 - DISC) * (1 + TAX)"], out=["net", "net_r"])


@query(
    f"SELECT l_orderkey, l_linenumber, CAST(CAST((p + d + t) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(11,2)) AS s, CAST(CAST(p - d - t AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(11,2)) AS m, "
    f"CAST(CAST(p * q AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(11,2)) AS x, CAST((q + 7) * 2 - 3 AS DECIMAL(4,0)) AS n FROM (SELECT l_orderkey, l_linenumber, {LINE} FROM lineitem)"
)
def add_subtract_multiply(spark, sf_dir):
    fields = LINE_FIELDS | {"S": "9(9)V99", "M": "S9(9)V99", "X": "9(9)V99", "N": "9(4)"}
    code = ["ADD PRICE DISC TO TAX GIVING S", "SUBTRACT DISC TAX FROM PRICE GIVING M", "MULTIPLY PRICE BY QTY GIVING X", "MOVE QTY TO N", "ADD 7 TO N", "MULTIPLY 2 BY N", "SUBTRACT 3 FROM N"]
    return run(lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], fields, code, out=["s", "m", "x", "n"])


@query(
    f"SELECT l_orderkey, l_linenumber, CAST(CAST(p // q AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(9,2)) AS unit, CAST(CAST((p * 10 // q + 5) // 10 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(9,2)) AS unit_r, "
    f"CAST(p // 700 AS DECIMAL(7,0)) AS weeks, CAST(CAST(p - (p // 700) * 700 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(7,2)) AS rest FROM (SELECT l_orderkey, l_linenumber, {LINE} FROM lineitem)"
)
def divide_and_remainder(spark, sf_dir):
    fields = LINE_FIELDS | {"UNIT": "9(7)V99", "UNIT-R": "9(7)V99", "WEEKS": "9(7)", "REST": "9(5)V99"}
    code = ["DIVIDE PRICE BY QTY GIVING UNIT", "DIVIDE QTY INTO PRICE GIVING UNIT-R ROUNDED", "DIVIDE PRICE BY 7 GIVING WEEKS REMAINDER REST"]
    return run(lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], fields, code, out=["unit", "unit_r", "weeks", "rest"])


@query("SELECT p_partkey, CAST(p_size * p_size * p_size - 2 * p_size AS DECIMAL(9,0)) AS cube, CAST((p_size + 1) * (p_size + 1) AS DECIMAL(6,0)) AS square FROM part")
def power_literal(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("decimal(3,0)").alias("n"))
    return run(df, ["p_partkey"], {"N": "9(3)", "CUBE": "S9(9)", "SQUARE": "9(6)"}, ["COMPUTE CUBE = N ** 3 - 2 * N", "COMPUTE SQUARE = (N + 1) ** 2"], out=["cube", "square"])


@query("SELECT l_orderkey, l_linenumber, p * q >= 100000000 AS size_error, CAST(CAST((p * q) % 100000000 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS total FROM (SELECT l_orderkey, l_linenumber, " + LINE + " FROM lineitem)")
def size_error(spark, sf_dir):
    """Extension: ON SIZE ERROR as a predicate."""
    x = F.col("price") * F.col("qty")
    p = parse_picture("9(6)V99")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", V.overflows(x, p).alias("size_error"), V.store(x, p).alias("total"))


@query("SELECT c_custkey, rpad('', 5, ' ') AS t, CAST(0 AS DECIMAL(4,0)) AS n, CAST(c_nationkey + 3 AS DECIMAL(3,0)) AS rise, CAST(abs(c_nationkey - 2) AS DECIMAL(3,0)) AS fall, 'Y' AS flag FROM customer")
def set_and_initialize(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("decimal(3,0)").alias("rise"), F.col("c_nationkey").cast("decimal(3,0)").alias("fall"), F.lit("junk ").alias("t"), F.lit(7).cast("decimal(4,0)").alias("n"), F.lit("N").alias("flag"))
    fields = {"RISE": "9(3)", "FALL": "9(3)", "T": "X(5)", "N": "9(4)", "FLAG": "X"}
    conditions = {"IS-ON": ("FLAG", ["Y", "J"], [])}
    code = ["SET RISE UP BY 3", "SET FALL DOWN BY 2", "INITIALIZE T N", "SET IS-ON TO TRUE"]
    return run(df, ["c_custkey"], fields, code, conditions, ["t", "n", "rise", "fall", "flag"])


@query("SELECT p_partkey, substr(p_name, 1, 2) || rpad(substr(p_brand, 1, 3), 3, ' ') || substr(rpad(p_name, 12, ' '), 6, 7) AS mixed FROM part")
def reference_modification(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.rpad("p_name", 12, " ").alias("mixed"), F.col("p_brand").alias("brand"))
    return run(df, ["p_partkey"], {"MIXED": "X(12)", "BRAND": "X(10)"}, ["MOVE BRAND(1:3) TO MIXED(3:3)"], out=["mixed"])


# conditions

EVENT = "event_id, event_type, user_id, CAST(value AS DECIMAL(15,2)) AS v"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.rpad("event_type", 10, " ").alias("kind"), F.col("user_id").cast("decimal(9,0)").alias("usr"), F.col("value").cast("decimal(15,2)").cast("decimal(7,2)").alias("val"), F.lit(0).cast("decimal(2,0)").alias("code"))


EVENT_FIELDS = {"KIND": "X(10)", "USR": "9(9)", "VAL": "9(5)V99", "CODE": "9(2)"}


@query(f"SELECT event_id, CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN CASE WHEN v > 100 THEN 3 ELSE 2 END WHEN 'view' THEN 4 WHEN 'click' THEN 4 ELSE 9 END AS DECIMAL(2,0)) AS code FROM (SELECT {EVENT} FROM events)")
def evaluate_dispatch(spark, sf_dir):
    code = [("EVALUATE", "KIND", [("'signup'", ["MOVE 1 TO CODE"]), ("'purchase'", [("IF", "VAL > 100", ["MOVE 3 TO CODE"], ["MOVE 2 TO CODE"])]), (["'view'", "'click'"], ["MOVE 4 TO CODE"])], ["MOVE 9 TO CODE"])]
    return run(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, code, out=["code"])


@query(f"SELECT event_id, CAST(CASE WHEN event_type = 'view' AND v BETWEEN 10 AND 50 THEN 1 WHEN v > 200 THEN 2 WHEN event_type = 'error' THEN 3 WHEN event_type <> 'click' AND v < 5 THEN 4 ELSE 0 END AS DECIMAL(2,0)) AS code FROM (SELECT {EVENT} FROM events)")
def evaluate_also_thru(spark, sf_dir):
    whens = [("'view' ALSO 10 THRU 50", ["MOVE 1 TO CODE"]), ("ANY ALSO > 200", ["MOVE 2 TO CODE"]), ("'error' ALSO ANY", ["MOVE 3 TO CODE"]), ("NOT 'click' ALSO < 5", ["MOVE 4 TO CODE"])]
    return run(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, [("EVALUATE", "KIND ALSO VAL", whens)], out=["code"])


@query(f"SELECT event_id, CAST(CASE WHEN v > 300 THEN 1 WHEN user_id < 20 AND (event_type = 'view' OR event_type = 'click') THEN 2 ELSE 3 END AS DECIMAL(2,0)) AS code FROM (SELECT {EVENT} FROM events)")
def evaluate_true(spark, sf_dir):
    whens = [("VAL > 300", ["MOVE 1 TO CODE"]), ("USR < 20 AND (KIND = 'view' OR 'click')", ["MOVE 2 TO CODE"])]
    return run(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, [("EVALUATE", "TRUE", whens, ["MOVE 3 TO CODE"])], out=["code"])


@query(f"SELECT event_id, CAST(CASE WHEN v > 100 THEN CASE WHEN event_type = 'view' THEN 11 ELSE 12 END WHEN user_id <= 50 THEN 21 ELSE 0 END AS DECIMAL(2,0)) AS code FROM (SELECT {EVENT} FROM events)")
def if_else_nested(spark, sf_dir):
    code = [("IF", "VAL > 100", [("IF", "KIND = 'view'", ["MOVE 11 TO CODE"], ["MOVE 12 TO CODE"])], [("IF", "USR NOT > 50", ["MOVE 21 TO CODE"], [])])]
    return run(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, code, out=["code"])


def flags(df, keep, fields, conds: dict, names=None):
    p = RowProgram(fields, [], names)
    from ..functions.language import parse_condition

    return df.select(*keep, *(p.compiler.condition(parse_condition(c, p.fields.conditions)).alias(k) for k, c in conds.items()))


@query(
    f"SELECT event_id, event_type IN ('view', 'click') AS is_browse, event_type = 'purchase' AS is_buy, v BETWEEN 0 AND 9.99 OR v BETWEEN 100 AND 199.99 OR v = 50 AS in_band, NOT (event_type IN ('view', 'click')) AS not_browse FROM (SELECT {EVENT} FROM events)"
)
def condition_names(spark, sf_dir):
    names = {"BROWSE": ("KIND", ["view", "click"], []), "BUY": ("KIND", ["purchase"], []), "BAND": ("VAL", ["50"], [("0", "9.99"), ("100", "199.99")])}
    return flags(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, {"is_browse": "BROWSE", "is_buy": "BUY", "in_band": "BAND", "not_browse": "NOT BROWSE"}, names)


@query(
    f"SELECT event_id, event_type = 'view' OR event_type = 'error' AS a, v > 10 AND v < 100 AS b, v > 10 AND v < 100 OR user_id = 7 AS c, NOT (v >= 50) AS d, v <> 1 AND v <> 2 AS e, v * 2 + 1 >= user_id - 3 AS f FROM (SELECT {EVENT} FROM events)"
)
def relations_and_abbreviations(spark, sf_dir):
    conds = {"a": "KIND = 'view' OR 'error'", "b": "VAL > 10 AND < 100", "c": "VAL IS GREATER THAN 10 AND LESS THAN 100 OR USR EQUAL TO 7", "d": "NOT VAL GREATER THAN OR EQUAL TO 50", "e": "VAL NOT = 1 AND 2", "f": "VAL * 2 + 1 >= USR - 3"}
    return flags(events(spark, sf_dir), ["event_id"], EVENT_FIELDS, conds)


@query(
    "SELECT c_custkey, regexp_full_match(trim(c_name), '[+-]?[0-9]+') AS num, regexp_full_match(c_mktsegment, '[A-Za-z ]*') AS alpha, regexp_full_match(c_mktsegment, '[A-Z ]*') AS upper_only, "
    "c_acctbal > 0 AS pos, c_acctbal < 0 AS neg, c_acctbal = 0 AS zero, regexp_full_match(substr(c_name, length(c_name) - 2, 3), '[0-9]+') AS tail_num FROM customer"
)
def class_and_sign_tests(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("nm"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").cast("decimal(15,2)").alias("bal"), F.expr("substring(c_name, length(c_name) - 2, 3)").alias("tail"))
    conds = {"num": "NM IS NUMERIC", "alpha": "SEG IS ALPHABETIC", "upper_only": "SEG ALPHABETIC-UPPER", "pos": "BAL POSITIVE", "neg": "BAL IS NEGATIVE", "zero": "BAL IS ZERO", "tail_num": "TAIL NUMERIC"}
    return flags(df, ["c_custkey"], {"NM": "X(30)", "SEG": "X(20)", "BAL": "S9(13)V99", "TAIL": "X(3)"}, conds)


@query("SELECT p_partkey, p_brand = 'Brand#1' AS eq, p_brand < 'Brand#3' AS lt, rpad(p_brand, 20, ' ') >= rpad(p_type, 20, ' ') AS ge FROM part")
def padded_text_compare(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.rpad("p_brand", 12, " ").alias("brand"), F.col("p_type").alias("typ"))
    return flags(df, ["p_partkey"], {"BRAND": "X(12)", "TYP": "X(30)"}, {"eq": "BRAND = 'Brand#1   '", "lt": "BRAND < 'Brand#3'", "ge": "BRAND >= TYP"})


# loops and tables


@query("SELECT p_partkey, CAST(p_size * (p_size + 1) // 2 AS DECIMAL(6,0)) AS total, CAST(p_size + 1 AS DECIMAL(3,0)) AS i FROM part")
def perform_varying_sum(spark, sf_dir):
    return records.varying(table(spark, sf_dir, "part"), F.col("p_size"), 1).select("p_partkey", F.col("total").cast("decimal(6,0)").alias("total"), F.col("i").cast("decimal(3,0)").alias("i"))


@query("SELECT n_nationkey, CAST(150 + n_nationkey AS DECIMAL(5,0)) AS total, CAST(6 AS DECIMAL(2,0)) AS i, CAST(40 AS DECIMAL(3,0)) AS fourth FROM nation")
def occurs_table_sum(spark, sf_dir):
    fields = {"TBL-AMT": ("9(3)", 5), "TOTAL": "9(5)", "I": "9(2)", "FOURTH": "9(3)", "BASE": "9(3)"}
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("decimal(3,0)").alias("base"))
    code = [("VARYING", "I", 1, 1, 5, ["COMPUTE TBL-AMT(I) = I * 10"]), "MOVE TBL-AMT(4) TO FOURTH", "ADD BASE TO TBL-AMT(2)", ("VARYING", "I", 1, 1, 5, ["ADD TBL-AMT(I) TO TOTAL"])]
    return run(df, ["n_nationkey"], fields, code, out=["total", "i", "fourth"])


@query("SELECT vec_id, CAST(COALESCE(list_position(list_transform(embedding, lambda x: CAST(x AS DOUBLE) > CAST(0.2 AS DOUBLE)), true), 0) AS INTEGER) AS first_at FROM embeddings")
def search_table(spark, sf_dir):
    """Extension: SEARCH ... WHEN as the first index that satisfies a predicate, 0 at end."""
    return table(spark, sf_dir, "embeddings").select("vec_id", records.search("embedding", lambda x: x.cast("double") > F.lit(0.2)).alias("first_at"))


# sequence


@query(
    "SELECT o_orderkey, o_custkey, o_custkey IS DISTINCT FROM lag(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) AS is_break FROM orders"
)
def control_break(spark, sf_dir):
    return records.control_break(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "is_break").select("o_orderkey", "o_custkey", "is_break")


@query(
    "SELECT nk, seq, key, name FROM (SELECT nk, key, name, row_number() OVER (PARTITION BY nk ORDER BY bal DESC, src, key) AS seq FROM ("
    "SELECT 'C' AS src, c_nationkey AS nk, c_custkey AS key, c_name AS name, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer UNION ALL SELECT 'S', s_nationkey, s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(15,2)) FROM supplier))"
)
def merge_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("C").alias("src"), F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(15,2)").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.lit("S").alias("src"), F.col("s_nationkey").alias("nk"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(15,2)").alias("bal"))
    return records.merge([c, s], ["nk"], [("bal", "D"), ("src", "A"), ("key", "A")], "seq").select("nk", "seq", "key", "name")


REC = "rpad(CAST(o_orderkey AS VARCHAR), 10, ' ') || rpad(o_orderstatus, 1, ' ') || lpad(CAST(CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS VARCHAR), 11, '0') || rpad(o_orderpriority, 15, ' ')"


def order_records(spark, sf_dir):
    layout = records.Layout([("ID", "X(10)"), ("STATUS", "X"), ("AMT", "9(9)V99"), ("PRIO", "X(15)")])
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(15,2)").alias("amt"), F.col("o_orderpriority").alias("prio"))
    return layout, layout.write(df, "rec").select("rec")


@query(f"SELECT {REC} AS rec FROM orders")
def unload_records(spark, sf_dir):
    return order_records(spark, sf_dir)[1]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(11,2)) AS amt, o_orderpriority AS prio FROM orders")
def load_records(spark, sf_dir):
    layout, df = order_records(spark, sf_dir)
    return layout.read(df, "rec").select(F.rtrim("id").alias("id"), "status", "amt", F.rtrim("prio").alias("prio"))


@query(f"SELECT substr(rec, 11, 1) || substr(rec, 1, 10) || 'X' AS rec FROM (SELECT {REC} AS rec FROM orders) WHERE substr(rec, 11, 1) = 'F' AND NOT (substr(rec, 12, 11) < '00001000000')")
def include_omit_build(spark, sf_dir):
    """INCLUDE / OMIT as filters on bytes and OUTREC BUILD as a projection of bytes."""
    df = order_records(spark, sf_dir)[1]
    kept = records.omit(records.include(df, "rec", [(11, 1, "CH", "EQ", "F")]), "rec", [(12, 11, "ZD", "LT", 1000000)])
    return records.build(kept, "rec", [(11, 1), (1, 10), "X"])


@query(f"SELECT status, CAST(SUM(CAST(substr(rec, 12, 11) AS BIGINT)) AS DECIMAL(38,0)) AS total, COUNT(*) AS n FROM (SELECT {REC} AS rec, o_orderstatus AS status FROM orders) GROUP BY 1")
def sum_fields(spark, sf_dir):
    return records.sum_fields(order_records(spark, sf_dir)[1], "rec", [("status", 11, 1)], [("total", 12, 11)])


@query("SELECT o_orderkey, c_name, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_keys(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return records.join_keys(a, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "o_custkey")


@query(f"SELECT rec, row_number() OVER (ORDER BY substr(rec, 11, 1), CAST(substr(rec, 12, 11) AS BIGINT) DESC, rec) AS position FROM (SELECT {REC} AS rec FROM orders)")
def sort_by_bytes(spark, sf_dir):
    """SORT FIELDS on byte ranges of records, with each record's place in the sorted file."""
    df = order_records(spark, sf_dir)[1]
    return records.numbered(df, records.sort_keys("rec", [(11, 1, "CH", "A"), (12, 11, "ZD", "D"), (1, 37, "CH", "A")]))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, CAST(o_totalprice AS DECIMAL(15,2)) DESC, o_orderkey) AS position FROM orders")
def sort_file(spark, sf_dir):
    """SORT ... ON ASCENDING / DESCENDING KEY of all orders: the place of each."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(15,2)").alias("p"))
    return records.numbered(df, [F.col("o_orderpriority").asc(), F.col("p").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "position")


@query(f"SELECT rec FROM (SELECT {REC} AS rec FROM orders) WHERE substr(rec, 23, 1) >= '2' AND substr(rec, 23, 1) <= '4'")
def repro_by_key(spark, sf_dir):
    """REPRO of the records whose key bytes lie in a range."""
    return records.repro(order_records(spark, sf_dir)[1], "rec", (23, 15), "2", "4")


@query(f"SELECT substr(rec, 23, 4) || '  ORD' || substr(rec, 1, 10) || '*' || substr(rec, 11, 1) || '*' AS rec FROM (SELECT {REC} AS rec FROM orders)")
def generate_records(spark, sf_dir):
    """IEBGENER with reformat cards: byte ranges and literals moved to new places."""
    return records.generate(order_records(spark, sf_dir)[1], "rec", [(10, 1, 10), (3, "ORD", 7), (4, 23, 1), (3, "***", 20), (1, 11, 21)], 22)


@query(
    "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey >= c_custkey * 7) AS next_order, "
    "(SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderkey <= c_custkey * 7) AS previous_order FROM customer"
)
def start_and_read(spark, sf_dir):
    """Extension: START at a key, then READ NEXT and READ PREVIOUS, for each customer's orders."""
    asks = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 7).alias("from_key"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    found = records.start_read(asks, orders, ["o_custkey"], "from_key", "o_orderkey", "next_order")
    return records.start_read(found, orders, ["o_custkey"], "from_key", "o_orderkey", "previous_order", previous=True).select("c_custkey", "next_order", "previous_order")


@query("SELECT o_orderkey, COALESCE(c_name, '') AS c_name, c_custkey IS NULL AS invalid_key FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def keyed_read(spark, sf_dir):
    """Extension: keyed READ with INVALID KEY as an outer join."""
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return records.keyed_read(table(spark, sf_dir, "orders"), good, [("o_custkey", "c_custkey")], {"c_name": ""}).select("o_orderkey", "c_name", "invalid_key")


# text statements


@query("SELECT c_custkey, rpad(split_part(c_name, '#', 1) || '/' || c_mktsegment, 30, ' ') AS joined, CAST(length(split_part(c_name, '#', 1)) + 1 + length(c_mktsegment) + 1 AS INTEGER) AS pointer FROM customer")
def string_statement(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return records.string_into(df, [("c_name", "#"), (F.lit("/"), None), ("c_mktsegment", None)], "joined", 30, "pointer").select("c_custkey", "joined", "pointer")


@query("SELECT c_custkey, rpad(split_part(c_name, '#', 1), 12, ' ') AS a, rpad(split_part(c_name, '#', 2), 12, ' ') AS b, CAST(least(length(c_name) - length(replace(c_name, '#', '')) + 1, 2) AS INTEGER) AS filled FROM customer")
def unstring_statement(spark, sf_dir):
    return records.unstring(table(spark, sf_dir, "customer"), "c_name", "#", [("a", 12), ("b", 12)], "filled").select("c_custkey", "a", "b", "filled")


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INTEGER) AS n_a, translate(p_name, 'abc', 'ABC') AS upper_abc, replace(p_name, 'e', '3') AS e3 FROM part")
def inspect_statement(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", records.tally("p_name", "a").alias("n_a"), records.converting("p_name", "abc", "ABC").alias("upper_abc"), records.replacing("p_name", "e", "3").alias("e3"))


@query(
    "SELECT * FROM (VALUES ('CTL-KEY', 1, 4), ('CTL-PGM-NAME', 5, 8), ('CTL-AMT', 13, 5), ('CTL-CNT', 18, 2), ('FILLER', 20, 59)) AS t(name, start, length)"
)
def record_layout(spark, sf_dir):
    """The layout view on one record."""
    pictures = (("CTL-KEY", "X(4)"), ("CTL-PGM-NAME", "X(8)"), ("CTL-AMT", "S9(7)V99 COMP-3"), ("CTL-CNT", "S9(4) COMP"), ("FILLER", "X(59)"))
    fields = "\n".join(f"           05  {name} PIC {picture}." for name, picture in pictures)
    text = f"""
       IDENTIFICATION DIVISION.
       PROGRAM-ID. CTL.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  CTL-REC.
{fields}
       PROCEDURE DIVISION.
       A-MAIN.
           STOP RUN.
"""
    facts = settled(estate.parse_estate(spark.createDataFrame([("CTL", text)], "name string, text string")))
    return views.record_layout(facts).select("name", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
