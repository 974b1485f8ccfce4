"""Driver queries over an estate of one program for each supplier, whose texts Spark writes from the table; SQL says from the same rows what the views must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.settle import settled
from ..sources import estate
from . import jobs, views

QUERIES: dict = {}
ORACLES: dict = {}

#: {k}: the supplier's key, {n}: its nation's; {a}, {b}, {c}, {d} follow from the nation.
TEXT = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. P{k}.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO DD{n}.
       DATA DIVISION.
       FILE SECTION.
       FD  IN-FILE.
       01  IN-REC.
           05  IN-KEY   PIC X({a}).
           05  IN-AMT   PIC 9({b})V99.
           05  IN-NEXT  PIC X(8).
       WORKING-STORAGE SECTION.
           COPY
               MEM{c}.
       01  WS-PGM       PIC X(8) VALUE 'P{n}'.
       01  WS-HOP       PIC X(8).
       01  WS-NEXT      PIC X(8).
       01  WS-LOST      PIC X(8).
       01  WS-COPY      PIC X(8).
       01  WS-END       PIC X VALUE 'N'.
       01  WS-TOTAL     PIC 9(9)V99.
       PROCEDURE DIVISION.
       PROCESS-MAIN.
           READ IN-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ
           PERFORM PROCESS-RECORD UNTIL WS-END = 'Y'
           DISPLAY WS-TOTAL
           CALL WS-PGM
           MOVE IN-NEXT TO WS-HOP
           MOVE WS-HOP TO WS-NEXT
           CALL WS-NEXT
           MOVE WS-LOST TO WS-COPY
           CALL WS-COPY
           STOP RUN.
       PROCESS-RECORD.
           ADD IN-AMT TO WS-TOTAL
           IF IN-AMT > {n}
               EXEC SQL
                   UPDATE T{d} SET C{n} = :WS-TOTAL
               END-EXEC
           END-IF
           READ IN-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ.
"""
MEMBERS = {f"MEM{i}": "\n".join(["       01  SHARED-REC.", *(f"           05  SH-{j}     PIC X({j + 1})." for j in range(i + 1))]) + "\n" for i in range(3)}  # MEM3 is missing
#: The same numbers in SQL.
BASE = (
    "(SELECT 'P' || s_suppkey AS program, s_nationkey AS n, CAST(s_nationkey % 7 + 1 AS INTEGER) AS a, CAST(s_nationkey % 5 + 3 AS INTEGER) AS b, CAST(s_nationkey % 4 AS INTEGER) AS c, "
    "CAST(s_nationkey % 3 AS INTEGER) AS d FROM supplier)"
)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    text = F.lit(TEXT)
    for mark, value in (("{k}", F.col("s_suppkey")), ("{n}", n), ("{a}", n % 7 + 1), ("{b}", n % 5 + 3), ("{c}", n % 4), ("{d}", n % 3)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("P"), "s_suppkey").alias("name"), text.alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame(sorted(MEMBERS.items()), "name string, text string")
    return settled(estate.parse_estate(programs(spark, sf_dir), members))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(facts(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT program, unnest(['PROCESS-MAIN', 'PROCESS-RECORD']) AS paragraph, unnest(['input-output', 'input-output']) AS role FROM {BASE}")
def corpus_paragraphs(f):
    """Paragraphs and how they cross the boundary."""
    return views.business_states(f)


@query(
    "SELECT program, 'IN-REC' AS record_name, unnest(['IN-KEY', 'IN-AMT', 'IN-NEXT']) AS name, unnest([1, 1 + a, 3 + a + b]) AS start, unnest([a, b + 2, 8]) AS length, "
    f"CAST(10 + a + b AS INTEGER) AS record_size FROM {BASE} UNION ALL "
    f"SELECT program, w, w, 1, n, n FROM (SELECT program FROM {BASE}), (VALUES ('WS-PGM', 8), ('WS-HOP', 8), ('WS-NEXT', 8), ('WS-LOST', 8), ('WS-COPY', 8), ('WS-END', 1), ('WS-TOTAL', 11)) AS v(w, n) UNION ALL "
    "SELECT program, 'SHARED-REC', 'SH-' || j, CAST(1 + j * (j + 1) // 2 AS INTEGER), CAST(j + 1 AS INTEGER), CAST((c + 1) * (c + 2) // 2 AS INTEGER) "
    f"FROM {BASE}, range(3) AS r(j) WHERE c < 3 AND j <= c"
)
def corpus_layouts(f):
    """Bytes of all records of every program."""
    numbers = [F.col(c).cast("int").alias(c) for c in ("start", "length", "record_size")]
    return views.record_layout(f).select("program", "record_name", "name", *numbers)


@query(
    f"SELECT program, unnest(['WS-PGM', 'WS-NEXT', 'WS-COPY']) AS operand, unnest(['P' || n, NULL, NULL]) AS callee, unnest(['proven', 'runtime', 'runtime']) AS resolution, "
    f"unnest([CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = n) THEN 'cobol-program' ELSE 'unresolved-program' END, 'unresolved', 'unresolved']) AS category FROM {BASE}"
)
def corpus_calls(f):
    """Targets of calls by constants, and what kind of program they name."""
    return views.calls(f).select("program", "operand", "callee", "resolution", "category")


@query(
    f"SELECT program, unnest(['WS-NEXT', 'WS-COPY']) AS operand, unnest(['artifact', 'dead-end']) AS outcome, unnest(['GET.FILE.IN-FILE', NULL]) AS named_by, unnest([CAST(2 AS INTEGER), NULL]) AS steps, "
    f"unnest(['', 'WS-LOST']) AS dead_ends, false AS provisional, true AS variable FROM {BASE}"
)
def corpus_dynamic_calls(f):
    """Outcomes of dynamic calls."""
    d = views.dynamic_calls(f)
    return d.select("program", "operand", "outcome", "named_by", F.col("steps").cast("int"), F.array_join("dead_ends", ",").alias("dead_ends"), "provisional", "variable")


@query(
    f"SELECT program, 'WS-NEXT' AS operand, 'file' AS kind, 'IN-FILE' AS artifact, false AS maybe, 'READ' AS verb, 'IN-NEXT' AS field, 2 AS steps, 'IN-NEXT>WS-HOP>WS-NEXT' AS route, 'IN-REC' AS record, "
    f"CAST(3 + a + b AS INTEGER) AS start, 8 AS length FROM {BASE}"
)
def corpus_call_sources(f):
    """Where dynamic targets come from: the route, and the bytes that hold the names."""
    d = views.call_sources(f)
    route = F.concat_ws(">", F.substring_index(F.element_at("route", 1), " ->", 1), F.transform("route", lambda x: F.regexp_extract(x, "-> (\\S+)", 1)))
    return d.select("program", "operand", "kind", "artifact", "maybe", "verb", "field", F.col("steps").cast("int"), route.alias("route"), "record", F.col("start").cast("int"), F.col("length").cast("int"))


@query(
    f"SELECT program, unnest(['file', 'db2-table', 'program', 'program', 'program', 'copybook', 'spool']) AS kind, unnest(['IN-FILE', 'T' || d, 'P' || n, 'WS-NEXT', 'WS-COPY', 'MEM' || c, 'SYSOUT']) AS name, "
    f"unnest(['input', 'output', 'output', 'output', 'output', 'input', 'output']) AS io, unnest(['DD' || n, NULL, NULL, NULL, NULL, NULL, NULL]) AS assign FROM {BASE}"
)
def corpus_artifacts(f):
    """All that the programs are related to."""
    return views.artifacts(f).where("excluded is null").select("program", "kind", "name", "io", "assign")


@query(f"SELECT program, 'MEM' || c AS member, CASE WHEN c = 3 THEN 'missing' ELSE 'found' END AS status, CAST(CASE WHEN c = 3 THEN 0 ELSE c + 2 END AS INTEGER) AS items, 0 AS paragraphs FROM {BASE}")
def corpus_members(f):
    """What each copied member gives: items and paragraphs."""
    return views.member_counts(f).select("program", "member", "status", F.col("items").cast("int"), F.col("paragraphs").cast("int"))


@query(f"SELECT program, 'T' || d AS table_name, 'C' || n AS column_name, 'WS-TOTAL' AS host_var FROM {BASE}")
def corpus_sql_columns(f):
    return estate.fact_table(f, "sql_column").select("program", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "host_var")


@query(
    f"SELECT program, unnest(['READ IN-FILE', 'MOVE ''Y'' TO WS-END', 'PERFORM PROCESS-RECORD UNTIL WS-END = ''Y''', 'DISPLAY WS-TOTAL', 'CALL WS-PGM', 'MOVE IN-NEXT TO WS-HOP', 'MOVE WS-HOP TO WS-NEXT', 'CALL WS-NEXT', "
    "'MOVE WS-LOST TO WS-COPY', 'CALL WS-COPY', 'STOP RUN', 'ADD IN-AMT TO WS-TOTAL', 'IF IN-AMT > ' || n, 'EXEC', 'READ IN-FILE', 'MOVE ''Y'' TO WS-END']) AS text, "
    "unnest([0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1]) AS nested, CAST(unnest(range(16)) AS INTEGER) AS stmt_id "
    f"FROM {BASE}"
)
def corpus_statements(f):
    """All statements, in order, and whether they stand inside another one."""
    s = estate.fact_table(f, "statement")
    text = F.when(F.col("kind") == "EXEC", "EXEC").otherwise(F.regexp_replace("text", r"^(READ \S+).*$", "$1"))
    return s.select("program", text.alias("text"), F.col("parent_id").isNotNull().cast("int").alias("nested"), "stmt_id")


@query(f"SELECT program, 'IN-AMT > ' || n AS rule, 'CREATE.DB2.T' || d AS event FROM {BASE}")
def corpus_business_rules(f):
    """The condition under which each program updates its table."""
    return views.business_rules(f).where("event like 'CREATE.DB2%'").select("program", F.array_join("rule", " AND ").alias("rule"), "event")


@query(f"SELECT program, 'guard' AS kind, unnest(['WS-END_eq_Y', 'IN-AMT_gt_' || n]) AS name FROM {BASE}")
def corpus_names(f):
    """Names of the conditions of every program."""
    return views.names(f).where("kind = 'guard'").select("program", "kind", "name")


@query(f"SELECT program, unnest(['PROCESS-MAIN', 'PROCESS-RECORD']) AS paragraph, true AS compound FROM {BASE}")
def corpus_hierarchy(f):
    """States by paragraph."""
    return views.hierarchy(f).select("program", "paragraph", "compound")


@query(f"SELECT program, 'DD' || n AS ddname, 'bound' AS status, 'PAY.N' || n AS datasets FROM {BASE}")
def corpus_bindings(f):
    """Input files of all programs with the datasets of their steps."""
    return jobs.bind(views.artifacts(f), steps(f)).select("program", "ddname", "status", F.array_join("datasets", ",").alias("datasets"))


def steps(f: DataFrame) -> DataFrame:
    """A job for each program, one step each, whose input is a generation of its nation's dataset."""
    b = estate.fact_table(f, "file_binding")
    data = F.concat(F.lit("PAY.N"), F.substring("assign", 3, 9), F.lit("(0)"))
    return b.select(F.concat(F.lit("J"), "program").alias("job"), F.lit(1).alias("step"), "program", F.col("assign").alias("ddname"), data.alias("dataset"), F.lit("input").alias("direction"))


@query(
    f"WITH b AS {BASE}, p AS (SELECT DISTINCT program AS x FROM b UNION SELECT 'P' || n FROM b) SELECT 'program' AS kind, COUNT(*) AS nodes FROM p UNION ALL SELECT 'dataset', COUNT(DISTINCT n) FROM b UNION ALL "
    "SELECT 'copybook', COUNT(DISTINCT c) FROM b UNION ALL SELECT 'column', COUNT(DISTINCT (d, n)) FROM b UNION ALL "
    "SELECT 'field', CAST(SUM(11 + CASE WHEN c = 3 THEN 0 ELSE c + 2 END) AS BIGINT) FROM b"
)
def corpus_graph_nodes(f):
    """Nodes of the estate graph by kind, but events and endpoints."""
    nodes, _ = views.corpus_graph(f, steps(f))
    return nodes.where("kind not in ('event', 'endpoint')").groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"SELECT status, CAST(SUM(k) AS BIGINT) AS count FROM (SELECT unnest(['planned', 'planned', 'planned', 'dynamic', 'dynamic', 'planned', 'not-retrievable']) AS status, 1 AS k FROM {BASE}) GROUP BY 1")
def corpus_status_counts(f):
    """Retrieval plan by status, nothing in hand."""
    return views.status_counts(views.fetch_plan(f))
