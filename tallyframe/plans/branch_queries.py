"""Driver queries over programs of five shapes that Spark writes from `supplier`: branches, performed paragraphs, loops, and calls from program to program.

Program P<k> belongs to supplier k and has the shape k % 5. It calls P<k // 2>, so that values travel down a tree of calls; the SQL follows the same
rules by recursion over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.settle import settled
from ..sources import estate
from . import estate_flow, source_lines, views

QUERIES: dict = {}
ORACLES: dict = {}

HEAD = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. P{k}.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO DDIN.
           SELECT OUT-FILE ASSIGN TO DDOUT.
       DATA DIVISION.
       FILE SECTION.
       FD  IN-FILE.
       01  IN-REC.
           05  IN-AMT   PIC 9(5).
           05  IN-CODE  PIC X.
       FD  OUT-FILE.
       01  OUT-REC.
           05  OUT-AMT  PIC 9(5).
           05  OUT-CODE PIC X.
       WORKING-STORAGE SECTION.
       01  WS-X         PIC 9(5).
       01  WS-Y         PIC X.
       01  WS-END       PIC X VALUE 'N'.
       LINKAGE SECTION.
       01  LK-A         PIC 9(5).
       PROCEDURE DIVISION USING LK-A.
       A-MAIN.
           READ IN-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ
"""
#: What each shape does between its READ and its WRITE.
BODIES = (
    # a branch that joins again, then a guarded write
    """           IF IN-AMT > {k}
               MOVE IN-AMT TO WS-X
           ELSE
               MOVE LK-A TO WS-X
           END-IF
           CALL 'P{h}' USING WS-X
           IF IN-CODE = 'W'
               MOVE WS-X TO OUT-AMT
               MOVE IN-CODE TO OUT-CODE
               WRITE OUT-REC
           END-IF
           STOP RUN.
""",
    # one paragraph performed under two conditions, which both reach its write
    """           MOVE IN-AMT TO WS-X
           MOVE 'Z' TO OUT-CODE
           IF IN-CODE = 'A'
               PERFORM B-PUT
           END-IF
           IF IN-AMT > {k}
               CALL 'P{h}' USING WS-X
               PERFORM B-PUT
           END-IF
           STOP RUN.
       B-PUT.
           MOVE WS-X TO OUT-AMT
           WRITE OUT-REC.
""",
    # a dispatch, each case in a paragraph of its own
    """           MOVE LK-A TO WS-X
           EVALUATE IN-CODE
               WHEN 'A' PERFORM B-ADD
               WHEN 'B' PERFORM C-SET
               WHEN OTHER PERFORM D-CALL
           END-EVALUATE
           MOVE WS-X TO OUT-AMT
           MOVE IN-CODE TO OUT-CODE
           WRITE OUT-REC
           STOP RUN.
       B-ADD.
           ADD IN-AMT TO WS-X.
       C-SET.
           MOVE 7 TO WS-X.
       D-CALL.
           CALL 'P{h}' USING WS-X.
""",
    # a loop
    """           PERFORM B-EACH UNTIL WS-END = 'Y'
           CALL 'P{h}' USING LK-A
           MOVE LK-A TO OUT-AMT
           MOVE WS-Y TO OUT-CODE
           WRITE OUT-REC
           STOP RUN.
       B-EACH.
           IF IN-AMT > {k}
               MOVE IN-CODE TO WS-Y
           END-IF
           READ IN-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ.
""",
    # paragraphs that perform one another; what is performed sets a field that its caller passes on
    """           PERFORM B-DOWN
           MOVE WS-X TO LK-A
           MOVE WS-X TO OUT-AMT
           MOVE 'Q' TO OUT-CODE
           WRITE OUT-REC
           STOP RUN.
       B-DOWN.
           MOVE IN-AMT TO WS-X
           IF IN-AMT > {k}
               PERFORM C-UP
           END-IF.
       C-UP.
           IF IN-CODE = 'R'
               PERFORM B-DOWN
           END-IF
           ACCEPT WS-X.
""",
)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit(HEAD), F.element_at(F.array(*map(F.lit, BODIES)), (k % 5 + 1).cast("int")))
    for mark, value in (("{k}", k), ("{h}", F.expr("div(s_suppkey, 2)"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("P"), k).alias("name"), text.alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(estate.parse_estate(programs(spark, sf_dir)))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(facts(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH p AS (SELECT s_suppkey AS k, s_suppkey // 2 AS h, s_suppkey % 5 AS s FROM supplier)
SELECT 'P' || k AS program, 'CREATE.FILE.OUT-FILE' AS event, CASE s WHEN 0 THEN 'IN-CODE = ''W''' WHEN 3 THEN 'WS-END = ''Y''' ELSE '' END AS conditions, s = 1 AS partial FROM p
UNION ALL
SELECT 'P' || k, 'CREATE.PROGRAM.P' || h,
       CASE s WHEN 1 THEN 'IN-AMT > ' || k WHEN 2 THEN 'NOT (IN-CODE = ''A'') & NOT (IN-CODE = ''B'')' WHEN 3 THEN 'WS-END = ''Y''' ELSE '' END, false
FROM p WHERE s < 4
UNION ALL
SELECT 'P' || k, 'GET.CONSOLE.SYSIN', 'IN-AMT > ' || k, false FROM p WHERE s = 4
UNION ALL
SELECT 'P' || k, 'CREATE.CALLER.CALLER', '', false FROM p WHERE s = 4
""")
def corpus_conditions(f):
    """Outputs and console inputs of all programs: under which conditions, and whether some ways to them are under others."""
    c = estate_flow.event_conditions(f).where("direction = 'output' or event = 'GET.CONSOLE.SYSIN'")
    return c.select("program", "event", F.array_join("conditions", " & ").alias("conditions"), "partial")


@query("""
WITH RECURSIVE p AS (
  SELECT s_suppkey AS k, s_suppkey // 2 AS h, s_suppkey % 5 AS s FROM supplier
), link AS (  -- entry: the parameter at the start; arg: what is passed on; end: the parameter at the end; call: what a call may set; out: what is written
  SELECT 'entry' AS to_kind, h AS to_k, 'arg' AS kind, k FROM p WHERE s < 4
  UNION ALL SELECT 'arg', k, 'entry', k FROM p WHERE s IN (0, 2, 3)
  UNION ALL SELECT 'end', k, 'entry', k FROM p WHERE s < 4
  UNION ALL SELECT 'end', k, 'call', k FROM p WHERE s = 3
  UNION ALL SELECT 'call', k, 'end', h FROM p WHERE s < 4
  UNION ALL SELECT 'out', k, 'entry', k FROM p WHERE s IN (0, 2, 3)
  UNION ALL SELECT 'out', k, 'call', k FROM p WHERE s < 4
), value_of(kind, k, origin_k, origin, maybe) AS (
  SELECT * FROM (
    SELECT 'entry', k, k, 'GET.CALLER.CALLER', false FROM p
    UNION SELECT 'arg', k, k, 'GET.FILE.IN-FILE', false FROM p WHERE s < 2
    UNION SELECT unnest(['end', 'end', 'out']), k, k, unnest(['GET.FILE.IN-FILE', 'GET.CONSOLE.SYSIN', 'GET.CONSOLE.SYSIN']), false FROM p WHERE s = 4
    UNION SELECT 'call', k, k, 'GET.PROGRAM.P' || h, true FROM p WHERE s < 4
    UNION SELECT 'out', k, k, 'GET.FILE.IN-FILE', false FROM p WHERE s <> 3
  )
  UNION SELECT l.to_kind, l.to_k, v.origin_k, v.origin, v.maybe FROM value_of AS v JOIN link AS l ON l.kind = v.kind AND l.k = v.k
)
SELECT 'P' || k AS program, 'OUT-AMT' AS field, 'P' || origin_k AS origin_program, origin, maybe FROM value_of WHERE kind = 'out'
UNION ALL
SELECT 'P' || k, 'OUT-CODE', 'P' || k, 'GET.FILE.IN-FILE', false FROM p WHERE s IN (0, 2, 3)
""")
def corpus_lineage(f):
    """Where the fields of written records come from, within programs and through calls."""
    return estate_flow.origins(f).where("event = 'CREATE.FILE.OUT-FILE'").select("program", "field", "origin_program", "origin", "maybe").distinct()


@query("SELECT 'P' || s_suppkey AS program, unnest(['B-DOWN', 'C-UP']) AS paragraph FROM supplier WHERE s_suppkey % 5 = 4")
def corpus_cycles(f):
    """Paragraphs that perform themselves through others."""
    return views.perform_cycles(f)


@query("""
WITH RECURSIVE p AS (
  SELECT s_suppkey AS k, s_suppkey // 2 AS h FROM supplier WHERE s_suppkey % 5 < 4
), way(a, b) AS (
  SELECT k, h FROM p
  UNION SELECT w.a, p.h FROM way AS w JOIN p ON p.k = w.b
)
SELECT 'P' || x.a AS node, 'P' || min(y.b) AS component FROM way AS x JOIN way AS y ON y.a = x.a JOIN way AS z ON z.a = y.b AND z.b = x.a WHERE x.b = x.a GROUP BY x.a
""")
def corpus_call_cycles(f):
    """Programs that call themselves, directly or through others."""
    return estate_flow.call_cycles(f)


# many branches that meet again

DIAMONDS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. D{k}.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO DDIN.
           SELECT OUT-FILE ASSIGN TO DDOUT.
       DATA DIVISION.
       FILE SECTION.
       FD  IN-FILE.
       01  IN-REC.
           05  IN-AMT   PIC 9(5).
           05  IN-CODE  PIC X.
       FD  OUT-FILE.
       01  OUT-REC      PIC 9(5).
       WORKING-STORAGE SECTION.
       01  WS-X         PIC 9(5).
       01  WS-IN        PIC 9(5).
       PROCEDURE DIVISION.
       A-MAIN.
           READ IN-FILE
               AT END MOVE 0 TO WS-X
           END-READ
{diamonds}
           IF IN-CODE = 'W'
               WRITE OUT-REC
           END-IF
           PERFORM B-LOG
           ACCEPT WS-IN
           STOP RUN.
       B-LOG.
           IF IN-CODE = 'L'
               DISPLAY WS-X
           END-IF.
"""


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each supplier k with 16 IFs one after another, each with an ELSE; for odd k a last one without a way round it guards the WRITE."""
    k = F.col("s_suppkey").cast("string")
    one = "           IF IN-AMT > {i}\n               ADD {i} TO WS-X\n           ELSE\n               SUBTRACT 1 FROM WS-X\n           END-IF\n"
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.replace(F.lit(one), F.lit("{i}"), (i * 10 + F.col("s_suppkey") % 10).cast("string"))), "")
    body = F.concat(body, F.when(F.col("s_suppkey") % 2 == 1, F.lit("           IF WS-X > 9\n               STOP RUN\n           END-IF\n")).otherwise(F.lit("")))
    text = F.replace(F.replace(F.lit(DIAMONDS), F.lit("{k}"), k), F.lit("{diamonds}"), body)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("D"), k).alias("name"), text.alias("text"))


@query("""
WITH p AS (SELECT 'D' || s_suppkey AS program, s_suppkey % 2 = 1 AS odd FROM supplier), s AS (
  SELECT program, odd, unnest([
    {'a': 'START', 'z': 'READ', 'own': '', 'gate': false},
    {'a': 'READ', 'z': 'WRITE', 'own': 'IN-CODE = ''W''', 'gate': true},
    {'a': 'READ', 'z': 'DISPLAY', 'own': 'IN-CODE = ''L'' & NOT (IN-CODE = ''W'')', 'gate': true},
    {'a': 'READ', 'z': 'ACCEPT', 'own': 'NOT (IN-CODE = ''W'')', 'gate': true},
    {'a': 'WRITE', 'z': 'DISPLAY', 'own': 'IN-CODE = ''L''', 'gate': false},
    {'a': 'WRITE', 'z': 'ACCEPT', 'own': '', 'gate': false},
    {'a': 'DISPLAY', 'z': 'ACCEPT', 'own': '', 'gate': false},
    {'a': 'ACCEPT', 'z': 'END', 'own': '', 'gate': false}]) AS t FROM p
)
SELECT program, t.a AS source, t.z AS target, concat_ws(' & ', nullif(t.own, ''), CASE WHEN odd AND t.gate THEN 'NOT (WS-X > 9)' END) AS rule, false AS partial FROM s
UNION ALL SELECT program, 'READ', 'END', 'WS-X > 9', false FROM p WHERE odd
""")
def corpus_business_steps(f):
    """Steps between the boundary crossings of programs with sixteen branches that meet again, as many as there are ways to cross, not as there are paths."""
    steps = estate_flow.business_steps(f)
    kinds = estate.fact_table(f, "statement").where("kind in ('READ', 'WRITE', 'DISPLAY', 'ACCEPT')").select("program", "line", "kind")
    named = steps.join(kinds.select("program", F.col("line").alias("source"), F.col("kind").alias("a")), ["program", "source"], "left")
    named = named.join(kinds.select("program", F.col("line").alias("target"), F.col("kind").alias("z")), ["program", "target"], "left")
    return named.select("program", F.coalesce("a", F.lit("START")).alias("source"), F.coalesce("z", F.lit("END")).alias("target"), F.array_join("rule", " & ").alias("rule"), "partial")


QUERIES["corpus_business_steps"] = lambda spark, sf_dir: corpus_business_steps(settled(estate.parse_estate(diamonds(spark, sf_dir))))


# lines

LINES = """       IDENTIFICATION DIVISION.
      * NOTE {k}
       PROCEDURE DIVISION.
000040 A{k}.
           DISPLAY 'it''s *> {k}'  *> note
           EJECT
           MOVE 'LONG {k}
      -    'TAIL' TO WS-X.
      D    DISPLAY 'DEBUG'.

           STOP RUN.                                                    CHANGED
"""


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lines of a program for each supplier, with comments, a debugging line, a continued literal and listing words."""
    k = F.col("s_suppkey").cast("string")
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("L"), k).alias("name"), F.replace(F.lit(LINES), F.lit("{k}"), k).alias("text"))
    return source_lines.logical(texts).select("name", "line", F.rtrim("text").alias("text"))


QUERIES["corpus_lines"] = corpus_lines
ORACLES["corpus_lines"] = """
SELECT 'L' || s_suppkey AS name, unnest([1, 3, 4, 5, 7, 11]) AS line,
       unnest(['IDENTIFICATION DIVISION.', 'PROCEDURE DIVISION.', 'A' || s_suppkey || '.', '    DISPLAY ''it''''s *> ' || s_suppkey || '''',
               rpad('    MOVE ''LONG ' || s_suppkey, 65, ' ') || 'TAIL'' TO WS-X.', '    STOP RUN.']) AS text
FROM supplier
"""
