"""Rows that the whole views of the sample programs must have, one a line, with the columns between bars; - is null, and digits in quotes are text."""

from __future__ import annotations

DATA_DICTIONARY = """
program | name | category | digits | scale | signed | usage | member
LOOPS | END-A | alphanumeric | 0 | 0 | false | DISPLAY | -
LOOPS | KEY-A | alphanumeric | 0 | 0 | false | DISPLAY | -
LOOPS | LINE-A | group | 0 | 0 | false | DISPLAY | -
LOOPS | N-B | numeric | 2 | 0 | false | DISPLAY | -
LOOPS | QTY-A | numeric | 4 | 0 | false | DISPLAY | -
LOOPS | REC-A | group | 0 | 0 | false | DISPLAY | -
LOOPS | REC-B | group | 0 | 0 | false | DISPLAY | -
LOOPS | TAG-A | alphanumeric | 0 | 0 | false | DISPLAY | -
LOOPS | VAR-B | alphanumeric | 0 | 0 | false | DISPLAY | -
LOOPS | WS-I | numeric | 2 | 0 | false | DISPLAY | -
LOOPS | WS-Q | numeric | 4 | 0 | false | DISPLAY | -
LOOPS | WS-R | numeric | 4 | 0 | false | DISPLAY | -
LOOPS | WS-SUM | numeric | 3 | 0 | false | DISPLAY | -
LOOPS | WS-T | numeric | 4 | 0 | false | DISPLAY | -
RATES | ACC-BAL | numeric | 9 | 2 | true | COMP-3 | ACCTREC
RATES | ACC-ID | numeric | 6 | 0 | false | DISPLAY | ACCTREC
RATES | ACC-NAME | alphanumeric | 0 | 0 | false | DISPLAY | ACCTREC
RATES | ACC-STATE | alphanumeric | 0 | 0 | false | DISPLAY | ACCTREC
RATES | ACCT-REC | group | 0 | 0 | false | DISPLAY | ACCTREC
RATES | LK-FEE | numeric | 7 | 2 | false | DISPLAY | -
RATES | OUT-REC | alphanumeric | 0 | 0 | false | DISPLAY | -
RATES | WS-IND | numeric | 4 | 0 | true | COMP | -
RULES | LK-CODE | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | REP-ID | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | REP-REC | group | 0 | 0 | false | DISPLAY | -
RULES | REP-TAG | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-A | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-B | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-FEE | numeric | 7 | 2 | false | DISPLAY | -
RULES | WS-ID | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-MODE | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-NEXT | alphanumeric | 0 | 0 | false | DISPLAY | -
RULES | WS-PGM | alphanumeric | 0 | 0 | false | DISPLAY | -
TOTALS | PAY-AMT | numeric | 9 | 2 | false | COMP-3 | -
TOTALS | PAY-REC | group | 0 | 0 | false | DISPLAY | -
TOTALS | WS-END | alphanumeric | 0 | 0 | false | DISPLAY | -
TOTALS | WS-SUM | numeric | 13 | 2 | false | DISPLAY | -
"""
RECORD_LAYOUT = """
program | record_name | name | start | length | record_size | reason
LOOPS | REC-A | END-A | 23 | 1 | 23 | -
LOOPS | REC-A | KEY-A | 1 | 4 | 23 | -
LOOPS | REC-A | QTY-A | 5 | 4 | 23 | -
LOOPS | REC-A | TAG-A | 9 | 2 | 23 | -
LOOPS | REC-B | N-B | - | 2 | - | withheld: OCCURS DEPENDING ON
LOOPS | REC-B | VAR-B | - | 5 | - | withheld: OCCURS DEPENDING ON
LOOPS | WS-I | WS-I | 1 | 2 | 2 | -
LOOPS | WS-Q | WS-Q | 1 | 4 | 4 | -
LOOPS | WS-R | WS-R | 1 | 4 | 4 | -
LOOPS | WS-SUM | WS-SUM | 1 | 3 | 3 | -
LOOPS | WS-T | WS-T | 1 | 4 | 4 | -
RATES | ACCT-REC | ACC-BAL | 27 | 5 | 32 | -
RATES | ACCT-REC | ACC-ID | 1 | 6 | 32 | -
RATES | ACCT-REC | ACC-NAME | 7 | 20 | 32 | -
RATES | ACCT-REC | ACC-STATE | 32 | 1 | 32 | -
RATES | LK-FEE | LK-FEE | 1 | 7 | 7 | -
RATES | OUT-REC | OUT-REC | 1 | 40 | 40 | -
RATES | WS-IND | WS-IND | 1 | 2 | 2 | -
RULES | LK-CODE | LK-CODE | 1 | 3 | 3 | -
RULES | REP-REC | REP-ID | 1 | 6 | 9 | -
RULES | REP-REC | REP-TAG | 7 | 3 | 9 | -
RULES | WS-A | WS-A | 1 | 1 | 1 | -
RULES | WS-B | WS-B | 1 | 1 | 1 | -
RULES | WS-FEE | WS-FEE | 1 | 7 | 7 | -
RULES | WS-ID | WS-ID | 1 | 6 | 6 | -
RULES | WS-MODE | WS-MODE | 1 | 1 | 1 | -
RULES | WS-NEXT | WS-NEXT | 1 | 8 | 8 | -
RULES | WS-PGM | WS-PGM | 1 | 8 | 8 | -
TOTALS | PAY-REC | PAY-AMT | 1 | 5 | 5 | -
TOTALS | WS-END | WS-END | 1 | 1 | 1 | -
TOTALS | WS-SUM | WS-SUM | 1 | 13 | 13 | -
"""
ENDPOINTS = """
program | endpoint | endpoint_type | directions | verbs | assign
RATES | ACCOUNT | db2 | input,output | SELECT,UPDATE | -
RATES | CALLER | caller | input,output | RETURN,USING | -
RATES | LEDGER | db2 | input | FETCH | -
RATES | OUT-FILE | file | output | WRITE | RATEOUT
RULES | CALLER | caller | input | USING | -
RULES | DSNTIAR | program | output | CALL | -
RULES | REP-FILE | file | output | WRITE | REPOUT
RULES | SYSIN | console | input | ACCEPT | -
RULES | WS-NEXT | program | output | CALL | -
RULES | WS-PGM | program | output | CALL | -
TOTALS | PAY-FILE | file | input | READ | PAYIN
TOTALS | SYSOUT | console | output | DISPLAY | -
"""
CONSTANTS = """
program | item | status | literals
LOOPS | END-A | never-assigned | ''
LOOPS | KEY-A | never-assigned | ''
LOOPS | N-B | never-assigned | ''
LOOPS | QTY-A | never-assigned | ''
LOOPS | TAG-A | never-assigned | ''
LOOPS | VAR-B | never-assigned | ''
LOOPS | WS-I | runtime | '1'
LOOPS | WS-Q | runtime | ''
LOOPS | WS-R | runtime | ''
LOOPS | WS-SUM | runtime | ''
LOOPS | WS-T | runtime | ''
RATES | ACC-BAL | runtime | ''
RATES | ACC-ID | runtime | ''
RATES | ACC-NAME | runtime | ''
RATES | ACC-STATE | declared-candidates | ''
RATES | LK-FEE | runtime | ''
RATES | OUT-REC | runtime | ''
RATES | WS-IND | runtime | ''
RULES | LK-CODE | runtime | ''
RULES | REP-ID | runtime | ''
RULES | REP-TAG | runtime | AAA,BBB,CCC,DDD,EEE,FFF
RULES | WS-A | runtime | ''
RULES | WS-B | runtime | ''
RULES | WS-FEE | never-assigned | ''
RULES | WS-ID | runtime | ''
RULES | WS-MODE | runtime | ''
RULES | WS-NEXT | runtime | ''
RULES | WS-PGM | proven | RATES
TOTALS | PAY-AMT | runtime | ''
TOTALS | WS-END | candidates | N,Y
TOTALS | WS-SUM | runtime | ZERO
"""
LINEAGE = """
program | event | field | line | changed_by | origins | conditions | partial
RATES | CREATE.CALLER.CALLER | LK-FEE | 18 | L40 | GET.DB2.LEDGER | '' | false
RATES | GET.CALLER.CALLER | LK-FEE | 18 | '' | GET.CALLER.CALLER | '' | false
RATES | GET.DB2.ACCOUNT | ACC-BAL | 19 | '' | GET.DB2.ACCOUNT | '' | false
RATES | GET.DB2.ACCOUNT | ACC-NAME | 19 | '' | GET.DB2.ACCOUNT | '' | false
RATES | GET.DB2.ACCOUNT | ACC-BAL | 25 | '' | GET.DB2.ACCOUNT | '' | false
RATES | GET.DB2.ACCOUNT | ACC-NAME | 25 | '' | GET.DB2.ACCOUNT | '' | false
RATES | GET.DB2.ACCOUNT | WS-IND | 25 | '' | GET.DB2.ACCOUNT | '' | false
RATES | CREATE.DB2.ACCOUNT | ACC-BAL | 29 | '' | GET.DB2.ACCOUNT | '' | false
RATES | GET.DB2.LEDGER | ACC-BAL | 35 | '' | GET.DB2.LEDGER | '' | false
RATES | GET.DB2.LEDGER | ACC-ID | 35 | '' | GET.DB2.LEDGER | '' | false
RATES | CREATE.FILE.OUT-FILE | OUT-REC | 39 | L38 | GET.DB2.ACCOUNT | '' | false
RULES | GET.CALLER.CALLER | LK-CODE | 26 | '' | GET.CALLER.CALLER | '' | false
RULES | GET.CONSOLE.SYSIN | WS-MODE | 28 | '' | GET.CONSOLE.SYSIN | '' | false
RULES | GET.CONSOLE.SYSIN | WS-A | 29 | '' | GET.CONSOLE.SYSIN | '' | false
RULES | GET.CONSOLE.SYSIN | WS-B | 30 | '' | GET.CONSOLE.SYSIN | '' | false
RULES | GET.CONSOLE.SYSIN | WS-ID | 31 | '' | GET.CONSOLE.SYSIN | '' | false
RULES | CREATE.PROGRAM.WS-PGM | WS-FEE | 36 | '' | '' | '' | false
RULES | CREATE.FILE.REP-FILE | REP-ID | 46 | L44 | GET.CONSOLE.SYSIN | LIVE | false
RULES | CREATE.FILE.REP-FILE | REP-TAG | 46 | L45 | '' | LIVE | false
RULES | CREATE.FILE.REP-FILE | REP-ID | 54 | L44 | GET.CONSOLE.SYSIN | '' | false
RULES | CREATE.FILE.REP-FILE | REP-TAG | 54 | L50,L52 | GET.CALLER.CALLER | '' | false
RULES | CREATE.FILE.REP-FILE | REP-ID | 60 | L44 | GET.CONSOLE.SYSIN | NOT WS-A = 'P',NOT WS-A = 'Q' | false
RULES | CREATE.FILE.REP-FILE | REP-TAG | 60 | L59 | '' | NOT WS-A = 'P',NOT WS-A = 'Q' | false
RULES | CREATE.FILE.REP-FILE | REP-ID | 71 | L44 | GET.CONSOLE.SYSIN | '' | true
RULES | CREATE.FILE.REP-FILE | REP-TAG | 71 | L70 | '' | '' | true
TOTALS | CREATE.CONSOLE.SYSOUT | WS-SUM | 22 | L28 | GET.FILE.PAY-FILE | NO-MORE | false
TOTALS | GET.FILE.PAY-FILE | PAY-AMT | 26 | '' | GET.FILE.PAY-FILE | NOT NO-MORE | false
"""
BUSINESS_RULES = """
program | event | line | rule | fields
RATES | CREATE.CALLER.CALLER | 18 | '' | LK-FEE
RATES | CREATE.DB2.ACCOUNT | 29 | '' | ACC-BAL
RATES | CREATE.FILE.OUT-FILE | 39 | '' | OUT-REC
RULES | CREATE.PROGRAM.WS-PGM | 36 | '' | WS-FEE
RULES | CREATE.FILE.REP-FILE | 46 | LIVE | REP-ID,REP-TAG
RULES | CREATE.FILE.REP-FILE | 54 | '' | REP-ID,REP-TAG
RULES | CREATE.FILE.REP-FILE | 60 | NOT (WS-A = 'P') AND NOT (WS-A = 'Q') | REP-ID,REP-TAG
RULES | CREATE.FILE.REP-FILE | 71 | '' | REP-ID,REP-TAG
TOTALS | CREATE.CONSOLE.SYSOUT | 22 | '' | WS-SUM
"""
BUSINESS_STEPS = """
program | source | target | rule
LOOPS | 0 | - | NOT (WS-R > 5)
RATES | 0 | 19 | ''
RATES | 19 | 25 | ''
RATES | 25 | 29 | ''
RATES | 29 | 35 | ''
RATES | 35 | 39 | ''
RATES | 39 | - | ''
RULES | 0 | 28 | ''
RULES | 28 | 29 | ''
RULES | 29 | 30 | ''
RULES | 30 | 31 | ''
RULES | 31 | 46 | LIVE
RULES | 31 | 54 | NOT (LIVE)
RULES | 36 | 37 | ''
RULES | 37 | 39 | ''
RULES | 39 | - | ''
RULES | 46 | 54 | ''
RULES | 54 | 36 | NOT (WS-A = 'Y'),NOT (WS-B = 'Y')
RULES | 54 | 60 | NOT (WS-A = 'P'),NOT (WS-A = 'Q')
RULES | 54 | 71 | ''
RULES | 60 | 36 | NOT (WS-A = 'Y'),NOT (WS-B = 'Y')
RULES | 60 | 71 | ''
RULES | 71 | 36 | ''
RULES | 71 | 71 | WS-B = 'Y'
TOTALS | 0 | 22 | ''
TOTALS | 0 | 26 | ''
TOTALS | 22 | - | ''
TOTALS | 26 | 22 | ''
TOTALS | 26 | 26 | ''
"""
BUSINESS_STATES = """
program | paragraph | role
LOOPS | A-MAIN | technical
LOOPS | B-ADD | technical
LOOPS | C-SELF | decision
RATES | A-MAIN | input-output
RULES | 0-MAIN | input-output
RULES | 1-GUARD | output
RULES | 2-JOIN | output
RULES | 3-REST | output
RULES | 4-TWICE | decision
RULES | 5-EMIT | output
TOTALS | A-MAIN | output
TOTALS | B-NEXT | input
"""
STATEMENTS = """
program | stmt_id | parent_id | branch | paragraph | kind | line | member
LOOPS | 0 | - | - | A-MAIN | PERFORM | 22 | -
LOOPS | 1 | - | - | A-MAIN | PERFORM | 23 | -
LOOPS | 2 | 1 | BODY | A-MAIN | ADD | 24 | -
LOOPS | 3 | - | - | A-MAIN | DIVIDE | 26 | -
LOOPS | 4 | - | - | A-MAIN | PERFORM | 27 | -
LOOPS | 5 | - | - | A-MAIN | STOP | 28 | -
LOOPS | 6 | - | - | B-ADD | ADD | 30 | -
LOOPS | 7 | - | - | C-SELF | IF | 32 | -
LOOPS | 8 | 7 | THEN | C-SELF | PERFORM | 33 | -
RATES | 0 | - | - | A-MAIN | EXEC | 19 | -
RATES | 1 | - | - | A-MAIN | EXEC | 25 | -
RATES | 2 | - | - | A-MAIN | EXEC | 29 | -
RATES | 3 | - | - | A-MAIN | EXEC | 32 | -
RATES | 4 | - | - | A-MAIN | EXEC | 35 | -
RATES | 5 | - | - | A-MAIN | MOVE | 38 | -
RATES | 6 | - | - | A-MAIN | WRITE | 39 | -
RATES | 7 | - | - | A-MAIN | COMPUTE | 40 | -
RATES | 8 | - | - | A-MAIN | GOBACK | 41 | -
RULES | 0 | - | - | 0-MAIN | OPEN | 27 | -
RULES | 1 | - | - | 0-MAIN | ACCEPT | 28 | -
RULES | 2 | - | - | 0-MAIN | ACCEPT | 29 | -
RULES | 3 | - | - | 0-MAIN | ACCEPT | 30 | -
RULES | 4 | - | - | 0-MAIN | ACCEPT | 31 | -
RULES | 5 | - | - | 0-MAIN | PERFORM | 32 | -
RULES | 6 | - | - | 0-MAIN | PERFORM | 33 | -
RULES | 7 | - | - | 0-MAIN | PERFORM | 34 | -
RULES | 8 | - | - | 0-MAIN | PERFORM | 35 | -
RULES | 9 | - | - | 0-MAIN | CALL | 36 | -
RULES | 10 | - | - | 0-MAIN | CALL | 37 | -
RULES | 11 | - | - | 0-MAIN | MOVE | 38 | -
RULES | 12 | - | - | 0-MAIN | CALL | 39 | -
RULES | 13 | - | - | 0-MAIN | CLOSE | 40 | -
RULES | 14 | - | - | 0-MAIN | GOBACK | 41 | -
RULES | 15 | - | - | 1-GUARD | IF | 43 | -
RULES | 16 | 15 | THEN | 1-GUARD | MOVE | 44 | -
RULES | 17 | 15 | THEN | 1-GUARD | MOVE | 45 | -
RULES | 18 | 15 | THEN | 1-GUARD | WRITE | 46 | -
RULES | 19 | - | - | 2-JOIN | IF | 49 | -
RULES | 20 | 19 | THEN | 2-JOIN | MOVE | 50 | -
RULES | 21 | 19 | ELSE | 2-JOIN | MOVE | 52 | -
RULES | 22 | - | - | 2-JOIN | WRITE | 54 | -
RULES | 23 | - | - | 3-REST | EVALUATE | 56 | -
RULES | 24 | 23 | WHEN | 3-REST | MOVE | 57 | -
RULES | 25 | 23 | WHEN | 3-REST | MOVE | 58 | -
RULES | 26 | 23 | WHEN | 3-REST | MOVE | 59 | -
RULES | 27 | 23 | WHEN | 3-REST | WRITE | 60 | -
RULES | 28 | - | - | 4-TWICE | IF | 63 | -
RULES | 29 | 28 | THEN | 4-TWICE | PERFORM | 64 | -
RULES | 30 | - | - | 4-TWICE | IF | 66 | -
RULES | 31 | 30 | THEN | 4-TWICE | PERFORM | 67 | -
RULES | 32 | - | - | 5-EMIT | MOVE | 70 | -
RULES | 33 | - | - | 5-EMIT | WRITE | 71 | -
TOTALS | 0 | - | - | A-MAIN | OPEN | 20 | -
TOTALS | 1 | - | - | A-MAIN | PERFORM | 21 | -
TOTALS | 2 | - | - | A-MAIN | DISPLAY | 22 | -
TOTALS | 3 | - | - | A-MAIN | CLOSE | 23 | -
TOTALS | 4 | - | - | A-MAIN | STOP | 24 | -
TOTALS | 5 | - | - | B-NEXT | READ | 26 | -
TOTALS | 6 | 5 | END | B-NEXT | SET | 27 | -
TOTALS | 7 | 5 | NOT END | B-NEXT | ADD | 28 | -
"""


def values(table: str) -> str:
    """A table of this module as SQL."""
    head, *lines = table.strip().splitlines()

    def cell(x: str) -> str:
        if x == "-":
            return "NULL"
        if x in ("true", "false") or x.lstrip("-").isdigit():
            return x
        return "'" + (x.strip("'") if x.startswith("'") else x).replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(cell(x.strip()) for x in line.split(" | ")) + ")" for line in lines)
    return f"SELECT * FROM (VALUES {rows}) AS t({head.replace(' | ', ', ')})"
