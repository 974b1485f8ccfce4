"""Small sample programs that the estate queries run on."""

TOTALS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TOTALS.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT PAY-FILE ASSIGN TO PAYIN
               ORGANIZATION IS SEQUENTIAL.
       DATA DIVISION.
       FILE SECTION.
       FD  PAY-FILE.
       01  PAY-REC.
           05  PAY-AMT       PIC 9(7)V99 COMP-3.
       WORKING-STORAGE SECTION.
       01  WS-END            PIC X VALUE 'N'.
           88  NO-MORE       VALUE 'Y'.
       01  WS-SUM            PIC 9(11)V99 VALUE ZERO.
       PROCEDURE DIVISION.
       A-MAIN.
           OPEN INPUT PAY-FILE
           PERFORM B-NEXT UNTIL NO-MORE
           DISPLAY WS-SUM
           CLOSE PAY-FILE
           STOP RUN.
       B-NEXT.
           READ PAY-FILE
               AT END SET NO-MORE TO TRUE
               NOT AT END ADD PAY-AMT TO WS-SUM
           END-READ.
"""
RULES = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. RULES.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT REP-FILE ASSIGN TO REPOUT.
       DATA DIVISION.
       FILE SECTION.
       FD  REP-FILE.
       01  REP-REC.
           05  REP-ID    PIC X(6).
           05  REP-TAG   PIC X(3).
       WORKING-STORAGE SECTION.
       01  WS-MODE       PIC X.
           88  LIVE      VALUE 'L'.
       01  WS-A          PIC X.
       01  WS-B          PIC X.
       01  WS-ID         PIC X(6).
       01  WS-PGM        PIC X(8) VALUE 'RATES'.
       01  WS-FEE        PIC 9(5)V99.
       01  WS-NEXT       PIC X(8).
       LINKAGE SECTION.
       01  LK-CODE       PIC X(3).
       PROCEDURE DIVISION USING LK-CODE.
       0-MAIN.
           OPEN OUTPUT REP-FILE
           ACCEPT WS-MODE
           ACCEPT WS-A
           ACCEPT WS-B
           ACCEPT WS-ID
           PERFORM 1-GUARD
           PERFORM 2-JOIN
           PERFORM 3-REST
           PERFORM 4-TWICE
           CALL WS-PGM USING WS-FEE
           CALL 'DSNTIAR'
           MOVE WS-ID TO WS-NEXT
           CALL WS-NEXT
           CLOSE REP-FILE
           GOBACK.
       1-GUARD.
           IF LIVE
               MOVE WS-ID TO REP-ID
               MOVE 'AAA' TO REP-TAG
               WRITE REP-REC
           END-IF.
       2-JOIN.
           IF WS-A = 'X'
               MOVE 'BBB' TO REP-TAG
           ELSE
               MOVE LK-CODE TO REP-TAG
           END-IF
           WRITE REP-REC.
       3-REST.
           EVALUATE WS-A
               WHEN 'P' MOVE 'CCC' TO REP-TAG
               WHEN 'Q' MOVE 'DDD' TO REP-TAG
               WHEN OTHER MOVE 'EEE' TO REP-TAG
                   WRITE REP-REC
           END-EVALUATE.
       4-TWICE.
           IF WS-A = 'Y'
               PERFORM 5-EMIT
           END-IF
           IF WS-B = 'Y'
               PERFORM 5-EMIT
           END-IF.
       5-EMIT.
           MOVE 'FFF' TO REP-TAG
           WRITE REP-REC.
"""
RATES = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. RATES.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT OUT-FILE ASSIGN TO RATEOUT.
       DATA DIVISION.
       FILE SECTION.
       FD  OUT-FILE.
       01  OUT-REC          PIC X(40).
       WORKING-STORAGE SECTION.
           COPY ACCTREC.
       01  WS-IND           PIC S9(4) COMP.
       LINKAGE SECTION.
       01  LK-FEE           PIC 9(5)V99.
       PROCEDURE DIVISION USING LK-FEE.
       A-MAIN.
           EXEC SQL
               SELECT A.NAME, A.BAL AS B
               INTO :ACC-NAME, :ACC-BAL
               FROM ADMIN.ACCOUNT A
               WHERE A.ID = :ACC-ID
           END-EXEC
           EXEC SQL
               SELECT NAME, BAL INTO :ACC-NAME, :ACC-BAL:WS-IND
               FROM ACCOUNT
           END-EXEC
           EXEC SQL
               UPDATE ACCOUNT SET BAL = :ACC-BAL WHERE ID = :ACC-ID
           END-EXEC
           EXEC SQL
               DECLARE C1 CURSOR FOR SELECT ID, SUM(DR, CR) FROM LEDGER
           END-EXEC
           EXEC SQL
               FETCH C1 INTO :ACC-ID, :ACC-BAL
           END-EXEC
           MOVE ACC-NAME TO OUT-REC
           WRITE OUT-REC
           COMPUTE LK-FEE = ACC-BAL * 2
           GOBACK.
"""
ACCTREC = """
       01  ACCT-REC.
           05  ACC-ID       PIC 9(6).
           05  ACC-NAME     PIC X(20).
           05  ACC-BAL      PIC S9(7)V99 COMP-3.
           05  ACC-STATE    PIC X.
               88  ACC-OPEN VALUE 'O'.
"""
LOOPS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. LOOPS.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  REC-A.
           05  KEY-A        PIC X(4).
           05  LINE-A       OCCURS 3.
               10  QTY-A    PIC 9(4).
               10  TAG-A    PIC XX.
           05  END-A        PIC X.
       01  REC-B.
           05  N-B          PIC 9(2).
           05  VAR-B        PIC X OCCURS 1 TO 5 DEPENDING ON N-B.
       01  WS-I             PIC 99.
       01  WS-SUM           PIC 999.
       01  WS-T             PIC 9(4).
       01  WS-Q             PIC 9(4).
       01  WS-R             PIC 9(4).
       PROCEDURE DIVISION.
       A-MAIN.
           PERFORM B-ADD VARYING WS-I FROM 1 BY 1 UNTIL WS-I > 5
           PERFORM 4 TIMES
               ADD 2 TO WS-T
           END-PERFORM
           DIVIDE 7 BY 2 GIVING WS-Q REMAINDER WS-R
           PERFORM C-SELF
           STOP RUN.
       B-ADD.
           ADD WS-I TO WS-SUM.
       C-SELF.
           IF WS-R > 5
               PERFORM C-SELF
           END-IF.
"""
ORDERS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ORDERS.
       DATA DIVISION.
       FILE SECTION.
       FD  ORD-FILE.
       01  ORD-REC.
           05  ORD-STATUS    PIC X.
               88  ORD-OPEN  VALUE 'O'.
           05  ORD-AMT       PIC S9(7)V99.
       WORKING-STORAGE SECTION.
       01  WS-END            PIC X VALUE 'N'.
       01  OPEN-SUM          PIC S9(11)V99.
       01  ALL-COUNT         PIC 9(7).
       01  BIG-COUNT         PIC 9(5).
       01  NET               PIC S9(6)V9.
       01  LAST-STATUS       PIC X.
       PROCEDURE DIVISION.
       A-MAIN.
           OPEN INPUT ORD-FILE
           READ ORD-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ
           PERFORM B-ONE UNTIL WS-END = 'Y'
           CLOSE ORD-FILE
           STOP RUN.
       B-ONE.
           ADD 1 TO ALL-COUNT
           IF ORD-OPEN
               ADD ORD-AMT TO OPEN-SUM
               ADD ORD-AMT TO NET
           ELSE
               SUBTRACT ORD-AMT FROM NET
           END-IF
           IF ORD-AMT > 200000 AND NOT ORD-OPEN
               ADD 1 TO BIG-COUNT
           END-IF
           MOVE ORD-STATUS TO LAST-STATUS
           READ ORD-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ.
"""
#: Writes the large open orders of a customer, and counts them.
PICKS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PICKS.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT ORD-FILE ASSIGN TO ORDIN.
           SELECT OUT-FILE ASSIGN TO ORDOUT.
       DATA DIVISION.
       FILE SECTION.
       FD  ORD-FILE.
       01  ORD-REC.
           05  ORD-ID        PIC 9(9).
           05  ORD-STATUS    PIC X.
           05  ORD-AMT       PIC 9(7)V99.
       FD  OUT-FILE.
       01  OUT-REC.
           05  OUT-ID        PIC 9(9).
           05  OUT-AMT       PIC 9(7)V99.
           05  OUT-NO        PIC 9(5).
       WORKING-STORAGE SECTION.
       01  WS-END            PIC X VALUE 'N'.
       PROCEDURE DIVISION.
       PROCESS-MAIN.
           READ ORD-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ
           PERFORM PROCESS-ORDER UNTIL WS-END = 'Y'
           STOP RUN.
       PROCESS-ORDER.
           IF ORD-STATUS = 'O' AND ORD-AMT > 200000
               ADD 1 TO OUT-NO
               MOVE ORD-ID TO OUT-ID
               MOVE ORD-AMT TO OUT-AMT
               WRITE OUT-REC
           END-IF
           READ ORD-FILE
               AT END MOVE 'Y' TO WS-END
           END-READ.
"""
PROGRAMS = {"TOTALS": TOTALS, "RULES": RULES, "RATES": RATES, "LOOPS": LOOPS}
MEMBERS = {"ACCTREC": ACCTREC}
