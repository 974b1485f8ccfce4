"""Logical lines as columns against the same rules in plain Python."""

import random

from tallyframe.plans import source_lines, source_text

PIECES = [
    "IDENTIFICATION DIVISION.", "PROCEDURE DIVISION.", "MOVE 'A*>B' TO X *> note", "DISPLAY 'it''s *> here", "EJECT", "TITLE 'x'.", "CBL LIB", "PROCESS-MAIN.", "", "   ", "ADD 1\tTO\tN", '"open literal', "rest' of it.", "'rest' of it.",
    "MOVE X TO Y.", ">>SOURCE FORMAT IS FREE", "* old comment", "*> comment", "data division.", "x" * 90,
]


def test_lines_match(spark):
    rng = random.Random(9)
    texts = [None, "", "\n\n", "       ID DIVISION.\r\n      -    'x'\r\n"]
    for i in range(300):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            body = rng.choice(PIECES[: 14 if i % 3 else len(PIECES)])
            kind = rng.random()
            lines.append(body if i % 4 == 0 else f"{rng.randrange(10**6):06d}" + rng.choice("      -*/D" if kind < 0.9 else "X") + ("    " if rng.random() < 0.5 else "") + body)
        texts.append(rng.choice(("\n", "\r\n")).join(lines) + rng.choice(("", "\n")))
    df = spark.createDataFrame([(f"P{i}", t) for i, t in enumerate(texts)], "name string, text string")
    got = {}
    for r in source_lines.logical(df).collect():
        got.setdefault(r.name, []).append((r.line, r.text))
    forms = {r.name: (r.form, round(r.confidence, 6)) for r in source_lines.formats(source_lines.physical(df)).collect()}
    for i, t in enumerate(texts):
        want = [(x.line, x.text) for x in source_text.logical_lines(t or "")]
        assert sorted(got.get(f"P{i}", [])) == want, (t, want, sorted(got.get(f"P{i}", [])))
        if t and t.strip():
            form, confidence, _ = source_text.detect_format(t)
            assert forms[f"P{i}"] == (form, round(confidence, 6)), t
