"""Programs to trees: divisions, data items, file bindings, paragraphs and statements. Pure Python.

A statement is a Stmt: kind (the verb), words (its own tokens), line, and branches [(label, tokens of its condition or None, [Stmt])]. A paragraph
whose body cannot be read becomes one opaque statement and a flag; nothing is guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.language import TOKEN, is_literal, literal_text
from ..functions.picture import Picture, parse_picture
from .source_text import Line, detect_format, masked, preprocess

VERBS = frozenset(
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE ENTRY EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY NEXT OPEN PERFORM READ RELEASE "
    "RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING USE WRITE".split()
)
#: Which handler phrases a verb owns.
OWNS = {
    **dict.fromkeys(("READ", "RETURN", "SEARCH"), {"END", "INVALID"}), **dict.fromkeys(("WRITE",), {"INVALID", "EOP"}), **dict.fromkeys(("REWRITE", "DELETE", "START"), {"INVALID"}),
    **dict.fromkeys(("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE"), {"SIZE"}), **dict.fromkeys(("CALL", "ACCEPT", "DISPLAY"), {"EXCEPTION", "OVERFLOW"}), **dict.fromkeys(("STRING", "UNSTRING"), {"OVERFLOW"}),
}


@dataclass
class Tok:
    t: str
    line: int
    member: str | None = None

    @property
    def up(self) -> str:
        return self.t if is_literal(self.t) else self.t.upper()


@dataclass
class Stmt:
    kind: str
    words: list[str]
    line: int
    branches: list = field(default_factory=list)
    member: str | None = None

    @property
    def text(self) -> str:
        return " ".join([self.kind, *self.words]).strip()

    def walk(self):
        yield self
        for _, _, body in self.branches:
            for s in body:
                yield from s.walk()


@dataclass
class Item:
    name: str
    level: int
    ordinal: int
    section: str
    picture: Picture
    parent: str | None = None
    file: str | None = None
    occurs: int = 0
    depending: str | None = None
    redefines: str | None = None
    value: str | None = None
    sync: bool = False
    separate: bool = False
    line: int = 0
    member: str | None = None
    group: bool = False
    above: int | None = None  # ordinal of the parent


@dataclass
class Paragraph:
    name: str
    section: str | None
    line: int
    body: list[Stmt]
    error: str | None = None
    declarative: bool = False


@dataclass
class Program:
    name: str
    form: str
    confidence: float
    items: list[Item] = field(default_factory=list)
    conditions: dict = field(default_factory=dict)  # NAME -> (parent, values, ranges, line)
    files: list[dict] = field(default_factory=list)
    paragraphs: list[Paragraph] = field(default_factory=list)
    copies: list[dict] = field(default_factory=list)
    flags: list[tuple] = field(default_factory=list)  # (paragraph, line, message)
    using: list[str] = field(default_factory=list)
    returning: str | None = None
    inside: str | None = None
    sections: list[str] = field(default_factory=list)
    handlers: list[tuple] = field(default_factory=list)  # (section, what)

    def item(self, name: str) -> Item | None:
        return next((i for i in self.items if i.name == name), None)

    def leaves(self, name: str) -> list[Item]:
        top = self.item(name)
        if top is None:
            return []
        below = {top.ordinal}
        out = []
        for i in self.items[top.ordinal + 1 :]:
            if i.above in below:
                below.add(i.ordinal)
                if not i.group and i.name != "FILLER":
                    out.append(i)
            elif i.level <= top.level:
                break
        return out


def toks(lines: list[Line]) -> list[Tok]:
    """Tokens; commas and semicolons separate nothing outside EXEC blocks and are dropped there."""
    out, embedded = [], False
    for ln in lines:
        at = 0
        while at < len(ln.text):
            m = TOKEN.match(ln.text, at)
            if not m or not m[0].strip():
                break
            at = m.end()
            t = m[m.lastgroup]
            if t.upper() in ("EXEC", "END-EXEC"):
                embedded = t.upper() == "EXEC"
            if embedded or t not in (",", ";"):
                out.append(Tok(t, ln.line, ln.member))
    return out


def parse_programs(text: str, members: dict[str, str] | None = None, source: str = "", form: str | None = None) -> list[Program]:
    """All programs of a source text, contained ones after their container."""
    detected, confidence, _ = detect_format(text)
    form = form or detected
    lines, copies = preprocess(text, {k.upper(): v for k, v in (members or {}).items()}, form)
    starts = [i for i, ln in enumerate(lines) if re.search(r"\bPROGRAM-ID\b", masked(ln.text), re.I)]
    out: list[Program] = []
    bounds = []
    for k, i in enumerate(starts):
        begin = i
        while begin and re.search(r"\b(IDENTIFICATION|ID)\s+DIVISION\b", lines[begin - 1].text, re.I):
            begin -= 1
        bounds.append(begin)
    open_: list[str] = []
    if not starts:
        bounds, starts = [0], [None]
    for k, begin in enumerate(bounds):
        end = bounds[k + 1] if k + 1 < len(bounds) else len(lines)
        part = lines[begin:end]
        name = source.upper() or "UNNAMED"
        if starts[k] is not None:
            head = " ".join(ln.text for ln in lines[starts[k] : starts[k] + 2])
            m = re.search(r"PROGRAM-ID\s*\.?\s*['\"]?([\w$#@-]+)", head, re.I)
            name = m[1].upper() if m else name
        body, closed = [], []
        for ln in part:
            m = re.match(r"\s*END\s+PROGRAM\s+['\"]?([\w$#@-]+)", ln.text, re.I)
            if m:
                closed.append(m[1].upper())
            else:
                body.append(ln)
        p = Program(name, form, confidence, inside=open_[-1] if open_ else None)
        p.copies = copies if k == 0 else []
        _divisions(p, body)
        out.append(p)
        open_.append(name)
        for c in closed:
            if c in open_:
                del open_[open_.index(c) :]
    return out


def _divisions(p: Program, lines: list[Line]) -> None:
    parts: dict[str, list[Line]] = {}
    now = "IDENTIFICATION"
    for ln in lines:
        m = re.match(r"\s*(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b(.*)", masked(ln.text), re.I)
        if m:
            now = m[1].upper()
            rest = ln.text[m.start(2) :]
            if now == "PROCEDURE":
                parts.setdefault("USING", []).append(Line(rest, ln.line, ln.member))
                parts["_open"] = [] if rest.rstrip().endswith(".") else [ln]
            continue
        if now == "PROCEDURE" and parts.get("_open"):
            parts["USING"].append(ln)
            if ln.text.rstrip().endswith("."):
                parts["_open"] = []
            continue
        parts.setdefault(now, []).append(ln)
    _file_control(p, parts.get("ENVIRONMENT", []))
    _data(p, parts.get("DATA", []))
    using = [t.up for t in toks(parts.get("USING", []))]
    if "RETURNING" in using:
        at = using.index("RETURNING")
        p.returning = using[at + 1] if at + 1 < len(using) else None
        using = using[:at]
    if "USING" in using:
        p.using = [t for t in using[using.index("USING") + 1 :] if t not in (".", "BY", "REFERENCE", "VALUE", "CONTENT")]
    _procedure(p, toks(parts.get("PROCEDURE", [])))


# environment and data


def entries(lines: list[Line]):
    """(text, line, member) of each entry that a period ends, quoted text intact."""
    text, line, member = "", None, None
    for ln in lines:
        at = 0
        m = masked(ln.text)
        for dot in re.finditer(r"\.(?=\s|$)", m):
            text += " " + ln.text[at : dot.start()]
            if text.strip():
                yield text.strip(), line or ln.line, member if line else ln.member
            text, line, member, at = "", None, None, dot.end()
        if ln.text[at:].strip():
            if line is None:
                line, member = ln.line, ln.member
            text += " " + ln.text[at:]
    if text.strip():
        yield text.strip(), line, member


def _file_control(p: Program, lines: list[Line]) -> None:
    for text, line, _ in entries(lines):
        m = re.search(r"\bSELECT\s+(?:OPTIONAL\s+)?([\w-]+)", text, re.I)
        if not m:
            continue

        def clause(pattern: str):
            x = re.search(pattern, text, re.I)
            return x[1].strip("'\"").upper() if x else None

        p.files.append({
            "file": m[1].upper(), "assign": clause(r"\bASSIGN\s+(?:TO\s+)?('[^']+'|\"[^\"]+\"|[\w$#@-]+)"), "organization": clause(r"\bORGANIZATION\s+(?:IS\s+)?([\w-]+)"),
            "access": clause(r"\bACCESS\s+(?:MODE\s+)?(?:IS\s+)?([\w-]+)"), "record_key": clause(r"\bRECORD\s+KEY\s+(?:IS\s+)?([\w-]+)"), "status_field": clause(r"\bSTATUS\s+(?:IS\s+)?([\w-]+)"), "line": line,
        })


def _values(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    found = re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^\s,]+", text)
    words = [x for x in found if x.upper() not in ("ARE", "IS", "ALL")]
    clean = lambda x: literal_text(x) if x[0] in "'\"" else {"ZERO": "0", "ZEROS": "0", "ZEROES": "0", "SPACE": "", "SPACES": ""}.get(x.upper(), x)
    vals, ranges, i = [], [], 0
    while i < len(words):
        if i + 2 < len(words) and words[i + 1].upper() in ("THRU", "THROUGH"):
            ranges.append((clean(words[i]), clean(words[i + 2])))
            i += 3
        else:
            vals.append(clean(words[i]))
            i += 1
    return vals, ranges


def _data(p: Program, lines: list[Line]) -> None:
    section, file, stack = "WORKING-STORAGE", None, []
    for text, line, member in entries(lines):
        m = re.fullmatch(r"([\w-]+)\s+SECTION", text, re.I)
        if m:
            section, file = m[1].upper(), None
            continue
        m = re.match(r"(FD|SD)\s+([\w-]+)", text, re.I)
        if m:
            file, stack = m[2].upper(), []
            continue
        m = re.match(r"(\d{1,2})(?:\s+([\w-]+))?", text)
        if not m:
            continue
        level, name = int(m[1]), (m[2] or "FILLER").upper()
        rest = text[m.end() :]
        if name in ("PIC", "PICTURE", "VALUE", "OCCURS", "REDEFINES", "USAGE"):
            name, rest = "FILLER", text[m.start(2) :]
        blind = masked(rest)
        value = None
        if v := re.search(r"\bVALUES?\b(?:\s+(?:IS|ARE))?\s+", blind, re.I):
            value = rest[v.end() :]
            if level != 88:
                one = re.match(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\S+", value)
                value, blind = one[0], blind[: v.start()] + " " * (v.end() - v.start() + one.end()) + blind[v.end() + one.end() :]
            else:
                blind = blind[: v.start()]
        if level == 88:
            parent = p.items[-1].name if p.items else None
            vals, ranges = _values(value or "")
            p.conditions[name] = (parent, vals, ranges, line)
            continue
        if level == 66:
            continue
        pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", blind, re.I)
        usage = re.search(r"\b(?:USAGE\s+(?:IS\s+)?)?(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|PACKED-DECIMAL|DISPLAY|INDEX|POINTER)(?![\w-])", re.sub(r"\bPIC(?:TURE)?\s+(?:IS\s+)?\S+", "", blind, flags=re.I), re.I)
        occurs = re.search(r"\bOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?", blind, re.I)
        depending = re.search(r"\bDEPENDING\s+(?:ON\s+)?([\w-]+)", blind, re.I)
        redefines = re.search(r"\bREDEFINES\s+([\w-]+)", blind, re.I)
        picture = parse_picture(pic[1] if pic else None, usage[1] if usage else "DISPLAY")
        if level in (1, 77):
            stack = []
        while stack and stack[-1].level >= level:
            stack.pop()
        item = Item(
            name, level, len(p.items), section, picture, stack[-1].name if stack else None, (file if section == "FILE" else None),
            int(occurs[2] or occurs[1]) if occurs else 0, depending[1].upper() if depending else None, redefines[1].upper() if redefines else None, value,
            bool(re.search(r"\bSYNC", blind, re.I)), bool(re.search(r"\bSEPARATE\b", blind, re.I)), line, member, not pic and level != 77 and not (usage and picture.bytes()), stack[-1].ordinal if stack else None,
        )
        if usage is None and stack and not item.group and stack[-1].picture.usage not in ("DISPLAY",):
            item.picture = parse_picture(pic[1] if pic else None, stack[-1].picture.usage)
        p.items.append(item)
        stack.append(item)
        indexed = re.search(r"\bINDEXED\s+(?:BY\s+)?([\w-]+)", blind, re.I)
        for ix in indexed.groups() if indexed else ():
            p.items.append(Item(ix.upper(), 77, len(p.items), "SYNTHETIC", Picture("numeric", 9, 0, True, 4, "INDEX"), line=line))
        if depending:
            p.flags.append((None, line, f"OCCURS DEPENDING ON: {name} is modelled at its greatest size"))
        if occurs and item.group:
            p.flags.append((None, line, f"OCCURS on the group {name} is not modelled as an array"))
        if redefines:
            other = p.item(redefines[1].upper())
            same = other is not None and (other.picture.category, other.picture.bytes()) == (picture.category, picture.bytes()) and other.picture.category != "group"
            p.flags.append((None, line, f"REDEFINES: {name} is an alias of {redefines[1].upper()}" if same else f"REDEFINES: bytes of {redefines[1].upper()} seen as {name} are not modelled"))


# procedure


class Body:
    def __init__(self, p: Program, ts: list[Tok]):
        self.p, self.t, self.i = p, ts, 0

    def up(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j].up if j < len(self.t) else ""

    def handler(self) -> tuple[str, int, bool] | None:
        """(kind, tokens, negated) of a handler phrase that starts here."""
        k, negated = 0, False
        if self.up(k) == "NOT":
            negated, k = True, 1
        if self.up(k) in ("AT", "ON"):
            k += 1
        w = self.up(k)
        if w == "END":
            return "END", k + 1, negated
        if w in ("EOP", "END-OF-PAGE"):
            return "EOP", k + 1, negated
        if w == "INVALID":
            return "INVALID", k + (2 if self.up(k + 1) == "KEY" else 1), negated
        if w == "SIZE" and self.up(k + 1) == "ERROR":
            return "SIZE", k + 2, negated
        if w in ("EXCEPTION", "OVERFLOW"):
            return w, k + 1, negated
        return None

    def ends(self) -> bool:
        w = self.up()
        return w in ("", ".", "ELSE", "WHEN") or w.startswith("END-") or w in VERBS or self.handler() is not None

    def take(self, stop=()) -> list[str]:
        """Words up to the next verb, end, handler or stop word."""
        out = []
        while not self.ends() and self.up() not in stop:
            out.append(self.t[self.i].t)
            self.i += 1
        return out

    def condition(self, stop=("THEN",)) -> list[str]:
        out = []
        while self.up() not in ("", ".", "ELSE", "WHEN", *stop) and not self.up().startswith("END-") and self.up() not in VERBS:
            out.append(self.t[self.i].t)
            self.i += 1
        return out

    def statements(self) -> list[Stmt]:
        out = []
        while True:
            w = self.up()
            if w in ("", ".", "ELSE", "WHEN") or w.startswith("END-") or self.handler():
                return out
            if w == "THEN":
                self.i += 1
                continue
            if w not in VERBS:
                raise ValueError(f"unexpected {w} at line {self.t[self.i].line}")
            out.append(self.statement())

    def end(self, word: str) -> None:
        if self.up() == word:
            self.i += 1

    def statement(self) -> Stmt:
        tok = self.t[self.i]
        kind = tok.up
        self.i += 1
        s = Stmt(kind, [], tok.line, member=tok.member)
        if kind == "IF":
            s.words = self.condition()
            self.end("THEN")
            s.branches.append(("THEN", s.words, self.statements()))
            if self.up() == "ELSE":
                self.i += 1
                s.branches.append(("ELSE", None, self.statements()))
            self.end("END-IF")
        elif kind == "EVALUATE":
            s.words = self.condition(())
            whens: list[list[str]] = []
            while self.up() == "WHEN":
                self.i += 1
                objects = self.condition(())
                whens.append(objects)
                if self.up() == "WHEN":
                    continue
                s.branches.append(("WHEN", whens, self.statements()))
                whens = []
            if whens:
                s.branches.append(("WHEN", whens, []))
            self.end("END-EVALUATE")
        elif kind == "PERFORM":
            self.perform(s)
        elif kind == "EXEC":
            while self.up() not in ("END-EXEC", ""):
                s.words.append(self.t[self.i].t)
                self.i += 1
            self.end("END-EXEC")
        elif kind == "SEARCH":
            s.words = self.take()
            self.handlers(s)
            while self.up() == "WHEN":
                self.i += 1
                cond = self.condition(())
                s.branches.append(("WHEN", [cond], self.statements()))
            self.end("END-SEARCH")
        elif kind == "NEXT":
            self.end("SENTENCE")
        elif kind == "EXIT":
            while self.up() in ("PROGRAM", "PARAGRAPH", "SECTION", "PERFORM", "CYCLE"):
                s.words.append(self.up())
                self.i += 1
        elif kind == "USE":
            while self.up() not in (".", ""):
                s.words.append(self.t[self.i].t)
                self.i += 1
        else:
            s.words = self.take()
            self.handlers(s)
            self.end(f"END-{kind}")
        return s

    def handlers(self, s: Stmt) -> None:
        while (h := self.handler()) and h[0] in OWNS.get(s.kind, ()):
            self.i += h[1]
            s.branches.append((("NOT " if h[2] else "") + h[0], None, self.statements()))

    def perform(self, s: Stmt) -> None:
        s.words = []
        first = self.up()
        named = first not in ("VARYING", "UNTIL", "WITH", "TEST", "") and first not in VERBS and self.up(1) != "TIMES" and not first.startswith("END-")
        if named:
            s.words.append(self.t[self.i].t)
            self.i += 1
            while self.up() in ("OF", "IN"):
                s.words += [self.t[self.i].t, self.t[self.i + 1].t]
                self.i += 2
            if self.up() in ("THRU", "THROUGH"):
                s.words += ["THRU", self.t[self.i + 1].t]
                self.i += 2
        if self.up(1) == "TIMES":
            s.words += [self.t[self.i].t, "TIMES"]
            self.i += 2
        while self.up() in ("WITH", "TEST", "UNTIL", "VARYING", "AFTER"):
            w = self.up()
            s.words.append(w)
            self.i += 1
            if w in ("WITH", "TEST"):
                if self.up() == "TEST":
                    s.words.append("TEST")
                    self.i += 1
                s.words.append(self.up())
                self.i += 1
            elif w == "UNTIL":
                s.words += self.condition(("AFTER",))
            else:
                while self.up() not in ("UNTIL", "", "."):
                    s.words.append(self.t[self.i].t)
                    self.i += 1
        if not named:
            s.branches.append(("BODY", None, self.statements()))
            self.end("END-PERFORM")


def _procedure(p: Program, ts: list[Tok]) -> None:
    """Cuts the token list at paragraph and section headers, then reads each body."""
    kept, within, inside = [], [], False
    for i, t in enumerate(ts):
        before = ts[i - 1].up if i else "."
        if t.up == "DECLARATIVES" or (t.up == "END" and i + 1 < len(ts) and ts[i + 1].up == "DECLARATIVES") or (t.t == "." and before == "DECLARATIVES"):
            inside = t.up == "DECLARATIVES" and before != "END" if t.up == "DECLARATIVES" else inside and t.up != "END"
            continue
        kept.append(t)
        within.append(inside)
    ts, heads, start, i = kept, [], True, 0  # heads: (index, name, is a section, in declaratives)
    while i < len(ts):
        t = ts[i]
        if start and not is_literal(t.t):
            nxt = ts[i + 1].up if i + 1 < len(ts) else ""
            if nxt == "SECTION" and t.up not in VERBS:
                heads.append((i, t.up, True, within[i]))
                while i < len(ts) and ts[i].t != ".":
                    i += 1
                i += 1
                continue
            if nxt == "." and t.up not in VERBS and not t.up.startswith("END-"):
                heads.append((i, t.up, False, within[i]))
                i += 2
                continue
        start = t.t == "."
        i += 1
    if not heads or heads[0][0] > 0:
        heads.insert(0, (-1, "MAIN", False, False))
    section, seen = None, {}
    for k, (at, name, is_section, decl) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(ts)
        if not decl and section is not None and not is_section and heads[k - 1][3]:
            section = None
        body_at = at + 1 if at < 0 else at + 2
        if is_section:
            section = name
            p.sections.append(name)
            while body_at < end and ts[body_at - 1].t != ".":
                body_at += 1
        body = ts[body_at if at >= 0 else 0 : end]
        if is_section and not body:
            p.paragraphs.append(Paragraph(name, name, ts[at].line, [], declarative=decl))
            continue
        label = name
        if not is_section and name in seen:
            label = f"{name}_OF_{section}" if section else f"{name}_{seen[name]}"
        seen[name] = seen.get(name, 0) + 1
        line = ts[max(at, 0)].line if ts else 0
        par = Paragraph(label, section, line, [], declarative=decl)
        reader = Body(p, body)
        try:
            while reader.i < len(body):
                if reader.up() == ".":
                    reader.i += 1
                    continue
                before = reader.i
                par.body += reader.statements()
                if reader.i == before:
                    raise ValueError(f"unexpected {reader.up()} at line {body[reader.i].line}")
        except (ValueError, IndexError) as e:
            par.body = [Stmt("OPAQUE", [t.t for t in body], line)]
            par.error = str(e)
            p.flags.append((label, line, f"paragraph did not parse: {e}"))
        for s in par.body:
            if s.kind == "USE":
                p.handlers.append((label if not section else section, " ".join(s.words)))
        p.paragraphs.append(par)
