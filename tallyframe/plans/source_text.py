"""Program text to logical lines: source format, comments, continuation, COPY and REPLACE. Pure Python."""

from __future__ import annotations

import re
from dataclasses import dataclass

DIVISION = re.compile(r"\b(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b", re.I)
DIRECTIVE = re.compile(r"^\s*(?:>>\s*SOURCE|\$SET\s+SOURCEFORMAT)\b.*?\b(FREE|FIXED)\b", re.I)
#: Compiler options, only before the first division; they may start in column 1.
OPTIONS = re.compile(r"\s*(?:CBL|PROCESS)(?![\w-])", re.I)
#: Layout of the listing: only as a whole line.
LISTING = re.compile(r"\s*(?:(?:EJECT|SKIP[123])|TITLE\s+(?:'[^']*'|\"[^\"]*\"))\s*\.?\s*$", re.I)
#: Where a statement starts that brings in a member.
HEAD = re.compile(r"(?<![\w-])(?:(?P<copy>COPY)(?![\w-])|(?:\+\+INCLUDE|-INC)(?=\s)|(?P<sql>EXEC\s+SQL)(?![\w-]))", re.I)
NAME = r"(?:'([^']+)'|\"([^\"]+)\"|([\w$#@-]+))"
COPY = re.compile(rf"(?:COPY|\+\+INCLUDE|-INC)\s+{NAME}(?:\s+(?:OF|IN)\s+[\w$#@-]+)?", re.I)
SQL_INCLUDE = re.compile(rf"EXEC\s+SQL\s+INCLUDE\s+{NAME}\s*END-EXEC\s*\.?", re.I)
QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"")

#: What column 7 may hold in fixed format.
FIXED_MARKS = " */-Dd$"


@dataclass
class Line:
    text: str
    line: int
    member: str | None = None


PSEUDO = re.compile(rf"==.*?==|{QUOTED.pattern}", re.S)


def masked(text: str, pseudo: bool = False) -> str:
    """text with the insides of quoted literals, and of ==pseudo text== if asked for, blanked, of the same length."""
    return (PSEUDO if pseudo else QUOTED).sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], text)


def detect_format(text: str) -> tuple[str, float, str]:
    """(fixed | free, confidence, reason) from the strongest of five signals."""
    lines = [ln for ln in text.splitlines() if ln.strip()]
    for ln in lines[:50]:
        if m := DIRECTIVE.match(ln):
            return m[1].lower(), 1.0, "directive"
    marks = [ln[6:7] or " " for ln in lines]  # columns 1 to 6 hold numbers or change marks and say nothing
    bad = sum(c not in FIXED_MARKS for c in marks)
    if marks and not bad:
        return "fixed", 0.97, f"column 7 holds a mark or a space on all {len(marks)} lines"
    for ln in lines:
        m = DIVISION.search(ln)
        if m and (m.start() == 7 or m.start() < 4):
            return ("fixed" if m.start() == 7 else "free"), 0.95, "column of a division header"
    if any(len(ln.rstrip()) > 80 for ln in lines):
        return "free", 0.85, "a line is longer than 80 columns"
    part = bad / max(1, len(marks))
    if part >= 0.15:
        return "free", min(0.9, 0.6 + part), f"column 7 holds text on {bad} of {len(marks)} lines"
    return "fixed", 0.6 if bad else 0.7, "no sign of free format"


def logical_lines(text: str, form: str | None = None, member: str | None = None) -> list[Line]:
    """Code lines without comments; continued literals and words joined to the line they continue."""
    form = form or detect_format(text)[0]
    out: list[Line] = []
    inside = False  # a division has started
    for n, raw in enumerate(text.splitlines(), 1):
        raw = raw.expandtabs(8).rstrip("\r\n")
        if DIRECTIVE.match(raw) or (not inside and member is None and OPTIONS.match(raw)):
            continue
        inside = inside or bool(DIVISION.search(raw))
        if form == "fixed":
            mark, body = raw[6:7], raw[7:72]
            if mark in ("*", "/") or mark in ("D", "d"):
                continue
            if mark == "-" and out:
                prev = out[-1].text
                more = body.lstrip()
                m = masked(prev)
                open_quote = next((q for q in "'\"" if m.count(q) % 2), None)
                out[-1] = Line((prev.ljust(65) if open_quote else prev.rstrip()) + (more[1:] if open_quote and more[:1] == open_quote else more), out[-1].line, member)
                continue
        else:
            body = raw
            if body.lstrip().startswith("*") and not body.lstrip().startswith("*>"):
                continue
        cut = masked(body).find("*>")
        body = body if cut < 0 else body[:cut]
        if not body.strip() or LISTING.match(body) or (not inside and member is None and OPTIONS.match(body)):
            continue
        out.append(Line(body, n, member))
    return out


@dataclass
class Inclusion:
    """A COPY or INCLUDE: its member, the phrase after it, the text on its lines before and after it, and its last line."""

    member: str
    phrase: str
    before: str
    after: str
    last: int


def inclusion(lines: list[Line], i: int) -> Inclusion | None:
    """The first statement on line i that brings in a member, read up to its end, however many lines that takes."""
    for head in HEAD.finditer(masked(lines[i].text)):
        start, text, last = head.start(), lines[i].text, i
        if head["sql"]:
            while len(text[head.end() :].split()) < 2 and last + 1 < len(lines):
                last += 1
                text += " " + lines[last].text
            if not re.match(r"\s+INCLUDE\s", text[head.end() :], re.I):
                continue
            while not (found := SQL_INCLUDE.match(text, start)) and last + 1 < len(lines) and not re.search(r"END-EXEC", text[start:], re.I):
                last += 1
                text += " " + lines[last].text
            if found:
                return Inclusion(_named(found), "", text[:start], text[found.end() :], last)
            continue
        if head["copy"]:
            while (stop := masked(text, pseudo=True).find(".", head.end())) < 0 and last + 1 < len(lines):
                last += 1
                text += " " + lines[last].text
        else:  # these end with their line
            stop = len(text)
        found = COPY.match(text, start)
        if found:
            stop = stop if stop >= found.end() else len(text)
            return Inclusion(_named(found), text[found.end() : stop], text[:start], text[stop + 1 :], last)
    return None


def _named(found: re.Match) -> str:
    return next(g for g in found.groups() if g).upper()


def copy_members(text: str, form: str | None = None) -> list[str]:
    """Members that the text copies or includes, in order, each once."""
    lines, out, i = logical_lines(text, form), [], 0
    while i < len(lines):
        found = inclusion(lines, i)
        if found is None:
            i += 1
            continue
        if found.member not in out:
            out.append(found.member)
        i = found.last
        lines[i] = Line(found.after, lines[i].line, lines[i].member)
    return out


def _pseudo(text: str) -> list[tuple[str, str, str]]:
    """(operand, replacement, LEADING | TRAILING | "") of a REPLACING or REPLACE phrase: ==a== BY ==b==, or words and literals."""
    part = r"(==.*?==|'[^']*'|\"[^\"]*\"|[^\s=]+)"
    found = re.findall(rf"(?:\b(LEADING|TRAILING)\s+)?{part}\s+BY\s+{part}", text, re.I | re.S)
    clean = lambda s: s[2:-2].strip() if s.startswith("==") else s.strip()
    return [(clean(a), clean(b), kind.upper()) for kind, a, b in found]


def replaced(text: str, pairs: list[tuple]) -> str:
    """text with operands replaced in one pass from left to right: words outside literals, whole literals, and :TAG: parts inside words.

    A pair is (operand, replacement), and LEADING or TRAILING if only that part of a word is meant.
    """
    by, forms = {}, []
    for old, new, *kind in pairs:
        if not old:
            continue
        words = r"\s+".join(map(re.escape, old.split()))
        if old[0] in "'\"":
            form = f"(?-i:{words})(?!{old[0]})"
        elif (old.startswith(":") and old.endswith(":")) or old.startswith("("):
            form = words
        else:
            form = ("" if kind == ["TRAILING"] else r"(?<![\w-])") + words + ("" if kind == ["LEADING"] else r"(?![\w-])")
        by[f"p{len(forms)}"] = new
        forms.append(f"(?P<p{len(forms)}>{form})")
    if not forms:
        return text
    any_form = re.compile("|".join([*forms, QUOTED.pattern]), re.I)
    return any_form.sub(lambda m: by[m.lastgroup] if m.lastgroup else m[0], text)


def preprocess(text: str, members: dict[str, str], form: str | None = None) -> tuple[list[Line], list[dict]]:
    """Logical lines with copied members in place, and one row for each COPY: member, status, via, replacing, line.

    A member is read in the program's format unless it has a directive of its own: it is mostly too short to tell.
    """
    form = form or detect_format(text)[0]
    copies: list[dict] = []
    lines = _expand(logical_lines(text, form), members, (), copies, None, form)
    return _replace_statements(lines), copies


def member_format(text: str, form: str) -> str:
    """The format that a member is read in where the program's is `form`."""
    return next((m[1].lower() for ln in text.splitlines()[:50] if (m := DIRECTIVE.match(ln))), form)


def _expand(lines: list[Line], members: dict, active: tuple, copies: list, via: str | None, form: str) -> list[Line]:
    out, i, lines = [], 0, list(lines)
    while i < len(lines):
        ln, found = lines[i], inclusion(lines, i)
        if found is None:
            out.append(ln)
            i += 1
            continue
        name = found.member
        pairs = _pseudo(found.phrase) if re.search(r"\bREPLACING\b", found.phrase, re.I) else []
        status = "cycle" if name in active else "found" if name in members else "missing"
        copies.append({"member": name, "status": status, "via": via, "replacing": bool(pairs), "line": ln.line})
        if found.before.strip():
            out.append(Line(found.before, ln.line, ln.member))
        if status == "found":
            own = member_format(members[name], form)
            body = _expand(logical_lines(members[name], own, name), members, (*active, name), copies, name, own)
            out += [Line(replaced(x.text, pairs), x.line, x.member) for x in body]
        i = found.last
        lines[i] = Line(found.after, lines[i].line, lines[i].member)  # what follows may hold another one
        if not found.after.strip():
            i += 1
    return out


def _replace_statements(lines: list[Line]) -> list[Line]:
    """Applies REPLACE ... . and REPLACE OFF."""
    out, pairs, i = [], [], 0
    while i < len(lines):
        ln = lines[i]
        if re.match(r"\s*REPLACE(?![\w-])", ln.text, re.I):
            text = ln.text
            while "." not in masked(text, pseudo=True) and i + 1 < len(lines):
                i += 1
                text += " " + lines[i].text
            pairs = [] if re.match(r"\s*REPLACE\s+(?:LAST\s+)?OFF\b", text, re.I) else _pseudo(text)
        else:
            out.append(Line(replaced(ln.text, pairs), ln.line, ln.member) if pairs else ln)
        i += 1
    return out
