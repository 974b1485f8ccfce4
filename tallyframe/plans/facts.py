"""From a parsed program to fact rows: one flat list of (fact, row) that Spark turns into typed tables. Pure Python."""

from __future__ import annotations

import re

from ..functions.language import Assign, is_literal, literal_text, parse_verb, references, show, split_at
from . import flow
from .machine import Code, untils, varied
from .parse import Program, Stmt

#: Spark schemas of the fact tables; `program` and `ordinal` come before.
SCHEMAS = {
    "program": "source string, form string, confidence double, inside string, using array<string>, returning string, parallel boolean",
    "data_item": "name string, level int, section string, parent string, above int, file string, member string, pic string, usage string, category string, digits int, scale int, signed boolean, occurs int, depending string, redefines string, value string, sync boolean, separate boolean, bytes int, is_group boolean, line int",
    "cond_name": "name string, of string, values array<string>, ranges array<struct<lo:string,hi:string>>, line int",
    "file_binding": "file string, assign string, organization string, access string, record_key string, status_field string, line int",
    "copybook": "member string, status string, via string, replacing boolean, line int",
    "paragraph": "name string, section string, line int, declarative boolean, parse_error string",
    "statement": "stmt_id int, parent_id int, branch string, paragraph string, kind string, text string, line int, member string",
    "assignment": "stmt_id int, paragraph string, verb string, target string, reads array<string>, literal string, expr string, rounded boolean, note string, line int",
    "condition": "stmt_id int, paragraph string, text string, tree string, modelled boolean, line int",
    "event": "event string, direction string, endpoint_type string, endpoint string, verb string, fields array<string>, params array<string>, dynamic boolean, stmt_id int, paragraph string, line int, text string",
    "sql_column": "table string, column string, host_var string, status string, stmt_id int, line int",
    "call": "target string, literal boolean, verb string, using array<string>, stmt_id int, paragraph string, line int",
    "edge": "source int, target int, kind string, guard string, negated boolean",
    "flow": "source int, target int, kind string, guard int, negated boolean, callee string",
    "flow_node": "node int, state int, stmt_id int, kind string, ends string, paragraph string, line int",
    "guard": "guard int, text string, flip boolean, kind string",
    "effect": "node int, place int, kind string, field string, reads array<string>, line int, weak boolean, event string",
    "state": "state int, kind string, paragraph string, line int",
    "lineage": "event string, direction string, field string, paragraph string, line int, changed_by_program boolean, changed_by array<int>, origins array<struct<event:string,maybe:boolean,resolved_by:string>>, conditions array<struct<guard:string,negated:boolean,kind:string>>, conditions_partial boolean",
    "business_step": "source int, target int, rule array<string>, partial boolean",
    "flag": "paragraph string, line int, message string",
}
RESPONSES = {"SQLCODE": "DB2", "SQLSTATE": "DB2", "SQLERRD": "DB2", "EIBRESP": "CICS", "EIBRESP2": "CICS"}
CICS_INPUTS = {"EIBCALEN", "EIBAID", "EIBTRNID", "EIBDATE", "EIBTIME", "EIBCPOSN"}


def top_split(text: str) -> list[str]:
    """Comma-separated parts outside parentheses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


class Facts:
    def __init__(self, p: Program, source: str, exec_texts: dict | None = None):
        self.p, self.rows, self.events_at = p, [], {}
        self.code = Code(p)
        self.raw = list(dict.fromkeys(self.code.raw))
        self.cursors: dict[str, tuple[str, list]] = {}
        self.ids: dict[int, int] = {}
        self.source = source
        self._fields = {i.name: i for i in reversed(p.items)}
        self._declared()
        self._statements()
        self._entry()

    def add(self, fact: str, **row) -> None:
        self.rows.append((fact, row))

    def _declared(self) -> None:
        p = self.p
        self.add("program", source=self.source, form=p.form, confidence=p.confidence, inside=p.inside, using=p.using, returning=p.returning, parallel=bool(p.handlers))
        for i in p.items:
            pic = i.picture
            self.add(
                "data_item", name=i.name, level=i.level, section=i.section, parent=i.parent, above=i.above, file=i.file, member=i.member, pic=pic.text or None, usage=pic.usage, category="group" if i.group else pic.category,
                digits=pic.digits, scale=pic.scale, signed=pic.signed, occurs=i.occurs, depending=i.depending, redefines=i.redefines, value=i.value, sync=i.sync, separate=i.separate,
                bytes=None if i.group else pic.bytes(i.separate), is_group=i.group, line=i.line,
            )
        for n, (of, vals, ranges, line) in p.conditions.items():
            self.add("cond_name", name=n, of=of, values=vals, ranges=[{"lo": a, "hi": b} for a, b in ranges], line=line)
        for f in p.files:
            self.add("file_binding", **f)
        for c in p.copies:
            self.add("copybook", **c)
        for q in p.paragraphs:
            self.add("paragraph", name=q.name, section=q.section, line=q.line, declarative=q.declarative, parse_error=q.error)

    def leaves(self, name: str) -> list[str]:
        i = self._fields.get(name)
        return [x.name for x in self.p.leaves(name)] if i is not None and i.group else [name]

    def expand(self, names) -> list[str]:
        out = []
        for n in names:
            for x in self.leaves(n):
                if x not in out:
                    out.append(x)
        return out

    def file_records(self, file: str) -> list[str]:
        return self.expand([i.name for i in self.p.items if i.file == file and i.level == 1])

    def _statements(self) -> None:
        n = 0

        def visit(body, parent, branch, para):
            nonlocal n
            for s in body:
                sid = n
                n += 1
                self.ids[id(s)] = sid
                self.add("statement", stmt_id=sid, parent_id=parent, branch=branch, paragraph=para, kind=s.kind, text=s.text, line=s.line, member=s.member)
                self._one(s, sid, para)
                for label, _, inner in s.branches:
                    visit(inner, sid, label, para)

        for q in self.p.paragraphs:
            visit(q.body, None, None, q.name)
        self.notes()

    def notes(self) -> None:
        for para, line, message in self.p.flags:
            self.add("flag", paragraph=para, line=line, message=message)
        for line, text in self.raw:
            self.add("flag", paragraph=None, line=line, message=f"condition is not modelled: {text}")
        for line, message in self.code.notes:
            self.add("flag", paragraph=None, line=line, message=message)

    def event(self, s: Stmt, sid: int, para: str, direction: str, kind: str, endpoint: str, verb: str, fields=(), params=(), dynamic=False) -> None:
        row = dict(event=f"{direction}.{kind.upper()}.{endpoint}", direction="input" if direction == "GET" else "output", endpoint_type=kind, endpoint=endpoint, verb=verb, fields=self.expand(fields), params=self.expand(params), dynamic=dynamic, stmt_id=sid, paragraph=para, line=s.line, text=s.text)
        self.events_at.setdefault(sid, []).append(row)
        self.add("event", **row)

    def _one(self, s: Stmt, sid: int, para: str) -> None:
        w = [x if is_literal(x) else x.upper() for x in s.words]
        k = s.kind
        for words in [s.words] if k == "IF" else untils(s.words) if k == "PERFORM" else []:
            tree = self.code.condition(words)
            self.add("condition", stmt_id=sid, paragraph=para, text=" ".join(words), tree=show(tree), modelled=tree[0] != "raw", line=s.line)
            for name in references(tree):
                if name in RESPONSES:
                    self.event(s, sid, para, "GET", "response", RESPONSES[name], "TEST", [name])
                elif name in CICS_INPUTS:
                    self.event(s, sid, para, "GET", "system", "CICS", "TEST", [name])
                else:
                    for f in self.p.files:
                        if f["status_field"] == name:
                            self.event(s, sid, para, "GET", "response", f["file"], "FILE STATUS", [name])
        for name, begin, step, _ in varied(s.words) if k == "PERFORM" else []:
            for tree in (begin, ("op", "+", ("ref", name, (), None), step)):
                literal = format(tree[1], "f") if tree[0] == "num" else None
                self.add("assignment", stmt_id=sid, paragraph=para, verb=k, target=name, reads=references(tree), literal=literal, expr=show(tree), rounded=False, note=None, line=s.line)
        for a in parse_verb([k, *s.words], self.code.firsts, self.code.pictures | self.code.groups) if k in ("MOVE", "COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "SET", "INITIALIZE") else []:
            if isinstance(a, Assign):
                literal = a.expr[1] if a.expr[0] == "str" else format(a.expr[1], "f") if a.expr[0] == "num" else None
                self.add("assignment", stmt_id=sid, paragraph=para, verb=k, target=a.target[1], reads=references(a.expr), literal=literal, expr=show(a.expr), rounded=a.rounded, note=a.note, line=s.line)
                p = self.code.pictures.get(a.target[1])
                if p is not None and not p.numeric and a.expr[0] == "op":
                    self.add("flag", paragraph=para, line=s.line, message=f"arithmetic writes {a.target[1]}, which is not numeric")
                if a.target[1] == "RETURN-CODE":
                    self.event(s, sid, para, "CREATE", "caller", "CALLER", "RETURN-CODE", references(a.expr))
            else:
                self.add("flag", paragraph=para, line=s.line, message=f"not modelled: {a.text}")
        if k in ("STRING", "UNSTRING", "INSPECT"):
            self.add("flag", paragraph=para, line=s.line, message=f"{k} is an opaque effect: its receivers are unchanged in a run")
        handler = getattr(self, f"_{k.lower()}", None)
        if handler and k not in ("IF",):
            handler(s, sid, para, w)

    def _read(self, s, sid, para, w):
        into = [w[w.index("INTO") + 1]] if "INTO" in w else []
        self.event(s, sid, para, "GET", "file", w[0], "READ", self.file_records(w[0]) + into)

    _return = _read

    def _write(self, s, sid, para, w):
        i = self._fields.get(w[0])
        source = [w[w.index("FROM") + 1]] if "FROM" in w else []
        self.event(s, sid, para, "CREATE", "file", i.file if i is not None and i.file else w[0], s.kind, [w[0], *source])

    _rewrite = _release = _write

    def _delete(self, s, sid, para, w):
        self.event(s, sid, para, "CREATE", "file", w[0], "DELETE", self.file_records(w[0]))

    def _sort(self, s, sid, para, w):
        for word, direction in (("USING", "GET"), ("GIVING", "CREATE")):
            if word in w:
                for f in w[w.index(word) + 1 :]:
                    if f in ("USING", "GIVING", "INPUT", "OUTPUT") or not any(f == x["file"] for x in self.p.files):
                        break
                    self.event(s, sid, para, direction, "file", f, s.kind, self.file_records(f))

    _merge = _sort

    def _display(self, s, sid, para, w):
        self.event(s, sid, para, "CREATE", "console", "SYSOUT", "DISPLAY", [x for x in w if not is_literal(x) and x in self._fields])

    def _accept(self, s, sid, para, w):
        if "FROM" in w and w[w.index("FROM") + 1] in ("DATE", "DAY", "TIME", "DAY-OF-WEEK"):
            self.event(s, sid, para, "GET", "system", w[w.index("FROM") + 1], "ACCEPT", [w[0]])
        else:
            self.event(s, sid, para, "GET", "console", "SYSIN", "ACCEPT", [w[0]])

    def _call(self, s, sid, para, w):
        literal = is_literal(w[0])
        target = literal_text(w[0]).strip().upper() if literal else w[0]
        main, _, back = split_at(w[1:], "RETURNING", "GIVING")
        args = [x for x in main if not is_literal(x) and x not in ("USING", "BY", "REFERENCE", "CONTENT", "VALUE") and x in self._fields]
        self.add("call", target=target, literal=literal, verb="CALL", using=args, stmt_id=sid, paragraph=para, line=s.line)
        self.event(s, sid, para, "CREATE", "program", target, "CALL", args, back[:1], not literal)

    def _exec(self, s, sid, para, w):
        text = re.sub(r"\s*([.,(=:])\s*|\s+(\))", lambda m: {",": ", ", "=": " = ", ":": " :"}.get(m[1], m[1]) if m[1] else m[2], " ".join(s.words))
        text = re.sub(r"\s+", " ", text).strip()
        up = text.upper()
        kind, _, rest = up.partition(" ")
        verb = rest.split(" ")[0] if rest else ""
        if kind == "SQL":
            self._sql(s, sid, para, rest, verb)
        elif kind == "CICS":
            self._cics(s, sid, para, rest, verb)
        elif kind == "DLI":
            if verb in ("GU", "GN", "GNP", "GHU", "GHN"):
                self.event(s, sid, para, "GET", "ims", "IMS-DB", f"DLI {verb}")
            elif verb in ("ISRT", "REPL", "DLET"):
                self.event(s, sid, para, "CREATE", "ims", "IMS-DB", f"DLI {verb}")

    def _columns(self, s, sid, table, columns, hosts, why=None) -> None:
        """Column against host variable by place, only where both lists have one length."""
        if why is None and len(columns) != len(hosts):
            why = f"{len(columns)} columns, {len(hosts)} host variables"
        if why:
            self.add("sql_column", table=table, column=None, host_var=None, status=f"refused: {why}", stmt_id=sid, line=s.line)
            return
        for c, h in zip(columns, hosts):
            self.add("sql_column", table=table, column=c, host_var=h, status="mapped" if c else "derived", stmt_id=sid, line=s.line)

    @staticmethod
    def _column(text: str) -> str | None:
        name = re.fullmatch(r"(?:[\w$#@]+\s*\.\s*)*([\w$#@]+)(?:\s+(?:AS\s+)?[\w$#@]+)?", text.strip())
        return name[1] if name else None

    def _sql(self, s, sid, para, up, verb) -> None:
        name = r"(?:[\w$#@]+\s*\.\s*)?([\w$#@]+)"
        hosts = re.findall(r":\s*([A-Z][\w-]*)", up)
        table = lambda p: (m[1] if (m := re.search(p + name, up)) else "<TABLE>")
        if verb == "DECLARE" and " CURSOR " in f" {up} ":
            cursor = re.match(r"DECLARE\s+([\w-]+)", up)[1]
            sel = re.search(r"\bSELECT\s+(.*?)\s+FROM\b", up)
            self.cursors[cursor] = (table(r"\bFROM\s+"), None if not sel or sel[1].strip() == "*" else [self._column(c) for c in top_split(sel[1])])
        elif verb in ("SELECT", "FETCH"):
            into = re.search(r"\bINTO\s+(.*?)(?=\bFROM\b|\bWHERE\b|$)", up)
            got = re.findall(r":\s*([A-Z][\w-]*)", into[1]) if into else []
            slots = [re.findall(r":\s*([A-Z][\w-]*)", x) for x in top_split(into[1])] if into else []
            if verb == "FETCH":
                cursor = re.match(r"FETCH\s+(?:NEXT\s+(?:FROM\s+)?)?([\w-]+)", up)[1]
                t, columns = self.cursors.get(cursor, (cursor, None))
                why = "the cursor's columns are not known" if columns is None else None
            else:
                t = table(r"\bFROM\s+")
                sel = re.search(r"\bSELECT\s+(?:DISTINCT\s+)?(.*?)\s+(?:INTO|FROM)\b", up)
                star = sel and sel[1].strip() == "*"
                columns, why = (None, "SELECT * names no columns") if star else ([self._column(c) for c in top_split(sel[1])] if sel else None, None if sel else "no column list")
            if why is None and any(len(x) > 1 for x in slots):
                why = "an indicator variable"
            self.event(s, sid, para, "GET", "db2", t, verb, got, [h for h in hosts if h not in got])
            self._columns(s, sid, t, columns or [], got, why)
            if why and "*" in why:
                self.add("flag", paragraph=para, line=s.line, message="SELECT *: the columns are not in the source")
        elif verb == "INSERT":
            t = table(r"\bINSERT\s+INTO\s+")
            self.event(s, sid, para, "CREATE", "db2", t, verb, hosts)
            m = re.search(r"INTO\s+[\w$#@.\s]+?\(([^)]*)\)\s*VALUES\s*\((.*)\)", up)
            if m:
                vals = [re.fullmatch(r":\s*([A-Z][\w-]*)", x) for x in top_split(m[2])]
                pairs = [(self._column(c), v[1]) for c, v in zip(top_split(m[1]), vals) if v] if len(vals) == len(top_split(m[1])) else []
                self._columns(s, sid, t, [c for c, _ in pairs], [h for _, h in pairs])
        elif verb == "UPDATE":
            t = table(r"\bUPDATE\s+")
            sets = re.search(r"\bSET\s+(.*?)(?=\bWHERE\b|$)", up)
            pairs = [m.groups() for x in top_split(sets[1] if sets else "") if (m := re.fullmatch(r"(?:[\w$#@]+\s*\.\s*)?([\w$#@]+)\s*=\s*:\s*([A-Z][\w-]*)", x))]
            self.event(s, sid, para, "CREATE", "db2", t, verb, [h for _, h in pairs], [h for h in hosts if h not in [x for _, x in pairs]])
            self._columns(s, sid, t, [c for c, _ in pairs], [h for _, h in pairs])
        elif verb == "DELETE":
            self.event(s, sid, para, "CREATE", "db2", table(r"\bFROM\s+"), verb, hosts)
        elif verb in ("PREPARE", "EXECUTE"):
            for d in ("GET", "CREATE"):
                self.event(s, sid, para, d, "db2", "<dynamic-sql>", verb, hosts, dynamic=True)
            self.add("flag", paragraph=para, line=s.line, message="dynamic SQL: operation and tables are only known at run time")
        elif verb == "WHENEVER":
            self.add("flag", paragraph=para, line=s.line, message="WHENEVER registers a transfer that is not seen at each statement")

    def _cics(self, s, sid, para, up, verb) -> None:
        opts = {m[1]: (m[2] or "").strip() for m in re.finditer(r"\b([A-Z]+)\s*\(\s*('[^']*'|[\w.$#@-]+)\s*\)", up)}
        word = lambda k: opts[k].strip("'") if k in opts else None
        one = lambda *ks: next((word(k) for k in ks if word(k)), None)
        dynamic = lambda *ks: any(k in opts and not opts[k].startswith("'") for k in ks)
        some = lambda k: [word(k)] if word(k) and not opts[k].startswith("'") else []
        ev = lambda d, kind, ep, fields=(), params=(), ks=(): self.event(s, sid, para, d, kind, ep, f"CICS {verb}", fields, params, dynamic(*ks))
        if verb in ("LINK", "XCTL"):
            target = word("PROGRAM") or "<program>"
            self.add("call", target=target.upper(), literal=not dynamic("PROGRAM"), verb=f"CICS {verb}", using=some("COMMAREA"), stmt_id=sid, paragraph=para, line=s.line)
            ev("CREATE", "program", target, some("COMMAREA"), ks=("PROGRAM",))
        elif verb == "RETURN":
            ev("CREATE", "caller", "CALLER", some("COMMAREA"))
        elif verb == "SEND":
            ev("CREATE", "terminal", one("MAP", "MAPSET") or "TERMINAL", some("FROM"), ks=("MAP", "MAPSET"))
        elif verb == "RECEIVE":
            ev("GET", "terminal", one("MAP", "MAPSET") or "TERMINAL", some("INTO"), ks=("MAP", "MAPSET"))
        elif verb in ("READ", "READNEXT", "READPREV", "STARTBR", "RESETBR"):
            f = one("FILE", "DATASET") or "<file>"
            ev("GET", "file", f, [] if verb.endswith("BR") else some("INTO") or self.file_records(f), some("RIDFLD"), ("FILE", "DATASET"))
        elif verb in ("WRITE", "REWRITE", "DELETE"):
            ev("CREATE", "file", one("FILE", "DATASET") or "<file>", some("FROM"), some("RIDFLD"), ("FILE", "DATASET"))
        elif verb in ("READQ", "WRITEQ", "DELETEQ"):
            ev("GET" if verb == "READQ" else "CREATE", "queue", one("QUEUE", "QNAME") or "<queue>", some("INTO") if verb == "READQ" else some("FROM"), ks=("QUEUE", "QNAME"))
        elif verb == "START":
            ev("CREATE", "transaction", word("TRANSID") or "<transid>", some("FROM"), ks=("TRANSID",))
        elif verb == "RETRIEVE":
            ev("GET", "transaction", "RETRIEVE", some("INTO"))
        elif verb == "ABEND":
            ev("CREATE", "condition", word("ABCODE") or "ABEND")
        elif verb == "HANDLE":
            self.add("flag", paragraph=para, line=s.line, message="CICS HANDLE registers handlers that run outside the main flow")

    def _entry(self) -> None:
        linkage = [i.name for i in self.p.items if i.section == "LINKAGE" and i.level in (1, 77)]
        if linkage:
            s = Stmt("PROCEDURE", ["DIVISION", "USING", *self.p.using], self.p.paragraphs[0].line if self.p.paragraphs else 0)
            para = self.p.paragraphs[0].name if self.p.paragraphs else None
            self.event(s, -1, para, "GET", "caller", "CALLER", "USING", linkage)
            fields = set(self.expand(linkage))
            written = []
            for fact, row in self.rows:
                if fact == "assignment" and row["target"] in fields and row["target"] not in written:
                    written.append(row["target"])
            if written:
                self.event(s, -2, para, "CREATE", "caller", "CALLER", "RETURN", written)


def program_facts(p: Program, source: str) -> list[tuple[str, dict]]:
    """All fact rows of a program, with its flow facts."""
    f = Facts(p, source)
    for fact, row in flow.analyse(f):
        f.add(fact, **row)
    return f.rows
