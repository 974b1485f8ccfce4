"""Programs driven by events: inbound records and ends of files per key, with the program's whole state kept between them.

A compiled program waits where data comes in: at a READ for a record or the end of the file, at ACCEPT, SELECT, FETCH, RECEIVE and their like for GET.<TYPE>.<ENDPOINT>, and, where
the program tests a subsystem's reply, for GET.RESPONSE.<SUBSYSTEM> after a statement to it. What goes out (WRITE, UPDATE, SEND, CALL ...) is published as it is met, and nothing waits for it. transformWithStateInPandas keeps one machine state for each stream key (pc, returns, context,
buffered records) in a ValueState; events of a key are applied in `seq` order, events that come early wait in the state, and gaps are reported. The
batch form runs the same machine over rows sorted by key, one after the other.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.streamed import arrow_schema, batches_of, groups_of
from ..functions.picture import to_number
from ..plans.facts import RESPONSES
from ..plans.machine import Code, Endless, Machine, Refused, drive
from ..plans.parse import Program, parse_programs

#: Inbound events: key, seq (from 1, without gaps), event (GET.FILE.f, END.FILE.f, GET.DB2.t, GET.RESPONSE.DB2 ...), fields.
EVENT = "key string, seq long, event string, fields map<string,string>"
OUTPUT = "key string, seq long, kind string, name string, value string"
OUTPUT_TYPE = T.StructType([T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in (c.split() for c in OUTPUT.split(", "))])
STATE_TYPE = T.StructType([T.StructField("body", T.StringType())])


def compile_reactive(source: str, members: dict[str, str] | None = None) -> Program:
    """The program, or Refused for what has no sequential event form: handler regions and paragraphs that perform themselves."""
    p = parse_programs(source, members)[0]
    if p.handlers:
        raise Refused("handler regions run beside the main flow")
    code = Code(p)
    calls: dict[str, set] = {}
    starts = sorted((pc, n) for n, pc in code.start.items() if n in code.marks)
    at = None
    names = dict((pc, n) for pc, n in starts)
    order = [n for _, n in starts]
    for pc, ins in enumerate(code.code):
        at = names.get(pc, at)
        if ins[0] == "perform":
            first = next((n for s, n in starts if s == ins[1]), None)
            last = ins[2].replace(" SECTION", "")
            upto = order[order.index(first) : order.index(last) + 1] if first and last in order and order.index(last) >= order.index(first) else [first]
            calls.setdefault(at, set()).update(x for x in upto if x)
    for n in calls:
        seen, todo = set(), list(calls[n])
        while todo:
            x = todo.pop()
            if x == n:
                raise Refused(f"{n} performs itself")
            if x not in seen:
                seen.add(x)
                todo += calls.get(x, ())
    return p


def manifest(p: Program) -> list[dict]:
    """Inbound and outbound events of a compiled program, with what orders them."""
    from ..plans.facts import Facts

    out = []
    for fact, row in Facts(p, p.name).rows:
        if fact == "event":
            out.append({"event": row["event"], "direction": row["direction"], "fields": row["fields"], "ordering": "by key and seq" if row["endpoint_type"] == "file" else None})
            if row["direction"] == "input" and row["endpoint_type"] == "file":
                out.append({"event": f"END.FILE.{row['endpoint']}", "direction": "input", "fields": [], "ordering": "after the last record"})
    return [dict(t) for t in dict.fromkeys(tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in r.items()) for r in out)]


class Crossings:
    """What each statement of a program takes in and gives out, in the order in which it is done: (kind, event, fields), kind in, out or reply."""

    def __init__(self, code: Code):
        from ..plans.facts import Facts

        facts = Facts(code.p, code.p.name)
        tested = {row["endpoint"] for fact, row in facts.rows if fact == "event" and row["endpoint_type"] == "response"}
        by_id = {sid: at for at, sid in facts.ids.items()}
        self.replies = {n for n, where in RESPONSES.items() if where in tested}
        self.at: dict[int, list[tuple[str, str, list]]] = {}
        for sid, rows in facts.events_at.items():
            steps = [("out", r["event"], r["fields"]) for r in rows if r["direction"] == "output" and r["endpoint_type"] != "console"]
            steps += [("in", r["event"], r["fields"]) for r in rows if r["direction"] == "input" and r["endpoint_type"] not in ("response", "caller", "system") and r["verb"] not in ("READ", "RETURN", "TEST")]
            used = {"db2": "DB2", "cics": "CICS"}
            asked = {"CICS" if r["verb"].startswith("CICS") else used.get(r["endpoint_type"]) for r in rows} & tested
            steps += [("reply", f"GET.RESPONSE.{where}", sorted(n for n, w in RESPONSES.items() if w == where)) for where in sorted(asked)]
            if steps:
                self.at[by_id[sid]] = steps


def _crossings(code: Code) -> Crossings:
    found = getattr(code, "_crossings", None)
    if found is None:
        found = code._crossings = Crossings(code)
    return found


def _take(m: Machine, fields: dict) -> None:
    """Stores arrived fields as a MOVE does; a field that did not come keeps what it held."""
    for name, v in fields.items():
        name = name.upper()
        if v is None:
            continue
        p = m.c.pictures.get(name)
        if p is not None and name not in m.c.occurs:
            m.let(("ref", name, (), None), to_number(v) if p.numeric else v)
        else:
            m.state["context"][name] = to_number(v) if name in RESPONSES else v


def _text(x):
    return format(x, "f") if isinstance(x, Decimal) else x


def _gate(m: Machine, crossings: Crossings, arrived: dict):
    """What Machine.run asks before a statement: publishes what it gives out, and waits for what it takes in."""
    st = m.state

    def gate(s):
        steps = crossings.at.get(id(s))
        if not steps or all(kind == "in" and fields and all(f in m.external for f in fields) for kind, _, fields in steps):
            return None
        n = st.get("crossed", 0)
        while n < len(steps):
            kind, event, fields = steps[n]
            if kind == "out":
                body = {f: [_text(x) for x in v] if isinstance(v, list) else _text(v) for f in fields if (v := st["context"].get(f)) is not None}
                st.setdefault("published", []).append([event, json.dumps(body)])
            elif kind == "reply" and st.get("replied"):
                pass
            elif event in arrived:
                got = arrived.pop(event)
                _take(m, got)
                st["replied"] = kind == "in" and bool({k.upper() for k in got} & crossings.replies)
            else:
                st["crossed"] = n
                return event
            n += 1
        st["crossed"], st["replied"] = 0, False
        return True

    return gate


def _dump(x):
    return {"#": format(x, "f")} if isinstance(x, Decimal) else x


def _load(d):
    return Decimal(d["#"]) if set(d) == {"#"} else d


def pack_state(state: dict, buffered: dict, nxt: int) -> str:
    keep = {k: v for k, v in state.items() if k != "cycles"} | {"cycles": []}
    return json.dumps({"state": keep, "buffered": buffered, "next": nxt}, default=_dump)


def unpack_state(text: str) -> tuple[dict, dict, int]:
    d = json.loads(text, object_hook=_load)
    return d["state"], {int(k): v for k, v in d["buffered"].items()}, d["next"]


def step(code: Code, saved: str | None, events: list[tuple[int, str, dict]], external: dict | None = None) -> tuple[str, list[tuple[int, str, str | None, str | None]]]:
    """Applies a batch of (seq, event, fields) to a saved state: the new state and output rows (seq, kind, name, value).

    Kinds: display, publish (an event that goes out, with its fields as JSON), done, gap (events wait for an earlier seq), ignored (nothing awaits the event or the program has
    ended), repeated. An END of anything but a file is the reply that there is no row: SQLCODE 100.
    """
    if saved is None:
        state, buffered, nxt = None, {}, 1
    else:
        state, buffered, nxt = unpack_state(saved)
    m = Machine(code, state, external, trace=False)
    out: list = []
    for seq, event, fields in events:
        if seq < nxt or seq in buffered:
            out.append((seq, "repeated", event, None))
        else:
            buffered[seq] = [event, dict(fields or {})]
    queue: dict[str, list] = {}
    arrived: dict[str, dict] = {}
    gate = _gate(m, _crossings(code), arrived)
    for name in _crossings(code).replies:
        m.state["context"].setdefault(name, Decimal(0))

    def tell(seq: int) -> None:
        if m.state["halted"] == "steps":
            raise Endless(f"{code.p.name} reads no record for too many steps after event {seq}")
        for text in m.state["display"]:
            out.append((seq, "display", None, text))
        m.state["display"] = []
        for event, body in m.state.get("published", ()):
            out.append((seq, "publish", event, body))
        m.state["published"] = []

    def finish(seq: int) -> None:
        if m.state["halted"]:
            for name, v in sorted(m.state["context"].items()):
                out.append((seq, "done", name, json.dumps([_text(x) for x in v]) if isinstance(v, list) else _text(v)))

    def next_record(file: str):
        q = queue.get(file)
        return q.pop(0) if q else None

    if saved is None:
        m.run(next_record, gate=gate)
        tell(0)
    while nxt in buffered:
        event, fields = buffered.pop(nxt)
        kind, _, rest = event.partition(".")
        file = rest.partition(".")[2].upper()
        wanted = f"GET.{rest}".upper()
        if not m.state["halted"] and m.state["waiting"] == wanted:
            arrived[wanted] = {"SQLCODE": "100"} if kind == "END" else dict(fields)
            m.run(next_record, gate=gate)
            tell(nxt)
            finish(nxt)
        elif m.state["halted"] or m.state["waiting"] != file:
            out.append((nxt, "ignored", event, f"waiting for {m.state['waiting']}" if not m.state["halted"] else "the program has ended"))
        else:
            # a field that did not come keeps what it held
            queue[file] = ["END" if kind == "END" else {k: v for k, v in fields.items() if v is not None}]
            m.run(next_record, gate=gate)
            tell(nxt)
            finish(nxt)
        nxt += 1
    if buffered:
        out.append((nxt, "gap", None, f"{len(buffered)} later events wait"))
    return pack_state(m.state, buffered, nxt), out


def _pandas(rows: list, key: str):
    import pandas as pd

    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame([(key, *r) for r in rows], columns=names)


def run_stream(events: DataFrame, source: str, members: dict[str, str] | None = None, external: dict | None = None) -> DataFrame:
    """A streaming DataFrame of EVENT rows through the program, one machine for each key; output rows as OUTPUT, append mode.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    from pyspark.sql.streaming import StatefulProcessor

    program = compile_reactive(source, members)

    class Reactor(StatefulProcessor):
        def init(self, handle):
            self.value = handle.getValueState("machine", STATE_TYPE)
            self.code = Code(program)

        def handleInputRows(self, key, rows, timers):
            events = []
            for pdf in rows:
                events += [(int(r.seq), r.event, dict(r.fields or {})) for r in pdf.itertuples()]
            saved = self.value.get()[0] if self.value.exists() else None
            state, out = step(self.code, saved, sorted(events, key=lambda e: e[0]), external)
            self.value.update((state,))
            yield _pandas(out, key[0])

        def close(self):
            pass

    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Reactor(), outputStructType=OUTPUT_TYPE, outputMode="append", timeMode="none")


def run_batch(events: DataFrame, source: str, members: dict[str, str] | None = None, external: dict | None = None) -> DataFrame:
    """The same over a static table of events."""
    program = compile_reactive(source, members)
    kinds = arrow_schema(OUTPUT)

    def run(batches):
        code = Code(program)

        def out():
            for (key,), rows in groups_of(batches, 1):
                for r in step(code, None, [(int(seq), event, dict(fields or {})) for seq, event, fields in rows], external)[1]:
                    yield (key, *r)

        yield from batches_of(out(), kinds)

    return events.select("key", "seq", "event", "fields").repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, OUTPUT)


def run_files(records: DataFrame, keys: list[str], order: list[str], file: str, source: str | None, out: dict[str, str], members: dict[str, str] | None = None, external: dict | None = None, program: Program | None = None) -> DataFrame:
    """Runs a program once for each group of records, read in order as `file`; record columns are fields (amount_due is AMOUNT-DUE).

    Returns the keys and the context fields named in `out` (NAME -> Spark type), and halted and steps; a program that loops without reading raises. A fold that is provably order-free is
    better said as an aggregation (operators.fold); this is the general form, and a group is one task's work.
    """
    program = program or parse_programs(source, members)[0]
    key_types = {f.name: f.dataType.simpleString() for f in records.schema if f.name in keys}
    fields = [c for c in records.columns if c not in keys and c not in order]
    names = {n: n.lower().replace("-", "_") for n in out}
    schema = ", ".join([*(f"`{k}` {key_types[k]}" for k in keys), *(f"`{names[n]}` {t}" for n, t in out.items()), "halted string", "steps long"])

    kinds, inputs = arrow_schema(schema), [c.upper().replace("_", "-") for c in fields]

    def run(batches):
        def out_rows():
            for key, rows in groups_of(batches, len(keys)):
                got = drive(program, {file: (dict(zip(inputs, r)) for r in rows)}, external, trace=False)
                if got["halted"] == "steps":
                    raise Endless(f"{program.name} reads no record for too many steps, in group {key}")
                values = [got["context"].get(n) for n in out]
                quant = [v.quantize(Decimal(1).scaleb(-int(t.split(",")[1].rstrip(")")))) if isinstance(v, Decimal) and t.startswith("decimal") else v for v, t in zip(values, out.values())]
                yield (*key, *quant, got["halted"], got["steps"])

        yield from batches_of(out_rows(), kinds)

    return records.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *fields).mapInArrow(run, schema)
