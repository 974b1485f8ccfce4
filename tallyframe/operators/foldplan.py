"""Read loops of programs turned into aggregations, with a proof or a reason.

plan() looks for the two usual loops (READ inside the loop with AT END / NOT AT END, or a first READ before it and one at its end), checks that the loop
ends exactly at the end of the file, and that its body only adds to accumulators or keeps the last value, under conditions of the current record alone. apply()
says the loop as one aggregation; the conditions under which adding is associative are taken in the same aggregation, and totals of groups that fail them
are composed in order, by all tasks (scan.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.language import Assign, NotModelled, parse_condition, parse_verb, references
from ..functions.picture import Picture, to_number
from ..plans.machine import Code, Machine
from ..plans.parse import Program, Stmt, parse_programs
from . import scan
from .rowprogram import Compiler, Fields, column_name


@dataclass
class Step:
    target: str
    kind: str  # add, last
    value: tuple
    negative: bool
    rounded: bool
    guards: list = field(default_factory=list)  # (condition tree, negated)


@dataclass
class FoldPlan:
    program: Program
    file: str
    record: list[str]
    steps: list[Step]


def _loop(p: Program, code: Code) -> tuple[Stmt, list[Stmt], list[str], list[Stmt]]:
    """(READ, statements for each record, UNTIL words, statements around the loop)."""
    body = {q.name: q.body for q in p.paragraphs}
    main = p.paragraphs[0].body if p.paragraphs else []
    loops = [s for s in main if s.kind == "PERFORM" and "UNTIL" in [w.upper() for w in s.words] and "VARYING" not in [w.upper() for w in s.words]]
    if len(loops) != 1:
        raise NotModelled(f"{len(loops)} loops in the first paragraph")
    loop = loops[0]
    words = [w.upper() for w in loop.words]
    if "TEST" in words or "THRU" in words:
        raise NotModelled("TEST and THRU are not looked into")
    inner = next((b for label, _, b in loop.branches if label == "BODY"), None)
    if inner is None:
        inner = body.get(words[0])
        if inner is None:
            raise NotModelled(f"{words[0]} is no paragraph")
    until = loop.words[words.index("UNTIL") + 1 :]
    around = [s for s in main if s is not loop]
    before = main[: main.index(loop)]
    if len(inner) == 1 and inner[0].kind == "READ":
        read = inner[0]
        records = next((b for label, _, b in read.branches if label == "NOT END"), [])
        if any(s.kind == "READ" for s in before):
            raise NotModelled("a record is read before the loop and not used in it")
        return read, records, until, around
    if inner and inner[-1].kind == "READ" and any(s.kind == "READ" and s.words[0].upper() == inner[-1].words[0].upper() for s in before):
        if any(label == "NOT END" for label, _, _ in inner[-1].branches):
            raise NotModelled("work in both the loop and its READ")
        return inner[-1], inner[:-1], until, [s for s in around if s.kind != "READ"]
    raise NotModelled("the loop is none of the known forms")


def _flatten(tree: tuple, target: str) -> list[tuple[tuple, bool]] | None:
    """target + a + b - c as [(a, False), (b, False), (c, True)]; None if it is no such sum."""
    if tree[0] == "ref" and tree[1] == target and not tree[2]:
        return []
    if tree[0] == "op" and tree[1] in "+-":
        left = _flatten(tree[2], target)
        return None if left is None else [*left, (tree[3], tree[1] == "-")]
    return None


def plan(p: Program) -> FoldPlan:
    """The plan of a program's read loop; NotModelled says why there is none."""
    code = Code(p)
    read, body, until, _ = _loop(p, code)
    file = read.words[0].upper()
    if "INTO" in [w.upper() for w in read.words]:
        raise NotModelled("READ INTO")
    end = next((b for label, _, b in read.branches if label == "END"), [])
    test = parse_condition(until, code.conditions)
    if test[0] == "raw":
        raise NotModelled("the loop's condition cannot be read")
    m = Machine(code)
    if m.test(test):
        raise NotModelled("the loop may not start")
    for s in end:
        if s.kind not in ("MOVE", "SET"):
            raise NotModelled("AT END does more than set a switch")
        m.do(s)
    if not m.test(test):
        raise NotModelled("the end of the file does not end the loop")
    switches = set(references(test)) | {code.conditions[n][0] for n in references(test) if n in code.conditions}
    record = [x for i in p.items if i.file == file and i.level == 1 for x in ([y.name for y in p.leaves(i.name)] if i.group else [i.name])]
    steps: list[Step] = []

    def walk(statements: list[Stmt], guards: list) -> None:
        for s in statements:
            if s.kind == "IF":
                c = parse_condition(s.words, code.conditions)
                for (_, _, b), negated in zip(s.branches, (False, True)):
                    walk(b, [*guards, (c, negated)])
            elif s.kind == "CONTINUE":
                pass
            elif s.kind in ("ADD", "SUBTRACT", "COMPUTE", "MOVE") and not s.branches:
                for a in parse_verb([s.kind, *s.words], code.firsts, code.pictures):
                    if not isinstance(a, Assign) or a.target[2] or a.target[3]:
                        raise NotModelled(f"line {s.line}: {s.text}")
                    name = a.target[1]
                    terms = _flatten(a.expr, name)
                    if terms:
                        steps.extend(Step(name, "add", t, neg, a.rounded, list(guards)) for t, neg in terms)
                    elif s.kind == "MOVE" or name not in references(a.expr):
                        steps.append(Step(name, "last", a.expr, False, a.rounded, list(guards)))
                    else:
                        raise NotModelled(f"line {s.line}: {name} is computed from itself")
            else:
                raise NotModelled(f"line {s.line}: {s.kind} in the loop")

    walk(body, [])
    written = {s.target for s in steps}
    for s in steps:
        reads = set(references(s.value)) | {r for c, _ in s.guards for r in references(c)}
        reads |= {code.conditions[n][0] for n in reads if n in code.conditions}
        if reads & written:
            raise NotModelled(f"{s.target} depends on {sorted(reads & written)[0]}, which the loop writes")
        if s.target in switches or s.target in record or reads - set(record) - set(code.conditions):
            raise NotModelled(f"{s.target} depends on more than the record")
        if len({x.kind for x in steps if x.target == s.target}) > 1:
            raise NotModelled(f"{s.target} is both added to and replaced")
        if any(c[0] == "raw" for c, _ in s.guards):
            raise NotModelled("a condition in the loop cannot be read")
    if not steps:
        raise NotModelled("the loop changes nothing")
    return FoldPlan(p, file, record, steps)


def apply(fp: FoldPlan, records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the fields that the loop writes, for each group of records. Record columns are named as fields (amount_due is AMOUNT-DUE).

    order gives the records' order where a value is the last one, and for groups whose sums the order can change.
    """
    code = Code(fp.program)
    pictures = {n: code.pictures[n] for n in fp.record}
    compiler = Compiler(Fields(pictures, {n: (p, v, r) for n, (p, v, r, _) in code.conditions.items() if p in pictures}))
    known = [c for c in records.columns if c in (*keys, *order)]
    rows = records.select(*known, *(V.store(F.col(column_name(n)), p).alias(column_name(n)) for n, p in pictures.items() if column_name(n) in records.columns and column_name(n) not in known))
    start = code.initial()
    at = F.struct(*order)
    aggs, finish, checks = [], {}, {}
    for target in dict.fromkeys(s.target for s in fp.steps):
        p, name = code.pictures[target], column_name(target)
        mine = [s for s in fp.steps if s.target == target]
        if mine[0].kind == "last":
            live = [(_guard(compiler, s), _stored(compiler, s, p)) for s in mine]
            value, when = F.lit(None), F.lit(False)
            for g, v in live:  # the last statement that ran on a record holds
                value, when = F.when(g, v).otherwise(value), when | g
            aggs.append(F.max_by(value, F.when(when, at)).alias(f"{name}__v"))
            first = F.lit(start[target]).cast(p.spark_type) if p.numeric else F.rpad(F.lit(start[target]), p.length, " ")
            finish[name] = F.coalesce(F.col(f"{name}__v"), first)
            continue
        totals, lows, highs, sizes, exact, finer = [], [], [], [], [], False
        for s in mine:
            raw = compiler.number(s.value)
            shape = compiler.shape(s.value)
            finer |= shape.scale > p.scale
            raw = F.when(_guard(compiler, s), -raw if s.negative else raw)
            exact.append(scan.step(raw, p, max(shape.scale, 0), s.rounded))
            x = V.store(raw, Picture("numeric", 34, p.scale, True), s.rounded)
            x = F.coalesce(x, V.decimal_lit(0)).cast(f"decimal(34,{max(p.scale, 0)})")
            for out, agg in ((totals, F.sum(x)), (lows, F.min(x)), (highs, F.max(x)), (sizes, F.sum(F.abs(x)))):
                aggs.append(agg.alias(f"{name}__{len(aggs)}"))
                out.append(F.col(f"{name}__{len(aggs) - 1}"))
        first = V.decimal_lit(start[target])
        total = _sum(totals) + first
        low, high = F.least(*lows, first), F.greatest(*highs, first)
        size = _sum(sizes) + F.abs(first)
        finish[name] = V.store(total, p)
        one = low >= 0 if not p.signed else (low >= 0) | (high <= 0)
        checks[name] = one if finer else one | (F.lit(p.signed) & (size < V.power_of_ten(p.digits - p.scale))), p, F.array(*exact), start[target]
    sums = rows.groupBy(*keys).agg(*aggs)
    for name, (ok, p, exact, value) in checks.items():
        slow = rows.join(sums.where(~ok).select(*keys), _same(rows, sums, keys), "left_semi")
        first = int(to_number(value).scaleb(p.scale))
        ordered = scan.totals(slow, keys, order, exact, f"{name}__o", p, first).withColumnsRenamed({k: f"{k}__k" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in keys]
        sums = sums.join(ordered, reduce(and_, on), "left").drop(*(f"{k}__k" for k in keys))
        finish[name] = F.when(ok, finish[name]).otherwise(F.col(f"{name}__o"))
    return sums.select(*keys, *(c.alias(n) for n, c in finish.items()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _guard(compiler: Compiler, s: Step) -> Column:
    out = F.lit(True)
    for c, negated in s.guards:
        test = compiler.condition(c)
        out = out & (~test if negated else test)
    return out


def _stored(compiler: Compiler, s: Step, p: Picture) -> Column:
    if not p.numeric:
        return V.store_text(compiler.text(s.value), p.length)
    return V.store(compiler._as_number(s.value), p, s.rounded)


def run(source: str, records: DataFrame, keys: list[str], order: list[str], members: dict[str, str] | None = None) -> DataFrame:
    """A program's read loop over each group of records, as an aggregation."""
    return apply(plan(parse_programs(source, members)[0]), records, keys, order)
