"""Statements compiled to Catalyst columns: one row is one run of the statements.

A field NAME-X is the column name_x. Statements are verbs as text, or ("IF", condition, then, else), ("EVALUATE", subjects, whens, other),
("VARYING", field, from, by, until-limit, body) for loops whose bounds are literals. Assignments apply in order; branch conditions are taken
before their branch runs. What cannot be modelled raises NotModelled with the reason.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.language import Assign, NotModelled, Reader, parse_condition, parse_verb, split_at, tokens
from ..functions.picture import Picture, parse_picture


def column_name(field: str) -> str:
    return field.lower().replace("-", "_")


class Fields:
    """Declared fields: NAME -> PICTURE text, or (PICTURE, occurs). Condition names: NAME -> (parent, values, ranges)."""

    def __init__(self, fields: dict, conditions: dict | None = None):
        self.pictures: dict[str, Picture] = {}
        self.occurs: dict[str, int] = {}
        for name, spec in fields.items():
            pic, n = spec if isinstance(spec, tuple) else (spec, 0)
            self.pictures[name] = pic if isinstance(pic, Picture) else parse_picture(pic)
            if n:
                self.occurs[name] = n
        self.conditions = conditions or {}

    def first_values(self) -> dict:
        out = {}
        for name, (parent, vals, ranges) in self.conditions.items():
            v = vals[0] if vals else ranges[0][0]
            out[name] = (parent, ("num", Decimal(v)) if self.pictures[parent].numeric else ("str", v))
        return out


class Compiler:
    """Expression and condition trees as columns of a row of fields."""

    def __init__(self, fields: Fields, compat: bool = False, external: dict | None = None):
        self.fields, self.compat, self.external = fields, compat, external or {}

    def picture(self, tree) -> Picture | None:
        return self.fields.pictures.get(tree[1]) if tree[0] == "ref" else None

    def numeric(self, tree) -> bool:
        if tree[0] == "ref":
            p = self.picture(tree)
            if p is None:
                raise NotModelled(f"{tree[1]} is not declared")
            return p.numeric and tree[3] is None
        return tree[0] in ("num", "op", "neg")

    def reference(self, tree) -> Column:
        if self.picture(tree) is None:
            raise NotModelled(f"{tree[1]} is not declared")
        c = F.col(column_name(tree[1]))
        if tree[1] in self.fields.occurs:
            if len(tree[2]) != 1:
                raise NotModelled(f"{tree[1]} needs one subscript")
            c = V.element(c, self.number(tree[2][0]))
        if tree[3]:
            start, length = tree[3]
            c = F.substring(c, self.number(start).cast("int"), self.number(length).cast("int") if length else F.lit(1 << 30))
        return c

    def number(self, tree) -> Column:
        kind = tree[0]
        if kind == "num":
            return V.decimal_lit(tree[1])
        if kind == "neg":
            return -self.number(tree[1])
        if kind == "ref":
            if not self.numeric(tree):
                raise NotModelled(f"{tree[1]} is text in arithmetic")
            return self.reference(tree)
        if kind == "op":
            _, op, a, b = tree
            if op == "**":
                if b[0] != "num" or b[1] != b[1].to_integral_value():
                    raise NotModelled("only literal whole exponents are modelled")
                return V.whole_power(self.number(a), int(b[1]))
            x, y = self.number(a), self.number(b)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: V.divide(x, y)}[op]()
        raise NotModelled(f"{kind} in arithmetic")

    def shape(self, tree) -> V.Shape:
        """Bounds on the value of an expression, from the pictures of what it reads."""
        kind = tree[0]
        if kind == "num":
            e = max(0, -tree[1].as_tuple().exponent)
            return V.Shape(max(0, tree[1].adjusted() + 1), e, tree[1] >= 0)
        if kind == "neg":
            a = self.shape(tree[1])
            return V.Shape(a.whole, a.scale)
        if kind == "ref":
            p = self.picture(tree)
            return V.Shape(p.digits - p.scale, max(p.scale, 0), not p.signed)
        _, op, x, y = tree
        if op == "**":
            a, n = self.shape(x), int(y[1])
            return V.Shape(a.whole * n + 1, a.scale * n, a.nonnegative or n % 2 == 0)
        a, b = self.shape(x), self.shape(y)
        if op == "*":
            return V.Shape(a.whole + b.whole, a.scale + b.scale, a.nonnegative and b.nonnegative)
        if op == "/":
            return V.Shape(a.whole + b.scale, V.QUOTIENT, a.nonnegative and b.nonnegative)
        return V.Shape(max(a.whole, b.whole) + 1, max(a.scale, b.scale), op == "+" and a.nonnegative and b.nonnegative)

    def text(self, tree) -> Column:
        if tree[0] == "str":
            return F.lit(tree[1])
        if tree[0] == "num":
            return F.lit(format(tree[1], "f"))
        return self.reference(tree).cast("string")

    def value(self, a: Assign) -> Column:
        """What the target holds after the assignment."""
        p = self.picture(a.target)
        if p is None:
            raise NotModelled(f"{a.target[1]} is not declared")
        if a.target[3]:
            start, length = a.target[3]
            whole = self.reference((*a.target[:3], None))
            at, n = self.number(start).cast("int"), self.number(length).cast("int") if length else F.lit(p.length) - self.number(start).cast("int") + 1
            return F.overlay(whole, F.rpad(self.text(a.expr), n, " "), at, n)
        if not p.numeric:
            return V.store_text(self.text(a.expr), p.length)
        if a.expr[0] == "str":
            return V.store(V.decimal_lit(a.expr[1].strip() or "0"), p, a.rounded, self.compat)
        if a.expr[0] == "ref" and not self.numeric(a.expr):
            return V.store(F.coalesce(F.expr("NULL").cast("decimal(38,9)"), F.trim(self.reference(a.expr)).try_cast("decimal(38,9)"), F.lit(0).cast("decimal(38,9)")), p, a.rounded, self.compat)
        if a.expr[0] == "op" and a.expr[1] == "/" and not a.rounded and p.scale >= 0:
            whole = self.shape(a.expr)
            q = V.quotient(self.number(a.expr[2]), self.number(a.expr[3]), p.scale, whole.whole)
            return V.store(q, p, False, self.compat, V.Shape(whole.whole, p.scale, whole.nonnegative))
        if a.expr[0] == "op" and a.expr[1] == "/" and p.scale >= 0 and self.shape(a.expr).whole + p.scale < 18:
            # one digit more than the field has, cut, then rounded: half away from zero looks at that digit alone
            whole = self.shape(a.expr)
            q = V.quotient(self.number(a.expr[2]), self.number(a.expr[3]), p.scale + 1, whole.whole)
            return V.store(q, p, True, self.compat, V.Shape(whole.whole, p.scale + 1, whole.nonnegative))
        return V.store(self.number(a.expr), p, a.rounded, self.compat, self.shape(a.expr))

    def condition(self, tree) -> Column:
        kind = tree[0]
        if kind in ("and", "or"):
            a, b = self.condition(tree[1]), self.condition(tree[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.condition(tree[1])
        if kind == "rel":
            _, op, a, b = tree
            if self.numeric(a) or self.numeric(b):
                return V.OPERATORS[op](self._as_number(a), self._as_number(b))
            return V.compare_text(self.text(a), self.text(b), op)
        if kind == "class":
            return V.class_test(self.text(tree[1]), tree[2], self.compat)
        if kind == "sign":
            return V.sign_test(self.number(tree[1]), tree[2])
        if kind == "name":
            if tree[1] not in self.fields.conditions:
                raise NotModelled(f"{tree[1]} is no condition name")
            parent, vals, ranges = self.fields.conditions[tree[1]]
            return V.values_test(self.reference(("ref", parent, tree[2], None)), vals, ranges, self.fields.pictures[parent].numeric)
        if tree[1] in self.external:
            return self.external[tree[1]]
        raise NotModelled(f"condition is not modelled: {tree[1]}")

    def _as_number(self, tree) -> Column:
        if self.numeric(tree):
            return self.number(tree)
        if tree[0] == "str":
            return V.decimal_lit(tree[1].strip() or "0")
        return F.coalesce(F.trim(self.reference(tree)).try_cast("decimal(38,9)"), F.lit(0).cast("decimal(38,9)"))


def when_condition(subjects: list[str], objects: list[str], names=()) -> tuple:
    """One WHEN of an EVALUATE: objects against subjects, by position. ANY, THRU ranges, NOT, TRUE/FALSE subjects, partial relations."""
    out = None
    for subject, obj in zip(subjects, objects):
        s, o = subject.strip(), obj.strip()
        if o.upper() == "ANY":
            continue
        ts = tokens(o)
        if s.upper() in ("TRUE", "FALSE"):
            c = parse_condition(o, names)
            c = ("not", c) if s.upper() == "FALSE" else c
        else:
            negated = ts[0].upper() == "NOT" and (len(ts) > 1 and ts[1].upper() not in ("=", ">", "<", ">=", "<="))
            body = ts[1:] if negated else ts
            low, word, high = split_at(body, "THRU", "THROUGH")
            if word:
                a, b, x = Reader(low).expression(), Reader(high).expression(), Reader(s).expression()
                c = ("and", ("rel", ">=", x, a), ("rel", "<=", x, b))
            elif Reader(body)._operator():
                c = parse_condition([*tokens(s), *body], names)
            else:
                c = ("rel", "=", Reader(s).expression(), Reader(body).expression())
            c = ("not", c) if negated else c
        out = c if out is None else ("and", out, c)
    return out or ("rel", "=", ("num", Decimal(0)), ("num", Decimal(0)))


class RowProgram:
    def __init__(self, fields: dict, statements: list, conditions: dict | None = None, compat: bool = False, external: dict | None = None):
        self.fields = Fields(fields, conditions)
        self.compiler = Compiler(self.fields, compat, external)
        self.statements = statements
        self._n = 0

    def declare(self, df: DataFrame) -> DataFrame:
        """Adds fields that df lacks with their default first values, and stores those it has by their pictures."""
        out = {}
        for name, p in self.fields.pictures.items():
            c = column_name(name)
            if c not in df.columns:
                one = F.lit(0).cast(p.spark_type) if p.numeric else F.rpad(F.lit(""), p.length, " ")
                out[c] = F.array_repeat(one, self.fields.occurs[name]) if name in self.fields.occurs else one
        return df.withColumns(out) if out else df

    def apply(self, df: DataFrame) -> DataFrame:
        """Runs the statements on every row of df; its other columns pass through."""
        return self._run(self.declare(df), self.statements, None)

    def _temp(self) -> str:
        self._n += 1
        return f"__c{self._n}"

    def _run(self, df: DataFrame, statements: list, active: Column | None) -> DataFrame:
        for s in statements:
            if isinstance(s, tuple) and s[0] == "IF":
                df = self._branches(df, [(parse_condition(s[1], self.fields.conditions), s[2])], s[3] if len(s) > 3 else [], active)
            elif isinstance(s, tuple) and s[0] == "EVALUATE":
                subjects = [x.strip() for x in s[1].split(" ALSO ")]
                whens = []
                for objects, body in s[2]:
                    some = [when_condition(subjects, o.split(" ALSO "), self.fields.conditions) for o in ([objects] if isinstance(objects, str) else objects)]
                    c = some[0]
                    for other in some[1:]:  # stacked WHENs share the body
                        c = ("or", c, other)
                    whens.append((c, body))
                df = self._branches(df, whens, s[3] if len(s) > 3 else [], active)
            elif isinstance(s, tuple) and s[0] == "VARYING":
                _, name, start, by, last, body = s
                x = start
                while x <= last:
                    df = self._run(df, [f"MOVE {x} TO {name}", *body], active)
                    x += by
                df = self._run(df, [f"MOVE {x} TO {name}"], active)
            else:
                for a in parse_verb(s, self.fields.first_values(), self.fields.pictures):
                    if not isinstance(a, Assign):
                        raise NotModelled(f"not modelled on rows: {a.text}")
                    df = self._assign(df, a, active)
        return df

    def _branches(self, df: DataFrame, whens: list, other: list, active: Column | None) -> DataFrame:
        """First match wins: which branch runs is settled before any of them assigns."""
        choice = self._temp()
        pick = F.lit(len(whens))
        for k in range(len(whens) - 1, -1, -1):
            pick = F.when(self.compiler.condition(whens[k][0]), F.lit(k)).otherwise(pick)
        df = df.withColumn(choice, pick if active is None else F.when(active, pick).otherwise(F.lit(-1)))
        for k, body in enumerate([*(b for _, b in whens), other]):
            if body:
                df = self._run(df, body, F.col(choice) == k)
        return df.drop(choice)

    def _assign(self, df: DataFrame, a: Assign, active: Column | None) -> DataFrame:
        name = column_name(a.target[1])
        new = self.compiler.value(a)
        if a.target[1] in self.fields.occurs:
            if len(a.target[2]) != 1:
                raise NotModelled(f"{a.target[1]} needs one subscript")
            new = V.set_element(F.col(name), self.compiler.number(a.target[2][0]), new)
        return df.withColumn(name, new if active is None else F.when(active, new).otherwise(F.col(name)))


def as_field(c: Column, picture: str) -> Column:
    """A DOUBLE or other column taken into a field: through DECIMAL(15,2), then stored."""
    return V.store(c.cast("decimal(15,2)"), parse_picture(picture))
