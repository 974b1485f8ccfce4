"""PICTURE clauses: category, digits, scale, Spark type and storage size. Pure Python."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_DOWN, ROUND_HALF_UP, Context, Decimal

#: Exact arithmetic of the ordered paths.
WIDE = Context(prec=80)
_REPEAT = re.compile(r"(.)\((\d+)\)")


@dataclass(frozen=True)
class Picture:
    """What a PICTURE and USAGE say about an elementary item. scale < 0: trailing P positions."""

    category: str = "group"
    digits: int = 0
    scale: int = 0
    signed: bool = False
    length: int = 0
    usage: str = "DISPLAY"
    text: str = ""

    @property
    def numeric(self) -> bool:
        return self.category in ("numeric", "numeric-edited")

    @property
    def precision(self) -> int:
        """Digits of the Spark decimal: trailing P positions are stored as zeros, leading ones as scale."""
        return max(self.digits - min(self.scale, 0), self.scale, 1)

    @property
    def spark_type(self) -> str:
        if self.usage == "COMP-1":
            return "float"
        if self.usage == "COMP-2":
            return "double"
        if self.usage in ("INDEX", "POINTER"):
            return "int"
        return f"decimal({self.precision},{max(self.scale, 0)})" if self.numeric else "string"

    def bytes(self, sign_separate: bool = False) -> int | None:
        """Storage size of one item; None for a group, whose size is that of its parts."""
        fixed = {"COMP-1": 4, "COMP-2": 8, "INDEX": 4, "POINTER": 4}
        if self.usage in fixed:
            return fixed[self.usage]
        if self.category == "group":
            return None
        if self.usage == "COMP-3":
            return self.digits // 2 + 1
        if self.usage in ("COMP", "COMP-4", "COMP-5", "BINARY"):
            return 2 if self.digits <= 4 else 4 if self.digits <= 9 else 8
        return self.length + (1 if self.signed and sign_separate and self.category == "numeric" else 0)


USAGES = {
    "COMPUTATIONAL": "COMP", "COMPUTATIONAL-1": "COMP-1", "COMPUTATIONAL-2": "COMP-2", "COMPUTATIONAL-3": "COMP-3", "COMPUTATIONAL-4": "COMP-4",
    "COMPUTATIONAL-5": "COMP-5", "PACKED-DECIMAL": "COMP-3", "BINARY": "COMP", "COMP": "COMP", "COMP-1": "COMP-1", "COMP-2": "COMP-2", "COMP-3": "COMP-3",
    "COMP-4": "COMP-4", "COMP-5": "COMP-5", "DISPLAY": "DISPLAY", "INDEX": "INDEX", "POINTER": "POINTER",
}


def parse_picture(text: str | None, usage: str = "DISPLAY") -> Picture:
    """Reads a PICTURE string such as S9(7)V99, X(20), ZZ9.99, 9(3)PPP."""
    usage = USAGES.get(usage.upper(), usage.upper())
    if not text:
        return Picture(usage=usage)
    p = text.upper().rstrip(".")
    while m := _REPEAT.search(p):
        p = p[: m.start()] + m[1] * int(m[2]) + p[m.end() :]
    shown = len(re.sub(r"[SVP]", "", p))
    signed = p.startswith("S") or bool(re.search(r"[+-]|CR|DB", p))
    if re.search(r"[XA]", p):
        if set(p) <= {"A"}:
            category = "alphabetic"
        else:
            category = "alphanumeric-edited" if re.search(r"[B0/]", p) else "alphanumeric"
        return Picture(category, 0, 0, False, len(p), usage, text)
    edited = bool(re.search(r"[Z*$,./B+\-]|CR|DB|0", p))
    places = re.sub(r"CR|DB", "", p)
    if "V" in places:
        whole, _, part = places.partition("V")
    elif "." in places:
        whole, _, part = places.partition(".")
    else:
        whole, part = places, ""
    floats = "".join(c for c in "$+-" if whole.count(c) > 1)

    def count(side: str) -> int:
        n = len(re.findall(r"[9Z*]", side))
        return n + sum(side.count(c) - (1 if side is whole else 0) for c in floats if c in side)

    digits, scale = count(whole) + count(part), count(part)
    lead = re.match(r"S?V?(P+)", p)
    trail = re.search(r"9(P+)$", p)
    if lead:
        scale = digits + len(lead[1])
    elif trail and "V" not in p:
        scale = -len(trail[1])
    return Picture("numeric-edited" if edited else "numeric", digits, scale, signed, shown, usage, text)


def to_number(value) -> Decimal:
    """A stored value as a number; blank or unreadable text is 0."""
    if isinstance(value, Decimal):
        return value
    if value is None:
        return Decimal(0)
    m = re.fullmatch(r"\s*([+-]?\d*\.?\d*)\s*", str(value))
    return Decimal(m[1]) if m and re.search(r"\d", m[1]) else Decimal(0)


def store_value(value, picture: Picture, rounded: bool = False, compat: bool = False):
    """What a field holds after value is moved to it: the rules of one MOVE, on Python values.

    Numbers are cut (or rounded half away from zero) to the field's scale, lose their sign if the field has none, and keep their low-order
    digits. compat leaves high-order digits alone where digits = scale. Text is cut or padded on the right.
    """
    if not picture.numeric:
        text = str(value) if not isinstance(value, Decimal) else format(value, "f")
        return text[: picture.length].ljust(picture.length) if picture.length else text
    step = Decimal(1).scaleb(-picture.scale)
    units = WIDE.divide(to_number(value), step).to_integral_value(ROUND_HALF_UP if rounded else ROUND_DOWN)
    if not picture.signed:
        units = abs(units)
    if not (compat and picture.digits == picture.scale):
        units = WIDE.remainder(units, Decimal(10) ** picture.digits)
    out = WIDE.multiply(units, step)
    return out.quantize(Decimal(1).scaleb(-max(picture.scale, 0)), context=WIDE)


def initial_value(picture: Picture, value: str | None):
    """VALUE clause text (or None) as the field's first value: exact decimal or text, by default 0 or ''."""
    words = {"ZERO": "0", "ZEROS": "0", "ZEROES": "0", "SPACE": "", "SPACES": ""}
    if value is not None:
        raw = value.strip()
        raw = words.get(raw.upper(), raw)
        if raw[:1] in "'\"" and len(raw) > 1:
            raw = raw[1:-1]
        return to_number(raw) if picture.numeric else raw
    return Decimal(0) if picture.numeric else ""
