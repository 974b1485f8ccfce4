"""Fixed-point storage, division and comparison as Spark columns. Everything stays in generated code.

Spark casts and divides with rounding half up, so nothing here casts to a smaller scale or divides before the value is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

from .picture import WIDE, Picture

#: Fraction digits of a quotient before it is stored.
QUOTIENT = 18


def decimal_lit(value: Decimal | str | int) -> Column:
    d = Decimal(value)
    exponent = d.as_tuple().exponent
    scale = max(0, -exponent)
    precision = max(len(d.as_tuple().digits) + max(exponent, 0), scale, 1)
    return F.lit(d.quantize(Decimal(1), context=WIDE) if exponent > 0 else d).cast(f"decimal({precision},{scale})")


def power_of_ten(n: int) -> Column:
    return decimal_lit(Decimal(1).scaleb(n)) if n >= 0 else decimal_lit(Decimal(1).scaleb(n))


def truncate(x: Column, scale: int, nonnegative: bool = False) -> Column:
    """x cut towards zero to `scale` fraction digits; a negative scale cuts whole tens."""
    low = F.floor(x, F.lit(scale))
    return low if nonnegative else F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(low)


@dataclass(frozen=True)
class Shape:
    """What is known of a value before it is computed: whole digits, fraction digits, and that it is not negative."""

    whole: int
    scale: int
    nonnegative: bool = False


def store(x: Column, picture: Picture, rounded: bool = False, compat: bool = False, shape: Shape | None = None) -> Column:
    """x as a field of this picture holds it: cut or rounded to scale, unsigned if it has no sign, low-order digits kept.

    Steps that the shape of x proves idle are left out.
    """
    if not picture.numeric:
        return store_text(x.cast("string"), picture.length)
    s, nonnegative = picture.scale, shape is not None and shape.nonnegative
    if shape is None or shape.scale > s:
        x = F.round(x, s) if rounded else truncate(x, s, nonnegative)
    if not picture.signed and not nonnegative:
        x = F.abs(x)
    if compat and picture.digits == s:
        return x.cast(f"decimal(38,{s})")
    if shape is None or shape.whole + (1 if rounded else 0) > picture.digits - s:
        x = x % power_of_ten(picture.digits - s)
    return x.cast(picture.spark_type)


def overflows(x: Column, picture: Picture, rounded: bool = False) -> Column:
    """ON SIZE ERROR: the value, cut or rounded to scale, has more digits than the field."""
    x = F.abs(x)
    x = F.round(x, picture.scale) if rounded else truncate(x, picture.scale, True)
    return x >= power_of_ten(picture.digits - picture.scale)


def store_text(x: Column, length: int) -> Column:
    """Left-justified, cut or padded with spaces."""
    return F.rpad(x, length, " ") if length else x


def divide(a: Column, b: Column) -> Column:
    """a / b cut to 18 fraction digits, exactly, from remainders. Operands have at most 18 digits; a zero divisor raises, as ANSI mode does."""
    r = a % b
    whole = ((a - r) / b).cast("decimal(19,0)")
    step = power_of_ten(QUOTIENT // 2)  # two halves, so that no product passes 38 digits
    n = r * step
    r1 = n % b
    high = ((n - r1) / b).cast("decimal(10,0)")
    n = r1 * step
    low = ((n - n % b) / b).cast("decimal(10,0)")
    part = (high * power_of_ten(-(QUOTIENT // 2)) + low * power_of_ten(-QUOTIENT)).cast(f"decimal({QUOTIENT + 1},{QUOTIENT})")
    return (whole + part).cast("decimal(38,18)")


def quotient(a: Column, b: Column, scale: int, whole: int = 99) -> Column:
    """a / b cut to `scale` fraction digits. With at most 18 digits in all (`whole` before the point) it is one integer division."""
    n = a * power_of_ten(scale)
    if whole + scale <= 18:
        return (F.call_function("div", n, b).cast("decimal(18,0)") * power_of_ten(-scale)).cast(f"decimal(19,{scale})")
    return (((n - n % b) / b).cast("decimal(38,0)") * power_of_ten(-scale)).cast(f"decimal(38,{scale})")


def whole_power(x: Column, exponent: int) -> Column:
    """x ** exponent for a whole exponent >= 0, by multiplication."""
    if exponent < 0:
        raise ValueError("only whole exponents >= 0 are modelled")
    out = decimal_lit(1)
    for _ in range(exponent):
        out = out * x
    return out


def compare_text(a: Column, b: Column, op: str) -> Column:
    """Text comparison with the shorter operand padded with spaces, in binary order."""
    n = F.greatest(F.length(a), F.length(b), F.lit(1))
    return OPERATORS[op](F.rpad(a, n, " "), F.rpad(b, n, " "))


OPERATORS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def class_test(x: Column, kind: str, compat: bool = False) -> Column:
    """IS NUMERIC / ALPHABETIC / ALPHABETIC-UPPER / ALPHABETIC-LOWER of a text. compat: blank text is numeric."""
    x = x.cast("string")
    if kind == "NUMERIC":
        digits = F.trim(x).rlike(r"^[+-]?[0-9]+$")
        return digits | (F.trim(x) == "") if compat else digits
    letters = {"ALPHABETIC": "A-Za-z", "ALPHABETIC-UPPER": "A-Z", "ALPHABETIC-LOWER": "a-z"}[kind]
    return x.rlike(rf"^[{letters} ]*$")


def sign_test(x: Column, kind: str) -> Column:
    return {"POSITIVE": x > 0, "NEGATIVE": x < 0, "ZERO": x == 0}[kind]


def values_test(x: Column, values: list, ranges: list, numeric: bool) -> Column:
    """A condition name: x is one of values or within one of the ranges."""
    out = F.lit(False)
    for v in values:
        out = out | (x == decimal_lit(v) if numeric else compare_text(x, F.lit(v), "="))
    for lo, hi in ranges:
        if numeric:
            out = out | x.between(decimal_lit(lo), decimal_lit(hi))
        else:
            out = out | (compare_text(x, F.lit(lo), ">=") & compare_text(x, F.lit(hi), "<="))
    return out


def element(array: Column, index: Column | int) -> Column:
    """1-based element; an index out of range raises in ANSI mode."""
    return F.element_at(array, F.lit(index).cast("int") if isinstance(index, int) else index.cast("int"))


def set_element(array: Column, index: Column | int, value: Column) -> Column:
    """array with its 1-based element replaced."""
    at = F.lit(index) if isinstance(index, int) else index.cast("int")
    return F.transform(array, lambda x, i: F.when(i == at - 1, value).otherwise(x))
