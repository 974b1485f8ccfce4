"""Numbers and text as bytes of a record: packed and binary numbers, zoned digits, Latin-1 text. Columns in both directions, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import values as V
from .picture import Picture, parse_picture

BINARY = ("COMP", "COMP-4", "COMP-5", "BINARY")
NEGATIVE = "pqrstuvwxy"  # the last digit of a negative zoned number


def encode(x: Column, p: Picture) -> Column:
    """x as the bytes of a field; null is zero or spaces. Text beyond Latin-1 raises."""
    if not p.numeric:
        return F.encode(V.store_text(F.coalesce(x, F.lit("")), p.length), "ISO-8859-1")
    units = (V.store(F.coalesce(x, V.decimal_lit(0)), p) * V.power_of_ten(p.scale)).cast("decimal(38,0)")
    size = p.bytes()
    if p.usage == "COMP-3":
        sign = F.when(units < 0, "D").otherwise("C") if p.signed else F.lit("F")
        return F.unhex(F.concat(F.lpad(F.abs(units).cast("string"), 2 * size - 1, "0"), sign))
    if p.usage in BINARY:
        return F.unhex(F.substring(F.lpad(F.hex(units.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))
    text = F.lpad(F.abs(units).cast("string"), p.length, "0")
    if p.signed:
        last = F.translate(F.substring(text, p.length, 1), "0123456789", NEGATIVE)
        text = F.when(units < 0, F.concat(F.substring(text, 1, p.length - 1), last)).otherwise(text)
    return F.encode(text, "ISO-8859-1")


def decode(b: Column, p: Picture) -> Column:
    """The value of a field's bytes; null where they hold no number of the field."""
    if not p.numeric:
        return F.decode(b, "ISO-8859-1")
    h, size = F.hex(b), p.bytes()
    if p.usage == "COMP-3":
        units, sign = F.substring(h, 1, 2 * size - 1).try_cast("decimal(38,0)"), F.substring(h, 2 * size, 1)
        units = F.when(sign.isin("B", "D"), -units).when(sign.isin("A", "C", "E", "F"), units)
    elif p.usage in BINARY:
        units = F.conv(h, 16, 10).try_cast("decimal(38,0)")
        if p.signed:
            units = F.when(units >= V.decimal_lit(1 << 8 * size - 1), units - V.decimal_lit(1 << 8 * size)).otherwise(units)
    else:
        text = F.decode(b, "ISO-8859-1")
        units = F.translate(text, NEGATIVE, "0123456789").try_cast("decimal(38,0)")
        units = F.when(text.rlike(f"^[0-9]*[{NEGATIVE}]$"), -units).when(text.rlike(r"^[0-9]+$"), units)
    units = F.when(F.octet_length(b) == size, units)
    return (units.try_cast(f"decimal({max(p.digits, 1)},0)") * V.power_of_ten(-p.scale)).cast(p.spark_type)


class ByteLayout:
    """Records of fixed fields in bytes: (NAME, PICTURE, USAGE) in order."""

    def __init__(self, fields: list[tuple[str, str, str]]):
        self.fields, at = [], 1
        for name, picture, usage in fields:
            p = parse_picture(picture, usage)
            self.fields.append((name.lower().replace("-", "_"), p, at, p.bytes()))
            at += p.bytes()
        self.size = at - 1

    def record(self) -> Column:
        """The record of columns named as the fields."""
        return F.concat(*(encode(F.col(n), p) for n, p, _, _ in self.fields))

    def read(self, df: DataFrame, record: str, others: tuple = ()) -> DataFrame:
        """The fields of records. A text field at the end of a short record is what is left of it; a number that is cut off is null."""
        return df.select(*others, *(decode(F.substring(record, at, n), p).alias(name) for name, p, at, n in self.fields))
