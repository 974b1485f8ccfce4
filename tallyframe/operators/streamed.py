"""Groups of sorted rows as streams: what runs record by record holds one record at a time, not a group."""

from __future__ import annotations

from itertools import chain, groupby, islice

from pyspark.sql import types as T


def groups_of(batches, keys: int):
    """(key values, rows without them) of batches sorted by their first columns; a group need not fit in memory."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    same = lambda r: tuple("NaN" if x != x else x for x in r[:keys])  # noqa: E731  NaN is one key
    for _, group in groupby(rows, same):
        first = next(group)
        yield first[:keys], (r[keys:] for r in chain([first], group))


def arrow_schema(schema: str):
    """The Arrow schema of a Spark schema text; called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def batches_of(rows, kinds):
    """Record batches of at most 1,000 of the rows, of an Arrow schema."""
    import pyarrow as pa

    rows = iter(rows)
    while part := list(islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kinds)], schema=kinds)
