"""Composite keys: unique ids, mapping keys, and the order id at the head of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import clean_text, field


def _double_text(c: Column) -> Column:
    """Text of a double with at least one decimal and no exponent (``10000000000.0``).

    Magnitudes outside 1e-4 ... 1e16 keep Spark's scientific text.
    """
    digits = c.cast(T.DecimalType(38, 20)).cast("string")
    size = F.abs(c)
    in_range = (size < 1e16) & ((size >= 1e-4) | (size == 0))
    plain = F.regexp_replace(digits, r"(\.\d+?)0*$", "$1")
    return F.when(in_range, plain).otherwise(c.cast("string"))


def _timestamp_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with six decimals when there is a fraction."""
    text = c.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def key_text(c: Column, kind: T.DataType) -> Column:
    """Text of one key part by its type, trimmed; an empty text counts as absent."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double_text(c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp_text(c)
    if isinstance(kind, (T.NumericType, T.DateType)):
        return c.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(c, lambda v: key_text(v, kind.elementType)), "_")
    elif isinstance(kind, T.StructType):
        names = sorted(kind.fieldNames())
        text = F.to_json(F.struct(*[c.getField(n).alias(n) for n in names]))
    elif isinstance(kind, T.MapType):
        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    else:
        text = c.cast("string")
    return clean_text(text)


def _joined(df: DataFrame, fields: Sequence[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [
        key_text(field(n), types[n]) if n in types else F.lit(None).cast("string") for n in fields
    ]
    # concat gives null as soon as one part is null
    joined = [parts[0]]
    for part in parts[1:]:
        joined += [F.lit("_"), part]
    return F.concat(*joined) if len(joined) > 1 else joined[0]


def unique_id(df: DataFrame, fields: Sequence[str]) -> Column:
    """Trimmed values joined by ``_``; null when a part is absent or no field is given."""
    return _joined(df, fields) if fields else F.lit(None).cast("string")


def mapping_key(df: DataFrame, fields: Sequence[str], row_id: str | None = None) -> Column:
    """Key that joins sources.  Without fields: the ``unique_id`` column, else the row id."""
    if fields:
        return _joined(df, fields)
    types = {f.name: f.dataType for f in df.schema.fields}
    fallback = [key_text(field(n), types[n]) for n in ("unique_id", row_id) if n in types]
    return F.coalesce(*fallback) if fallback else F.lit(None).cast("string")


def key_head(key: Column) -> Column:
    """Order id at the head of a key: the text before the first ``_``; null without one."""
    head = F.nullif(F.substring_index(key, "_", 1), F.lit(""))
    return F.when(F.contains(key, F.lit("_")), head)


def integral_fields(df: DataFrame, fields: Sequence[str]) -> bool:
    """True when every key field is a whole-number column.

    Joined by ``_`` such values give equal texts exactly when the numbers are equal, so sources can
    be joined on the numbers themselves: narrower shuffle rows, and a source already aggregated
    on its key column is not shuffled again.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return bool(fields) and all(isinstance(types.get(n), whole) for n in fields)
