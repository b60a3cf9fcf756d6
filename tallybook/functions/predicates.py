"""Filter predicates with document-store rules, and value buckets."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.config import Bucket, Condition
from tallybook.functions.text import field


def _comparable(kind: T.DataType, value: Any) -> bool:
    """Whether a literal can equal or order against a column at all (no cross-type matches)."""
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, decimal.Decimal)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (dt.date, dt.datetime)):
        return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return False


def _literal(kind: T.DataType, value: Any) -> Column:
    if isinstance(value, (dt.date, dt.datetime)):
        return F.lit(str(value)).cast(kind)
    return F.lit(value)


def _equal(c: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if not _comparable(kind, value):
        return F.lit(False)
    return c == _literal(kind, value)


def _not_equal(c: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return c.isNotNull()
    if not _comparable(kind, value):
        return F.lit(True)
    return c.isNull() | (c != _literal(kind, value))


def _ordered(c: Column, kind: T.DataType, operator: str, value: Any) -> Column:
    if value is None:
        return c.isNull() if operator.endswith("_equal") else F.lit(False)
    if not _comparable(kind, value):
        return F.lit(False)
    other = _literal(kind, value)
    return {
        "greater_than": c > other,
        "less_than": c < other,
        "greater_equal": c >= other,
        "less_equal": c <= other,
    }[operator]


def _member(c: Column, kind: T.DataType, values: Sequence[Any]) -> Column:
    usable = [_literal(kind, v) for v in values if v is not None and _comparable(kind, v)]
    found = c.isin(*usable) if usable else F.lit(False)
    return (found | c.isNull()) if any(v is None for v in values) else found


def _absent(c: Column, kind: T.DataType, values: Sequence[Any]) -> Column:
    usable = [_literal(kind, v) for v in values if v is not None and _comparable(kind, v)]
    if any(v is None for v in values):
        return c.isNotNull() & ~c.isin(*usable) if usable else c.isNotNull()
    return (c.isNull() | ~c.isin(*usable)) if usable else F.lit(True)


def condition_filter(
    df: DataFrame, conditions: Iterable[Condition | Mapping[str, Any]]
) -> Column | None:
    """AND of the conditions as one predicate that can reach the scan; None when there is none.

    ``not_equal`` and ``not_in`` also keep nulls, an ordered comparison never does, a literal of
    another type than the column never matches, an absent column reads as null, and the last of
    several terms on the same column and operator wins.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    terms = {(c.column, c.operator): c for c in map(Condition.parse, conditions)}
    tests = []
    for (name, operator), term in terms.items():
        kind = types.get(name, T.NullType())
        c = field(name) if name in types else F.lit(None)
        if operator == "equal":
            tests.append(_equal(c, kind, term.value))
        elif operator == "not_equal":
            tests.append(_not_equal(c, kind, term.value))
        elif operator == "in":
            tests.append(_member(c, kind, term.value))
        elif operator == "not_in":
            tests.append(_absent(c, kind, term.value))
        else:
            tests.append(_ordered(c, kind, operator, term.value))
    return reduce(lambda a, b: a & b, tests) if tests else None


def scan_filtered(
    df: DataFrame, conditions: Iterable[Condition | Mapping[str, Any]]
) -> DataFrame:
    predicate = condition_filter(df, conditions)
    return df if predicate is None else df.where(predicate)


def bucket_value(base: Column, buckets: Iterable[Bucket | Mapping[str, Any]]) -> Column:
    """Result of the first bucket that ``base`` falls into, else 0.  ``between`` is inclusive."""
    picked: Any = F
    used = False
    for b in map(Bucket.parse, buckets):
        if b.low is None or (b.kind == "between" and b.high is None):
            continue
        tests = {
            "between": lambda b=b: base.between(b.low, b.high),
            "equal": lambda b=b: base == b.low,
            "greater_than": lambda b=b: base > b.low,
            "less_than": lambda b=b: base < b.low,
            "greater_equal": lambda b=b: base >= b.low,
            "less_equal": lambda b=b: base <= b.low,
        }
        if b.kind in tests:
            picked = picked.when(tests[b.kind](), F.lit(b.result))
            used = True
    return picked.otherwise(F.lit(0.0)) if used else F.lit(0.0)
