"""Formula texts as Column expressions.

A formula such as ``NET_AMOUNT * 1.05 - sales.fee`` is read once on the driver with Python's ``ast``
module and turned into native Spark expressions, so it runs inside whole-stage codegen.  Only
arithmetic is accepted and nothing is ever evaluated as code.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.config import Delta, Formula
from tallybook.functions.predicates import bucket_value
from tallybook.functions.text import field, stripped

# Fixed value: what a plain number looks like in a text cell.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Fixed value: suffix of the tables that hold cleaned rows; a formula may name them either way.
PROCESSED_SUFFIX = "_processed"


def base_name(source: str) -> str:
    return source.removesuffix(PROCESSED_SUFFIX)


class FormulaError(ValueError):
    """A formula text that is not plain arithmetic."""


@dataclass(frozen=True)
class Parsed:
    """What a formula text refers to."""

    tree: ast.expr
    fields: tuple[tuple[str, str], ...]
    names: tuple[str, ...]

    @property
    def sources(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(source for source, _ in self.fields))

    @property
    def direct(self) -> tuple[str, str] | None:
        """(source, field) when the whole formula is one plain field reference."""
        return self.fields[0] if isinstance(self.tree, ast.Attribute) and self.fields else None


def _is_calculated_style(name: str) -> bool:
    return name.isupper() or name.startswith("CALCULATED_")


def parse_formula(text: str, calculated: Iterable[str] = ()) -> Parsed:
    """Read a formula text; ``calculated`` are the known calculated names in lower case.

    ``source.NAME`` means the calculated column when one of that name exists.
    """
    known = {c.lower() for c in calculated}
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as problem:
        raise FormulaError(f"cannot read formula {text!r}: {problem.msg}") from None
    fields: list[tuple[str, str]] = []
    names: list[str] = []

    def visit(node: ast.expr) -> None:
        match node:
            case ast.BinOp(op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.FloorDiv() | ast.Pow()):
                visit(node.left)
                visit(node.right)
            case ast.UnaryOp(op=ast.UAdd() | ast.USub()):
                visit(node.operand)
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                pass
            case ast.Name():
                names.append(node.id.lower())
            case ast.Attribute(value=ast.Name()):
                if _is_calculated_style(node.attr) and node.attr.lower() in known:
                    names.append(node.attr.lower())
                else:
                    fields.append((base_name(node.value.id), node.attr))
            case _:
                raise FormulaError(f"only arithmetic is allowed in formula {text!r}")

    visit(tree)
    return Parsed(tree, tuple(dict.fromkeys(fields)), tuple(dict.fromkeys(names)))


def _floor_divide(a: Column, b: Column) -> Column:
    """Floor division of doubles, taken from the exact remainder rather than a rounded quotient."""
    rest = F.try_mod(a, b)
    floored = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return F.rint(F.try_divide(a - floored, b))


def arithmetic(
    node: ast.expr, of_field: Callable[[str], Column], of_name: Callable[[str], Column]
) -> Column:
    """Column for a parsed expression.  Null inside means "cannot be computed" and propagates."""
    match node:
        case ast.Constant():
            return F.lit(float(node.value))
        case ast.UnaryOp():
            inner = arithmetic(node.operand, of_field, of_name)
            return -inner if isinstance(node.op, ast.USub) else inner
        case ast.Name():
            return of_name(node.id.lower())
        case ast.Attribute():
            return of_field(node.attr)
        case ast.BinOp():
            a = arithmetic(node.left, of_field, of_name)
            b = arithmetic(node.right, of_field, of_name)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
                case ast.FloorDiv():
                    return _floor_divide(a, b)
                case ast.Pow():
                    return F.pow(a, b)
    raise FormulaError("unsupported expression")


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def text_number(c: Column) -> Column:
    """Number in a text cell, null when it is not one."""
    text = stripped(c)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def field_number(c: Column, kind: T.DataType | None) -> Column:
    """A source field as formula input: null, absent or non-numeric counts as 0."""
    if isinstance(kind, T.NumericType):
        value = F.coalesce(c.cast("double"), F.lit(0.0))
        return _finite(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
    if isinstance(kind, T.StringType):
        return F.coalesce(text_number(c), F.lit(0.0))
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), F.lit(0.0))
    return F.lit(0.0)


def calculated_number(c: Column, kind: T.DataType) -> Column:
    """A calculated column as formula input: null counts as 0, a non-numeric text is an error."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if isinstance(kind, T.StringType):
        return F.when(c.isNull(), F.lit(0.0)).otherwise(text_number(c))
    return F.when(c.isNull(), F.lit(0.0))


def _direct_value(c: Column, kind: T.DataType, formula: Formula) -> Column:
    """Copy of a field with its type.  A null takes the bucket of 0 (0 without buckets).

    A date column has no room for a number, so its nulls stay null.
    """
    fallback = bucket_value(F.lit(0.0), formula.buckets)
    if isinstance(kind, T.NumericType):
        if formula.buckets and not isinstance(kind, T.DoubleType):
            return F.coalesce(c.cast("double"), fallback)
        return F.coalesce(c, fallback.cast(kind))
    if isinstance(kind, T.StringType):
        empty = fallback.cast("string") if formula.buckets else F.lit("0")
        return F.coalesce(c, empty)
    return c


# Where a value lives: column name in the frame, and its type.
Cells = Mapping[str, tuple[str, T.DataType]]


def cells_of(df: DataFrame) -> dict[str, tuple[str, T.DataType]]:
    return {f.name: (f.name, f.dataType) for f in df.schema.fields}


def formula_column(formula: Formula, parsed: Parsed, row: Cells, calculated: Cells) -> Column:
    """Value of one formula over the current row.

    ``row`` locates the source fields, ``calculated`` the calculated columns available so far by
    lower-case name.  A missing calculated input gives 0.
    """
    if any(n not in calculated for n in parsed.names):
        return F.lit(0.0)
    if parsed.direct and parsed.direct[1] in row:
        column, kind = row[parsed.direct[1]]
        return _direct_value(field(column), kind, formula)

    def of_name(name: str) -> Column:
        column, kind = calculated[name]
        return calculated_number(field(column), kind)

    def of_field(name: str) -> Column:
        if name.lower() in parsed.names and _is_calculated_style(name):
            return of_name(name.lower())
        if name not in row:
            return F.lit(0.0)
        column, kind = row[name]
        return field_number(field(column), kind)

    base = _finite(arithmetic(parsed.tree, of_field, of_name))
    if formula.buckets:
        return F.when(base.isNull(), F.lit(0.0)).otherwise(bucket_value(base, formula.buckets))
    return F.coalesce(base, F.lit(0.0))


def dependency_levels(needs: Mapping[str, Sequence[str]]) -> list[list[str]]:
    """Group names so that each one comes after everything it needs; a cycle is an error."""
    levels: list[list[str]] = []
    waiting = dict(needs)
    while waiting:
        ready = [n for n, deps in waiting.items() if not any(d in waiting for d in deps)]
        if not ready:
            raise ValueError(f"formulas depend on each other in a circle: {sorted(waiting)}")
        levels.append(ready)
        for name in ready:
            del waiting[name]
    return levels


def parse_all(formulas: Sequence[Formula]) -> dict[str, tuple[Formula, Parsed]]:
    """Parsed formulas by output name.  An unreadable text becomes the constant 0, with a warning."""
    outputs = {f.output for f in formulas}
    result = {}
    for f in formulas:
        try:
            parsed = parse_formula(f.text, outputs)
        except FormulaError as problem:
            warnings.warn(f"{f.name}: {problem}; the column is 0", stacklevel=2)
            parsed = Parsed(ast.Constant(value=0), (), ())
        result[f.output] = (f, parsed)
    return result


CALCULATED_PREFIX = "__calc_"


def calculated_columns(df: DataFrame, formulas: Sequence[Formula | Mapping]) -> DataFrame:
    """Add one column per formula over the fields of ``df`` and earlier results.

    One projection per dependency level; Catalyst collapses them.  Results are kept apart from the
    fields until the end, so ``NET`` may be defined over a field ``net`` and then replaces it.
    """
    items = [f for f in map(Formula.parse, formulas) if f is not None]
    table = parse_all(items)
    row = cells_of(df)
    original = df.columns
    calculated = {n.lower(): cell for n, cell in row.items() if n not in table}
    for level in dependency_levels({n: parsed.names for n, (_, parsed) in table.items()}):
        new = {n: formula_column(*table[n], row, calculated) for n in level}
        df = df.select("*", *[c.alias(CALCULATED_PREFIX + n) for n, c in new.items()])
        kinds = cells_of(df)
        calculated |= {n: kinds[CALCULATED_PREFIX + n] for n in level}
    return df.select(
        *[field(c) for c in original if c not in table],
        *[field(CALCULATED_PREFIX + n).alias(n) for n in table],
    )


def delta_columns(df: DataFrame, deltas: Sequence[Delta | Mapping]) -> DataFrame:
    """Add difference columns over calculated columns.

    Names are looked up without case, an absent or null value counts as 0, an error gives 0, and a
    later delta may use an earlier one.
    """
    for item in deltas:
        delta = Delta.parse(item)
        if delta is None:
            continue
        kinds = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}

        def of_name(name: str, kinds: Mapping = kinds) -> Column:
            if name not in kinds or name.endswith("_mapping_key"):
                return F.lit(0.0)
            column, kind = kinds[name]
            return field_number(field(column), kind)

        try:
            parsed = parse_formula(delta.text)
            value = F.coalesce(_finite(arithmetic(parsed.tree, of_name, of_name)), F.lit(0.0))
        except FormulaError as problem:
            warnings.warn(f"{delta.name}: {problem}; the column is 0", stacklevel=2)
            value = F.lit(0.0)
        df = df.withColumn(delta.output, value)
    return df
