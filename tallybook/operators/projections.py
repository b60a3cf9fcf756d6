"""Projections and row filters over loaded tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.dates import order_date, preset_window
from tallybook.functions.text import field


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source names to canonical names; unknown sources and blank targets are ignored."""
    known = {s: t for s, t in mapping.items() if s in df.columns and t}
    return df.withColumnsRenamed(known)


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep the selected fields; absent ones become null text columns."""
    return df.select(
        *[field(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in fields]
    )


def stamp(df: DataFrame, name: str = "processed_at") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def _whole(c: Column, kind: T.DataType) -> Column:
    """Whole number; decimals in a text are cut off."""
    return F.coalesce(c.try_cast(kind), c.try_cast(T.DecimalType(38, 6)).try_cast(kind))


def _typed(c: Column, declared: str) -> Column | None:
    declared = declared.lower()
    if "bigint" in declared or "long" in declared:
        return _whole(c, T.LongType())
    if "int" in declared:
        return _whole(c, T.IntegerType())
    if "decimal" in declared or "numeric" in declared:
        return c.try_cast(T.DecimalType(10, 2))
    if "timestamp" in declared or "datetime" in declared:
        return c.try_cast(T.TimestampNTZType())
    if "date" in declared:
        return c.try_cast(T.DateType())
    return None


def cast_to_schema(df: DataFrame, types: Mapping[str, str], rescued: str | None = None) -> DataFrame:
    """Cast columns to their declared types; a value that does not fit becomes null.

    Types are recognised by name: long, int, decimal(10,2), timestamp, date.  Others are left alone.
    ``rescued`` names a column that keeps such values, see ``replace_cells``.
    """
    typed = {n: c for n in df.columns if n in types and (c := _typed(field(n), types[n])) is not None}
    return replace_cells(df, typed, rescued)


def replace_cells(df: DataFrame, typed: Mapping[str, Column], rescued: str | None = None) -> DataFrame:
    """Replace columns by what a cast or parse makes of them.

    ``rescued`` names a column for the cells that this empties: an array of (field, value), the value as it stood; null for a
    row that lost nothing.  Cells that ``df`` holds there already are kept.
    """
    if rescued is None:
        return df.select(*[typed[n].alias(n) if n in typed else field(n) for n in df.columns])
    place = {n: f"__typed_{n}" for n in typed}
    step = df.withColumns({place[n]: c for n, c in typed.items()})
    kind = "array<struct<field:string,value:string>>"
    lost = [
        F.when(field(n).isNotNull() & field(place[n]).isNull(), F.struct(F.lit(n).alias("field"), field(n).cast("string").alias("value")))
        for n in typed
    ]
    cells = F.array_compact(F.array(*lost)).cast(kind) if lost else F.array().cast(kind)
    if rescued in df.columns:
        cells = F.concat(F.coalesce(field(rescued), F.array().cast(kind)), cells)
    out = [field(place.get(n, n)).alias(n) for n in df.columns if n != rescued]
    return step.select(*out, cells.alias(rescued)).withColumn(rescued, F.when(F.size(field(rescued)) > 0, field(rescued)))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def date_window(
    df: DataFrame,
    column: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    preset: str | None = None,
    today: dt.date | None = None,
) -> DataFrame:
    """Rows whose day lies between two days, both included, or in a named window.

    Written as a half-open range on the raw column, so it is pushed into the scan.
    """
    if preset is not None:
        start, end = preset_window(preset, today or dt.date.today())
    if start is None or end is None:
        raise ValueError("give both start and end, or a preset")
    kind = df.schema[column].dataType
    low = F.lit(start.isoformat()).cast(kind)
    high = F.lit((end + dt.timedelta(days=1)).isoformat()).cast(kind)
    return df.where((field(column) >= low) & (field(column) < high))


def project_dashboard(df: DataFrame, key: str, value: str) -> DataFrame:
    """The few columns a dashboard needs; the scan reads nothing else."""
    columns = [field(key), order_date(df).alias("order_date")]
    if value in df.columns:
        columns.append(field(value))
    return df.select(*columns)
