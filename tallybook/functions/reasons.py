"""Reason text and reconciliation status from delta columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.config import Reason
from tallybook.functions.formula import field_number
from tallybook.functions.text import field

RECONCILED = "RECONCILED"
UNRECONCILED = "UNRECONCILED"


def matched_reasons(df: DataFrame, reasons: Sequence[Reason | Mapping]) -> Column:
    """Array of the reasons that apply to a row, in definition order.

    A reason applies when its delta exceeds the threshold in size.  One with ``must_check`` false
    is skipped once any earlier reason applied.
    """
    kinds = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}
    entries: list[Column] = []
    any_before: Column | None = None
    for item in reasons:
        reason = Reason.parse(item)
        if reason is None:
            continue
        name, kind = kinds.get(reason.delta.lower(), (None, None))
        delta = F.coalesce(field_number(field(name), kind), F.lit(0.0)) if name else F.lit(0.0)
        exceeds = F.abs(delta) > abs(reason.threshold)
        applies = exceeds
        if not reason.must_check and any_before is not None:
            applies = exceeds & ~any_before
        entries.append(F.when(applies, F.lit(reason.label)))
        any_before = exceeds if any_before is None else any_before | exceeds
    if not entries:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*entries))


def with_reasons(df: DataFrame, reasons: Sequence[Reason | Mapping]) -> DataFrame:
    """Add ``reason`` (joined text, empty when none) and ``reconciliation_status``."""
    text = F.array_join(matched_reasons(df, reasons), ", ")
    kept = [field(c) for c in df.columns if c not in ("reason", "reconciliation_status")]
    df = df.select(*kept, text.alias("reason"))
    status = F.when(F.col("reason") != "", UNRECONCILED).otherwise(RECONCILED)
    return df.withColumn("reconciliation_status", status)
