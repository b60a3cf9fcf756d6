"""Several reports in one run that share the reading and the shuffle of their sources."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.config import ReportDefinition
from tallybook.functions.formula import CALCULATED_PREFIX
from tallybook.functions.keys import mapping_key
from tallybook.functions.predicates import condition_filter
from tallybook.functions.text import field, quoted
from tallybook.operators.tables import last_row
from tallybook.plans.report import (
    Assignment,
    _by_base,
    _finished,
    _join_columns,
    _key_text,
    _needed_later,
    _own_formulas,
    _raw,
    _rows_of,
    _wanted,
    assign_formulas,
)
from tallybook.sources.files import scratch_folder
from tallybook.sources.splits import written

_HERE = "__here"


@dataclass(frozen=True)
class Cut:
    """What a report takes from a source: the rows that pass its conditions, and these columns of them."""

    source: str
    filter: str
    wanted: tuple[str, ...]
    conditions: tuple = dataclass_field(compare=False)


def build_reports(
    sources: Mapping[str, DataFrame],
    definitions: Sequence[ReportDefinition],
    *,
    order: Mapping[str, Sequence[str]] | None = None,
    stamp: bool = True,
    names: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """The reports by name, each with the rows that ``build_report`` gives it (without order-id fallback).

    Reports over the same sources with the same mapping keys form a family.  A family reads each source once: rows that pass
    any of its reports' conditions go through one shuffle by key, combined in each task before, which keeps per key and report
    the last row of each source.  The result, one row per key, is written once; a report is then a narrow scan of its own columns
    without a shuffle.  Reports that take the same from a source share it.  ``names`` limits the run to some of the reports.
    """
    chosen = [d for d in definitions if names is None or d.name in names]
    if len({d.name for d in chosen}) < len(chosen):
        raise ValueError("report names must differ")
    frames, order = _by_base(sources), _by_base(order or {})
    plans = {d.name: assign_formulas(d) for d in chosen}
    families: dict[tuple, list[ReportDefinition]] = {}
    for d in chosen:
        missing = [s for s in plans[d.name].sources if s not in frames]
        if missing:
            raise ValueError(f"report {d.name!r} needs sources {missing}")
        fields = _by_base(d.mapping_keys)
        families.setdefault(tuple(sorted((s, tuple(fields.get(s, ()))) for s in plans[d.name].sources)), []).append(d)
    found = {}
    for keys, members in families.items():
        cuts = {d.name: [_cut(s, frames[s], d, plans[d.name], order.get(s, ())) for s in plans[d.name].sources] for d in members}
        places = {c: f"__cut{i}" for i, c in enumerate(dict.fromkeys(c for own in cuts.values() for c in own))}
        met, on = _met(frames, dict(keys), places, order)
        for d in members:
            found[d.name] = _report(met, on, plans[d.name], d, cuts[d.name], places, stamp)
    return {d.name: found[d.name] for d in chosen}


def _cut(source: str, df: DataFrame, definition: ReportDefinition, plan: Assignment, order: Sequence[str]) -> Cut:
    conditions = _by_base(definition.conditions).get(source, ())
    return Cut(source, repr(tuple(conditions)), tuple(_wanted(source, df, plan, order, None)), tuple(conditions))


def _met(
    frames: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], places: Mapping[Cut, str], order: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, list[str]]:
    """One row per key, written: per cut the last row of its source as a struct, null where the source has none."""
    on, on_numbers = _join_columns(list(keys), frames, keys)
    parts = []
    best: list[Column] = []
    for source, fields in keys.items():
        df = frames[source]
        cuts = [c for c in places if c.source == source]
        tests = {c: condition_filter(df, c.conditions) for c in cuts}
        passes = {c: F.lit(True) if t is None else F.coalesce(t, F.lit(False)) for c, t in tests.items()}
        values = [field(n).cast("long") for n in fields] if on_numbers else [mapping_key(df, fields, row_id="_id")]
        names = list(dict.fromkeys(n for c in cuts for n in c.wanted))
        rows = df if any(t is None for t in tests.values()) else df.where(reduce(lambda a, b: a | b, tests.values()))
        rows = rows.select(
            *[v.alias(c) for v, c in zip(values, on)],
            *[field(n).alias(_raw(source, n)) for n in names],
            *[passes[c].alias(f"{places[c]}_passes") for c in cuts],
        )
        parts.append(rows.where(reduce(lambda a, b: a & b, [field(c).isNotNull() for c in on])).withColumn(_HERE, F.lit(True)))
        kinds = {f.name: f.dataType for f in parts[-1].schema.fields}
        for c in cuts:
            columns = [_raw(source, n) for n in c.wanted] + [_HERE]
            best.append(last_row(kinds, columns, [_raw(source, o) for o in order.get(source, ())], F.col(f"{places[c]}_passes")).alias(places[c]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    met = rows.groupBy(*[field(c) for c in on]).agg(*best)
    return written(met, scratch_folder(met.sparkSession, "reports") + "/keys")[0], on


def _report(
    met: DataFrame, on: Sequence[str], plan: Assignment, definition: ReportDefinition, cuts: Sequence[Cut], places: Mapping[Cut, str], stamp: bool
) -> DataFrame:
    here = [f"__here{i}" for i in range(len(cuts))]
    at = [places[c] for c in cuts]
    rows = met.where(reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in at])).select(
        *[field(c) for c in on],
        *[F.col(p).isNotNull().alias(h) for p, h in zip(at, here)],
        *[F.col(f"{p}.{quoted(_raw(c.source, n))}").alias(_raw(c.source, n)) for p, c in zip(at, cuts) for n in c.wanted],
        *[_key_text(on).alias(f"{c.source}_mapping_key") for c in cuts],
    )
    cells = []
    for c in cuts:
        before = set(rows.columns)
        rows = _own_formulas(rows, c.source, plan, c.wanted)
        added = [n for n in rows.columns if n not in before and n.startswith(CALCULATED_PREFIX)]
        later = _needed_later(c.source, plan, c.wanted)
        cells.append([f"{c.source}_mapping_key", *added, *[n for n in rows.columns if n in later]])
    structs = [F.when(F.col(h), F.struct(*[field(n) for n in names])).alias(f"__source{j}") for j, (h, names) in enumerate(zip(here, cells))]
    structured = rows.select(*[field(c) for c in on], *structs)
    kinds = [structured.schema[f"__source{j}"].dataType for j in range(len(cells))]
    return _finished(_rows_of(structured, on, cells, kinds), plan, definition, stamp)
