"""Reconciliation reports: calculate per source, merge by key, compare, explain."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.config import Formula, ReportDefinition
from tallybook.functions.dates import order_date
from tallybook.functions.formula import (
    CALCULATED_PREFIX,
    Parsed,
    base_name,
    calculated_columns,
    cells_of,
    delta_columns,
    dependency_levels,
    formula_column,
    parse_all,
)
from tallybook.functions.keys import integral_fields, mapping_key
from tallybook.functions.predicates import condition_filter, scan_filtered
from tallybook.functions.reasons import with_reasons
from tallybook.functions.text import field, quoted
from tallybook.operators.joins import resolve_fallback
from tallybook.operators.tables import latest_per_key, upsert
from tallybook.sources.files import scratch_folder
from tallybook.sources.splits import written

ORDER_DATE = "order_date"
TOTAL_SALES = "total_sales"


@dataclass(frozen=True)
class Assignment:
    """Which source computes which formula, sources in processing order (primary first)."""

    sources: tuple[str, ...]
    owner: Mapping[str, str]
    table: Mapping[str, tuple[Formula, Parsed]]

    @property
    def primary(self) -> str:
        return self.sources[0]

    def owned(self, source: str) -> list[str]:
        return [n for n in self.table if self.owner[n] == source]

    def inputs(self, name: str) -> list[str]:
        """Calculated columns a formula uses that some formula defines."""
        return [d for d in self.table[name][1].names if d in self.table]

    def late(self, source: str) -> set[str]:
        """Formulas that need calculated columns of another source, directly or not."""
        found: set[str] = set()
        for level in dependency_levels({n: self.inputs(n) for n in self.table}):
            for name in level:
                if any(d in found or self.owner[d] != self.owner[name] for d in self.inputs(name)):
                    found.add(name)
        return {n for n in found if self.owner[n] == source}


def assign_formulas(definition: ReportDefinition) -> Assignment:
    """A formula belongs to the first source it names.

    One that names none goes with the formulas it depends on, else to the primary source, which is
    the first source any formula names.
    """
    table = parse_all(definition.formulas)
    found = [s for _, parsed in table.values() for s in parsed.sources]
    if not found:
        raise ValueError(f"no formula of report {definition.name!r} names a source")
    sources = tuple(dict.fromkeys(found))
    owner = {n: parsed.sources[0] for n, (_, parsed) in table.items() if parsed.sources}
    for level in dependency_levels({n: [d for d in p.names if d in table] for n, (_, p) in table.items()}):
        for name in level:
            if name not in owner:
                homes = [owner[d] for d in table[name][1].names if d in owner]
                owner[name] = homes[0] if homes else sources[0]
    return Assignment(tuple(s for s in sources if s in owner.values()), owner, table)


def _by_base(items: Mapping) -> dict:
    return {base_name(k): v for k, v in items.items()}


def _raw(source: str, name: str) -> str:
    return f"__raw_{source}__{name}"


def _wanted(source: str, df: DataFrame, plan: Assignment, order: Sequence[str], order_id: str | None) -> list[str]:
    """The columns of a source that a report reads beside its key."""
    wanted = [n for f in plan.owned(source) for s, n in plan.table[f][1].fields if n in df.columns]
    wanted += [ORDER_DATE] if ORDER_DATE in df.columns else []
    wanted += [o for o in order if o in df.columns] + ([order_id] if order_id in df.columns else [])
    return list(dict.fromkeys(wanted))


def _own_formulas(pruned: DataFrame, source: str, plan: Assignment, wanted: Sequence[str]) -> DataFrame:
    """Add the formulas that need nothing from other sources."""
    kinds = cells_of(pruned)
    row = {n: kinds[_raw(source, n)] for n in wanted}
    late = plan.late(source)
    own = [n for n in plan.owned(source) if n not in late]
    calculated: dict = {}
    for level in dependency_levels({n: [d for d in plan.inputs(n) if d in own] for n in own}):
        new = [
            formula_column(*plan.table[n], row, calculated).alias(CALCULATED_PREFIX + n)
            for n in level
        ]
        pruned = pruned.select("*", *new)
        kinds = cells_of(pruned)
        calculated |= {n: kinds[CALCULATED_PREFIX + n] for n in level}
    return pruned


def _needed_later(source: str, plan: Assignment, wanted: Sequence[str], order_id: str | None = None) -> set[str]:
    """Raw columns that are used after the sources have met."""
    late = {_raw(source, n) for f in plan.late(source) for _, n in plan.table[f][1].fields if n in wanted}
    return late | {_raw(source, n) for n in (ORDER_DATE, order_id) if n in wanted}


def _prepare(
    source: str,
    df: DataFrame,
    definition: ReportDefinition,
    plan: Assignment,
    join_columns: Sequence[str],
    on_numbers: bool,
    order: Sequence[str],
    unique: bool,
    fallback: bool,
    order_id: str | None,
) -> DataFrame:
    """Filter, prune, one row per key, then the formulas that need nothing from other sources."""
    df = scan_filtered(df, _by_base(definition.conditions).get(source, ()))
    key_fields = _by_base(definition.mapping_keys).get(source, ())
    if on_numbers:
        keys = [field(n).cast("long") for n in key_fields]
    else:
        keys = [mapping_key(df, key_fields, row_id="_id")]
    wanted = _wanted(source, df, plan, order, order_id)
    pruned = df.select(
        *[k.alias(c) for k, c in zip(keys, join_columns)],
        *[field(n).alias(_raw(source, n)) for n in wanted],
    )
    for c in join_columns:
        pruned = pruned.where(field(c).isNotNull())
    if not unique:
        pruned = latest_per_key(pruned, join_columns, [_raw(source, o) for o in order])
    pruned = _own_formulas(pruned, source, plan, wanted)
    needed_later = _needed_later(source, plan, wanted, order_id)
    if fallback:
        needed_later |= {_raw(source, o) for o in order}
    kept = [c for c in pruned.columns if not c.startswith("__raw_") or c in needed_later]
    return pruned.select(*[field(c) for c in kept])


def _key_text(columns: Sequence[str]) -> Column:
    parts = [field(c).cast("string") for c in columns]
    present = parts[0].isNotNull()
    return F.when(present, F.concat_ws("_", *parts)) if len(parts) > 1 else parts[0]


def _join_columns(sources: Sequence[str], frames: Mapping[str, DataFrame], key_fields: Mapping[str, Sequence[str]], text: bool = False) -> tuple[list[str], bool]:
    """Names of the join columns, and whether keys are joined as whole numbers."""
    widths = {len(key_fields.get(s, ())) for s in sources}
    on_numbers = not text and len(widths) == 1 and all(integral_fields(frames[s], key_fields.get(s, ())) for s in sources)
    return [f"__key{i}" for i in range(widths.pop() if on_numbers else 1)], on_numbers


def build_report(
    sources: Mapping[str, DataFrame],
    definition: ReportDefinition,
    *,
    order: Mapping[str, Sequence[str]] | None = None,
    unique: Collection[str] = (),
    fallback: bool = False,
    order_ids: Mapping[str, str] | None = None,
    stamp: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per mapping key over all sources, with calculated columns, deltas and reasons.

    The first source of the definition is the primary one.  ``order`` names the columns that
    decide which of several rows with one key is the last; ``unique`` lists sources known to hold
    each key once (already aggregated ones), which skips that step.  ``fallback`` retries rows
    without key match by order id: column ``order_ids[source]``, else the head of the key.

    Keys of whole numbers are joined as numbers and printed only in the result.
    """
    plan = assign_formulas(definition)
    frames = {base_name(n): df for n, df in sources.items()}
    missing = [s for s in plan.sources if s not in frames]
    if missing:
        raise ValueError(f"report {definition.name!r} needs sources {missing}")
    order = _by_base(order or {})
    order_ids = _by_base(order_ids or {})
    unique = {base_name(u) for u in unique}
    key_fields = _by_base(definition.mapping_keys)

    join_columns, on_numbers = _join_columns(plan.sources, frames, key_fields, text=fallback)

    frames_by_key: list[DataFrame] = []
    for source in plan.sources:
        prepared = _prepare(
            source, frames[source], definition, plan, join_columns, on_numbers,
            order.get(source, ()), source in unique, fallback, order_ids.get(source),
        )
        own_key = f"{source}_mapping_key"
        if fallback and frames_by_key:
            wanted = order_ids.get(source)
            column = _raw(source, wanted) if wanted else None
            order_id = field(column).cast("string") if column in prepared.columns else None
            ranks = [_raw(source, o) for o in order.get(source, ())]
            key = join_columns[0]
            prepared = resolve_fallback(
                frames_by_key[0], prepared, key, order_id, ranks, hot_rows
            ).withColumnsRenamed({key: own_key, "__merge_key": key})
        else:
            prepared = prepared.withColumn(own_key, _key_text(join_columns))
        frames_by_key.append(prepared)
    return _finished(_merge(frames_by_key, join_columns), plan, definition, stamp)


def _finished(merged: DataFrame, plan: Assignment, definition: ReportDefinition, stamp: bool) -> DataFrame:
    """Merged rows with late formulas, order date, deltas and reasons."""
    merged = _late_formulas(merged, plan)
    dates = [_raw(s, ORDER_DATE) for s in reversed(plan.sources)]
    kinds = cells_of(merged)
    dates = [d for d in dates if d in kinds]
    out = [field(f"{s}_mapping_key") for s in plan.sources]
    out += [field(CALCULATED_PREFIX + n).alias(n) for n in plan.table]
    if dates and ORDER_DATE not in plan.table:
        cells = [field(d) for d in dates]
        if len({kinds[d][1] for d in dates}) > 1:
            cells = [c.cast("string") for c in cells]
        out.append(F.coalesce(*cells).alias(ORDER_DATE))
    report = merged.select(*out)
    report = compare(report, definition)
    return report.withColumn("processed_at", F.current_timestamp()) if stamp else report


def _merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Primary rows with what each other source has for them, and the rows only another source has.

    Every frame holds a key once.  Two sources meet in one full outer join.  More of them are put under each other, a
    struct per source, and meet in one grouping by key, so each source is computed once.  A key without primary row
    gives one row per source that has it: only the primary source brings others together.
    """
    on = list(on)
    if len(frames) == 2:
        return frames[0].join(frames[1], on, "full_outer")
    cells = [[c for c in frame.columns if c not in on] for frame in frames]
    kinds = [T.StructType([frame.schema[c] for c in names]) for frame, names in zip(frames, cells)]
    places = range(len(frames))
    parts = [
        frame.select(
            *[field(c) for c in on],
            *[(F.struct(*[field(c) for c in cells[i]]) if i == j else F.lit(None).cast(kinds[j])).alias(f"__source{j}") for j in places],
        )
        for i, frame in enumerate(frames)
    ]
    met = reduce(DataFrame.union, parts).groupBy(*[field(c) for c in on]).agg(
        *[F.first(f"__source{j}", ignorenulls=True).alias(f"__source{j}") for j in places]
    )
    return _rows_of(met, on, cells, kinds)


def _rows_of(met: DataFrame, on: Sequence[str], cells: Sequence[Sequence[str]], kinds: Sequence[T.StructType]) -> DataFrame:
    """Report rows of keys with one struct ``__source<place>`` per source that has the key."""
    places = range(len(cells))
    at = [F.col(f"__source{j}") for j in places]

    def row(wanted: Collection[int]) -> Column:
        return F.struct(*[(at[j] if j in wanted else F.lit(None).cast(kinds[j])).alias(f"s{j}") for j in places])

    alone = F.array_compact(F.array(*[F.when(at[j].isNotNull(), row((j,))) for j in places[1:]]))
    rows = met.select(*[field(c) for c in on], F.explode(F.when(at[0].isNotNull(), F.array(row(places))).otherwise(alone)).alias("row"))
    return rows.select(*[field(c) for c in on], *[F.col(f"row.s{j}.{quoted(c)}").alias(c) for j in places for c in cells[j]])


def _late_formulas(merged: DataFrame, plan: Assignment) -> DataFrame:
    """Formulas over calculated columns of other sources, on the merged rows.

    They exist where their own source has a row; an input whose source has none counts as missing
    and gives 0.
    """
    late = {n for s in plan.sources for n in plan.late(s)}
    if not late:
        return merged
    for level in dependency_levels({n: [d for d in plan.inputs(n) if d in late] for n in late}):
        kinds = cells_of(merged)
        new = []
        for name in sorted(level):
            source = plan.owner[name]
            formula, parsed = plan.table[name]
            row = {n: kinds[_raw(source, n)] for _, n in parsed.fields if _raw(source, n) in kinds}
            calculated = {d: kinds[CALCULATED_PREFIX + d] for d in plan.inputs(name)}
            value = formula_column(formula, parsed, row, calculated)
            for other in {plan.owner[d] for d in plan.inputs(name)} - {source}:
                value = F.when(field(f"{other}_mapping_key").isNull(), F.lit(0.0)).otherwise(value)
            here = field(f"{source}_mapping_key").isNotNull()
            new.append(F.when(here, value).alias(CALCULATED_PREFIX + name))
        merged = merged.select("*", *new)
    return merged


def compare(report: DataFrame, definition: ReportDefinition) -> DataFrame:
    """Deltas, reasons and status; left out when the definition has neither deltas nor reasons."""
    if not definition.deltas and not definition.reasons:
        return report
    return with_reasons(delta_columns(report, definition.deltas), definition.reasons)


def report_columns(df: DataFrame, definition: ReportDefinition) -> DataFrame:
    """Formulas, deltas and reasons over the rows of the primary source alone.

    Stateless, so it also works on a streaming frame.
    """
    plan = assign_formulas(definition)
    df = scan_filtered(df, _by_base(definition.conditions).get(plan.primary, ()))
    key = mapping_key(df, _by_base(definition.mapping_keys).get(plan.primary, ()), row_id="_id")
    own_key = f"{plan.primary}_mapping_key"
    rows = df.withColumn(own_key, key).where(field(own_key).isNotNull())
    names = plan.owned(plan.primary)
    computed = calculated_columns(rows, [plan.table[n][0] for n in names])
    return compare(computed.select(field(own_key), *[field(n) for n in names]), definition)


def report_key(report: DataFrame) -> Column:
    """Identity of a report row: its first mapping key that is present, with the name of its source."""
    keys = [c for c in report.columns if c.endswith("_mapping_key")]
    return F.coalesce(*[F.concat(F.lit(f"{c}="), field(c)) for c in keys])


def keyed_source(source: str, df: DataFrame, definition: ReportDefinition) -> DataFrame:
    """The source's rows with their report key, ``<source>_mapping_key``: null where a key field is missing or a filter leaves the row out."""
    key = mapping_key(df, _by_base(definition.mapping_keys).get(base_name(source), ()), row_id="_id")
    passes = condition_filter(df, _by_base(definition.conditions).get(base_name(source), ()))
    return df.withColumn(f"{base_name(source)}_mapping_key", key if passes is None else F.when(passes, key))


def source_accounts(sources: Mapping[str, DataFrame], definition: ReportDefinition) -> DataFrame:
    """What becomes of each source's rows in a report: ``read`` = ``filtered`` + ``skipped`` + ``superseded`` + ``merged``.

    ``filtered`` rows fail the conditions, ``skipped`` ones have no mapping key, ``superseded`` ones share their key with a later row,
    ``merged`` is the number of keys that reach the report.  One shuffle of keys a source, combined in each task before.
    """
    lines = []
    for source, df in _by_base(sources).items():
        key = mapping_key(df, _by_base(definition.mapping_keys).get(source, ()), row_id="_id")
        passes = condition_filter(df, _by_base(definition.conditions).get(source, ()))
        passes = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
        per_key = df.select(passes.alias("passes"), F.when(passes, key).alias("key")).groupBy("passes", "key").agg(F.count(F.lit(1)).alias("n"))
        has_key = F.col("key").isNotNull()
        total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        lines.append(per_key.agg(
            F.lit(source).alias("source"), total(F.lit(True)).alias("read"), total(~F.col("passes")).alias("filtered"),
            total(F.col("passes") & ~has_key).alias("skipped"), (total(has_key) - F.count_if(has_key)).alias("superseded"), F.count_if(has_key).alias("merged"),
        ))
    return reduce(DataFrame.union, lines)


def changed_sources(
    sources: Mapping[str, DataFrame], changed: Mapping[str, DataFrame], definition: ReportDefinition
) -> dict[str, DataFrame]:
    """The rows of all sources that share a mapping key with a changed row.

    ``changed`` holds, per source, the rows that were added or altered, and as they were before where their key or filter
    fields changed.  Only keys of changed rows are gathered; where they are few, Spark broadcasts them and no source is shuffled.
    """
    fields, given = _by_base(definition.mapping_keys), _by_base(changed)
    key = lambda s, df: mapping_key(df, fields.get(s, ()), row_id="_id")
    keys = reduce(DataFrame.union, [df.select(key(s, df).alias("__changed")) for s, df in given.items()]).where("__changed is not null").distinct()
    spark = keys.sparkSession
    keys = written(keys, scratch_folder(spark, "changed") + "/keys")[0]
    return {s: df.join(keys, key(s, df) == F.col("__changed"), "left_semi") for s, df in _by_base(sources).items()}


def refresh_report(
    stored: DataFrame,
    sources: Mapping[str, DataFrame],
    definition: ReportDefinition,
    changed: Mapping[str, DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Rebuild a report onto its stored rows: recalculated columns are replaced, others survive.

    A stored row is replaced when any of its source keys occurs in the fresh report, also in a row that has
    another primary key now.  Rows whose keys no longer occur stay as they are.

    ``changed`` limits the work to keys of changed source rows (see ``changed_sources``): every other stored row stays as it is and
    is not shuffled where the touched keys are few enough for Spark to broadcast them.  The order-id fallback looks beyond
    a key, so it needs all rows.  The fresh rows are written once, and stored rows meet their keys in a narrow join.
    """
    if changed is not None:
        if options.get("fallback"):
            raise ValueError("a report with order-id fallback cannot be refreshed by changed keys alone")
        sources = changed_sources(sources, changed, definition)
    fresh = build_report(sources, definition, **options)
    key, spark = "__report_key", fresh.sparkSession
    new = written(fresh.withColumn(key, report_key(fresh)), scratch_folder(spark, "fresh") + "/report")[0]
    named = stored.withColumn(key, report_key(stored))
    shared = [c for c in stored.columns if c.endswith("_mapping_key") and c in fresh.columns]

    def entries(df: DataFrame, *more: str) -> DataFrame:
        """A row's own key and its source keys, each with its name."""
        cells = [F.struct(F.lit(c).alias("name"), field(c).alias("value")) for c in (key, *shared)]
        return df.select(*more, F.explode(F.array(*cells)).alias("entry")).select(*more, "entry.*").where("value is not null")

    occurring = entries(new).distinct()
    own = F.col("name") == key
    touched = (
        entries(named, key).join(occurring, ["name", "value"], "left_semi").groupBy(key)
        .agg(F.bool_or(own).alias("__same"))
    )
    touched = written(touched, scratch_folder(spark, "touched") + "/keys")[0]
    if changed is None:
        live = named.join(touched.where("NOT __same"), key, "left_anti")
        return upsert(live, new, key, unique=True).drop(key)
    again = named.join(touched.where("__same"), key, "left_semi")
    kept = named.join(touched, key, "left_anti")  # few touched keys are broadcast, so these rows stay where they are
    return upsert(again, new, key, unique=True).unionByName(kept, allowMissingColumns=True).drop(key)


def build_dashboard(
    report: DataFrame,
    definition: ReportDefinition,
    existing: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Slim table per primary key: total sales, order date, stamps.

    The definition must hold a ``TOTAL_SALES`` formula.  Rows without primary key, or with neither
    value, are skipped.  ``created_at`` is set only when a key is new.
    """
    plan = assign_formulas(definition)
    if TOTAL_SALES not in plan.table:
        raise ValueError(f"report {definition.name!r} has no TOTAL_SALES formula")
    key = f"{plan.primary}_mapping_key"
    now = now if now is not None else F.current_timestamp()
    slim = report.select(
        field(key),
        field(TOTAL_SALES),
        order_date(report).alias(ORDER_DATE),
        now.alias("updated_at"),
        now.alias("created_at"),
    ).where(
        field(key).isNotNull()
        & (field(TOTAL_SALES).isNotNull() | field(ORDER_DATE).isNotNull())
    )
    return slim if existing is None else upsert(existing, slim, key, insert_only=["created_at"])
