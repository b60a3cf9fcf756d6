"""One source from file to table, driven by its configuration."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.config import Rule
from tallybook.functions.dates import parse_with_hints
from tallybook.functions.text import clean_strings, field, parse_amount
from tallybook.operators.projections import cast_to_schema, rename_columns, replace_cells
from tallybook.operators.quality import failed_names, rules_from_dict, with_failures
from tallybook.operators.tables import change_counts, change_labels, latest_per_key, upsert, without_repeats
from tallybook.sources.files import read_delimited, read_split_records, scratch_folder
from tallybook.sources.landing import header_gate, normalize_header, normalize_headers
from tallybook.sources.splits import counted, write_split, written

_MALFORMED = "_malformed"
_VERDICT, _FAILED, _KEY, _ROWS = "__verdict", "__failed", "__upsert_key", "__rows"
VERDICTS = ("malformed", "empty", "quarantined", "keyless", "good")


@dataclass(frozen=True)
class SourceConfig:
    """How the files of one source are read, named, typed, checked and stored.

    ``mapping`` goes from the file's headers (as written or cleaned) to fields; ``types`` declares date, timestamp, decimal, int or long
    for fields that are no texts.  ``dedupe_keys`` and ``order`` choose among rows of one delivery, ``upsert_key`` (one field or
    several) the row they replace.  ``multiline`` allows line breaks in cells, ``"split"`` without one task per file.  ``rescued`` names the column that keeps cells which cannot be read as their type.
    """

    mapping: Mapping[str, str]
    types: Mapping[str, str]
    upsert_key: str | tuple[str, ...]
    dedupe_keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    registered: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    date_hints: tuple[str, ...] = ("yyyy-MM-dd",)
    amount_locale: str = "en_IN"
    delimiter: str = ","
    encoding: str = "UTF-8"
    multiline: bool | str = False
    rescued: str = "_rescued"

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.upsert_key,) if isinstance(self.upsert_key, str) else tuple(self.upsert_key)

    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> SourceConfig:
        load = config.get("load") or {}
        key = load["upsert_key"]
        return cls(
            mapping=(config.get("ai_mapping") or {}).get("forced_mappings") or config.get("mapping") or {},
            types=config.get("types") or {},
            upsert_key=key if isinstance(key, str) else tuple(key),
            dedupe_keys=tuple(load.get("dedupe_keys") or ()),
            order=tuple(load.get("order") or ()),
            registered=tuple(config.get("registered") or ()),
            rules=tuple(rules_from_dict(config.get("dq_rules") or {})),
            date_hints=tuple(config.get("date_format_hints") or ("yyyy-MM-dd",)),
            amount_locale=config.get("amount_locale", "en_IN"),
            delimiter=config.get("delimiter", ","),
            encoding=config.get("encoding", "UTF-8"),
            multiline=config.get("multiline") or False,
        )


class SourceLoad(NamedTuple):
    """The table after the load, what was set aside, and one row of counts."""

    table: DataFrame
    quarantined: DataFrame
    malformed: DataFrame
    counts: DataFrame


def _typed(name: str, declared: str, config: SourceConfig) -> Column | None:
    declared = declared.lower()
    if "timestamp" in declared:
        return parse_with_hints(field(name), config.date_hints)
    if "date" in declared:
        return parse_with_hints(field(name), config.date_hints).cast("date")
    if "decimal" in declared:
        return parse_amount(field(name), config.amount_locale)
    return None


def typed_rows(df: DataFrame, config: SourceConfig) -> DataFrame:
    """Fields named, trimmed and typed; cells that cannot be read keep their text in the column ``config.rescued``."""
    clean = {normalize_header(source): target for source, target in config.mapping.items()}
    rows = clean_strings(rename_columns(df, clean))
    parsed = {n: c for n, t in config.types.items() if n in rows.columns and (c := _typed(n, t, config)) is not None}
    rest = {n: t for n, t in config.types.items() if n not in parsed}
    return cast_to_schema(replace_cells(rows, parsed, config.rescued), rest, config.rescued)


def _judged(landed: DataFrame, config: SourceConfig, today: dt.date | None) -> DataFrame:
    """Typed rows with ``failed_rules`` and the one verdict that says where a row goes."""
    typed = typed_rows(landed, config)
    cells = [c for c in typed.columns if c not in (_MALFORMED, config.rescued)]
    nothing = reduce(lambda a, b: a & b, [field(c).isNull() for c in [*cells, config.rescued]])
    keyless = reduce(lambda a, b: a | b, [field(k).isNull() if k in cells else F.lit(True) for k in config.keys])
    checked = with_failures(typed, config.rules, today, config.rescued)
    verdict = (
        F.when(field(_MALFORMED).isNotNull(), "malformed").when(nothing, "empty").when(F.size(_FAILED) > 0, "quarantined")
        .when(keyless, "keyless").otherwise("good")
    )
    return checked.withColumns({"failed_rules": failed_names(), _VERDICT: verdict}).drop(_FAILED)


def _with_key(df: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    """Add the key as one column: the field itself, or a struct of several, typed as in ``like``; null when a part is."""
    parts = [field(k).cast(like.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
    whole = reduce(lambda a, b: a & b, [field(k).isNotNull() for k in keys])
    return df.withColumn(_KEY, F.when(whole, F.struct(*parts)))


def load_source(
    spark: SparkSession,
    path: str,
    config: SourceConfig,
    existing: DataFrame | None = None,
    folder: str | None = None,
    today: dt.date | None = None,
) -> SourceLoad:
    """Read, check headers, name, type, check rules, drop repeats and upsert into ``existing``.

    The file is read once: each row is typed and judged, and written by its verdict into ``folder`` (by default one in the shared
    folder the cluster names), which the caller may remove afterwards.  Refused headers raise before any row is read.

    Nothing is lost without a number: read = malformed + empty + quarantined + keyless + duplicates + superseded + inserted +
    updated + skipped.  ``duplicates`` fell to ``dedupe_keys`` (a row with a null in one of them is no duplicate), ``superseded`` to a
    later row with their upsert key.  A cell that cannot be read keeps its text in ``config.rescued``, breaks the rules
    of its field, and is counted in ``rescued_cells``.  Rows without key are left out of the table.
    """
    if config.multiline == "split":
        landed = read_split_records(spark, path, config.delimiter, malformed=_MALFORMED)
    else:
        landed = read_delimited(spark, path, config.delimiter, config.encoding, multiline=config.multiline, malformed=_MALFORMED)
    named = normalize_headers(landed.drop(_MALFORMED))
    if config.registered:
        header_gate(named, config.registered)
    folder = folder or scratch_folder(spark, "source")
    judged = _judged(landed.toDF(*named.columns, _MALFORMED), config, today)
    cells = F.when(field(_VERDICT) != "malformed", F.coalesce(F.size(field(config.rescued)), F.lit(0)))
    split = write_split(judged, f"{folder}/judged", _VERDICT, rescued_cells=F.sum(F.greatest(cells, F.lit(0))), read=F.count(F.lit(1)), **counted(_VERDICT, *VERDICTS))
    good = split.part("good").drop("failed_rules", _MALFORMED)
    base = existing if existing is not None else spark.createDataFrame([], good.schema)
    one = len(config.keys) == 1
    key = config.keys[0] if one else _KEY
    weight = _ROWS if config.dedupe_keys else None
    if weight:
        good = without_repeats(good, config.dedupe_keys, config.order, times=weight)
    if not one:
        good, base = (_with_key(df, config.keys, base) for df in (good, base))
    last, reduced = written(
        latest_per_key(good, [key], config.order, copies=_ROWS, weight=weight), f"{folder}/last", rows=F.sum(field(_ROWS)), keys=F.count(F.lit(1))
    )
    last = last.drop(_ROWS)
    figures = split.figures
    known = {v: figures[v] for v in ("read", "malformed", "empty", "quarantined", "keyless")} | {
        "duplicates": figures["good"] - reduced["rows"], "superseded": reduced["rows"] - reduced["keys"], "rescued_cells": figures["rescued_cells"],
    }
    changes = change_counts(change_labels(base, last, key, unique=True)).select("inserted", "updated", "skipped")
    counts = changes.select(*[F.lit(n).cast("long").alias(c) for c, n in known.items()], "inserted", "updated", "skipped")
    table = upsert(base, last, key, unique=True)
    bad = split.part("quarantined").drop(_MALFORMED)
    return SourceLoad(table if one else table.drop(_KEY), bad, split.part("malformed").select(field(_MALFORMED)), counts)
