"""File to clean table: read, rename, cast, clean, score, append, profile."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.config import Rule
from tallybook.functions.text import clean_strings, field
from tallybook.operators.profile import overall_quality, profile_columns, row_quality
from tallybook.operators.projections import cast_to_schema, drop_empty_rows, rename_columns
from tallybook.operators.quality import failed_names, with_failures
from tallybook.sources.files import append_evolving, read_delimited, scratch_folder
from tallybook.sources.splits import counted, write_split

RESCUED = "_rescued"
_MALFORMED, _VERDICT, _FAILED = "_malformed", "__verdict", "__failed"
VERDICTS = ("malformed", "empty", "quarantined", "good")


class Loaded(NamedTuple):
    """The table with its figures; with rules also what was set aside and how many rows went where."""

    table: DataFrame
    profile: DataFrame
    quality: DataFrame
    quarantined: DataFrame | None = None
    malformed: DataFrame | None = None
    counts: Mapping[str, int] | None = None


def clean_rows(
    df: DataFrame, mapping: Mapping[str, str], types: Mapping[str, str], stamp: bool = True
) -> DataFrame:
    """Rename, cast, clean and score; texts that a cast empties count as null in the score."""
    typed = cast_to_schema(rename_columns(df, mapping), types)
    scored = row_quality(clean_strings(drop_empty_rows(typed)))
    return scored.withColumn("_processing_timestamp", F.current_timestamp()) if stamp else scored


def _judged(df: DataFrame, mapping: Mapping[str, str], types: Mapping[str, str], rules: Sequence[Rule], today: dt.date | None) -> DataFrame:
    """Typed and scored rows with ``failed_rules`` and the verdict that says where each goes; no row and no cell is dropped."""
    typed = clean_strings(cast_to_schema(rename_columns(df, mapping), types, RESCUED))
    cells = [c for c in typed.columns if c not in (_MALFORMED, RESCUED)]
    nothing = reduce(lambda a, b: a & b, [field(c).isNull() for c in [*cells, RESCUED]])
    verdict = (
        F.when(field(_MALFORMED).isNotNull(), "malformed").when(nothing, "empty").when(F.size(_FAILED) > 0, "quarantined").otherwise("good")
    )
    checked = with_failures(row_quality(typed, cells), rules, today, RESCUED)
    return checked.withColumns({"failed_rules": failed_names(), _VERDICT: verdict}).drop(_FAILED)


def load_file(
    spark: SparkSession,
    path: str,
    target: str,
    mapping: Mapping[str, str],
    types: Mapping[str, str],
    multiline: bool = False,
    stamp: bool = True,
    rules: Sequence[Rule] | None = None,
    folder: str | None = None,
    today: dt.date | None = None,
    known: T.StructType | None = None,
) -> Loaded:
    """Append a cleaned file to a table and profile the table as written.

    The profile reads the columnar table, one column per branch, not the text file again.

    With ``rules`` (an empty list counts) each row is typed and judged once and written by its verdict to ``folder``, by default one in the
    shared folder the cluster names: rows that break a rule are set aside with ``failed_rules``, lines with too few or too many
    cells with their text, and a cell that cannot be read keeps its text in ``_rescued`` and breaks the rules of its column.
    Only good rows are appended; read = malformed + empty + quarantined + good.  ``known`` is the schema of the table before, where the
    caller has it (``Loaded.table.schema`` of the last load): the files already there are then not opened to find it.
    """
    if rules is None:
        raw = read_delimited(spark, path, multiline=multiline)
        table = append_evolving(clean_rows(raw, mapping, types, stamp), target, known)
        return Loaded(table, profile_columns(table), overall_quality(table))
    raw = read_delimited(spark, path, multiline=multiline, malformed=_MALFORMED)
    rescued = F.coalesce(F.size(field(RESCUED)), F.lit(0))
    split = write_split(
        _judged(raw, mapping, types, rules, today), (folder or scratch_folder(spark, "load")) + "/judged", _VERDICT,
        read=F.count(F.lit(1)), rescued_cells=F.sum(F.when(field(_VERDICT) != "malformed", F.greatest(rescued, F.lit(0)))), **counted(_VERDICT, *VERDICTS),
    )
    good = split.part("good").drop("failed_rules", _MALFORMED)
    table = append_evolving(good.withColumn("_processing_timestamp", F.current_timestamp()) if stamp else good, target, known)
    malformed = split.part("malformed").select(field(_MALFORMED))
    cells = table.drop(RESCUED)
    return Loaded(table, profile_columns(cells), overall_quality(cells), split.part("quarantined").drop(_MALFORMED), malformed, dict(split.figures))
