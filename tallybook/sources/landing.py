"""Landed tables: headers, date-column detection, header registration, raw append."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from functools import reduce
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import NO_DATE
from tallybook.functions.text import field, stripped

# Symbols in a header that become words; other symbols are dropped.
SYMBOL_WORDS = {
    "%": "percentage",
    "&": "and",
    "@": "at",
    "#": "number",
    "$": "dollar",
    "+": "plus",
    "/": "or",
    "|": "or",
    "=": "equals",
    "<": "less_than",
    ">": "greater_than",
}
DROPPED_SYMBOLS = "\\*()[]{}?!:;,'\"~`^."
UNNAMED = "unnamed_column"


def normalize_header(header: object) -> str:
    """Clean column name: lower case, symbols as words, blanks and hyphens as single ``_``."""
    if not isinstance(header, str):
        return UNNAMED
    table = {ord(s): w for s, w in SYMBOL_WORDS.items()} | {ord(s): None for s in DROPPED_SYMBOLS}
    words = header.strip().lower().translate(table)
    return re.sub(r"[\s_-]+", "_", words).strip("_") or UNNAMED


def normalize_names(headers: Sequence[object]) -> list[str]:
    """Clean, distinct names for a header row: a name that is taken becomes the first free of ``_1``, ``_2`` ..."""
    used: set[str] = set()
    spare: dict[str, Iterator[str]] = {}

    def claim(clean: str) -> str:
        choices = spare.setdefault(clean, chain([clean], (f"{clean}_{n}" for n in count(1))))
        name = next(c for c in choices if c not in used)
        used.add(name)
        return name

    return [claim(normalize_header(h)) for h in headers]


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_names(df.columns))


# Words in a column name that mark a date, and the text shapes of dates.
DATE_COLUMN_WORDS = ("date", "time", "timestamp", "created", "updated", "modified", "dob", "birth")
DATE_SHAPES = (
    r"^\d{1,2}/\d{1,2}/\d{4}(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?$",
    r"^\d{4}-\d{1,2}-\d{1,2}(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?$",
    r"^\d{1,2}-\d{1,2}-\d{4}(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?$",
    r"^\d{4}/\d{1,2}/\d{1,2}(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?$",
)


def detect_date_columns(df: DataFrame, share: float = 0.7) -> list[str]:
    """Columns that hold dates: by name, or when over ``share`` of all filled values look like one.

    One aggregation reads the columns whose name says nothing; one row reaches the driver.
    Parse them with ``keep_unparsed``, so that the texts that are no dates survive.
    """
    by_name = {c for c in df.columns if any(w in c.lower() for w in DATE_COLUMN_WORDS)}
    rest = [c for c in df.columns if c not in by_name]
    looks: set[str] = set()
    if rest:
        shares = []
        for place, name in enumerate(rest):
            text = stripped(field(name).cast("string"))
            shaped = reduce(lambda a, b: a | b, [text.rlike(p) for p in DATE_SHAPES])
            usable = text.isNotNull() & ~F.lower(text).isin(*NO_DATE, "")
            shares.append(F.avg(F.when(usable, shaped.cast("int"))).alias(f"s{place}"))
        found = df.agg(*shares).first()
        looks = {name for place, name in enumerate(rest) if (found[f"s{place}"] or 0) > share}
    return [c for c in df.columns if c in by_name or c in looks]


def classify_landing(df: DataFrame) -> str:
    """``has_rows``, ``header_only`` or ``empty``."""
    if not df.columns:
        return "empty"
    return "header_only" if df.isEmpty() else "has_rows"


class HeadersNotRegistered(ValueError):
    """Data arrived for a table whose headers were never registered."""


def header_gate(df: DataFrame, registered: Collection[str] | None) -> DataFrame:
    """Let data through only when its table has registered headers and the data brings no other; no job runs.

    Registered columns may be missing from a delivery.
    """
    if not registered:
        raise HeadersNotRegistered("a file with the column headers has to be registered first")
    unknown = [c for c in df.columns if c not in set(registered)]
    if unknown:
        raise HeadersNotRegistered(f"columns {unknown} are not registered")
    return df


def append_raw(df: DataFrame, path: str | None = None) -> DataFrame:
    """Stamp ``created_at`` and ``updated_at`` and, given a path, append the rows there."""
    now = F.current_timestamp()
    stamped = df.withColumns({"created_at": now, "updated_at": now})
    if path is not None:
        stamped.write.mode("append").parquet(path)
    return stamped
