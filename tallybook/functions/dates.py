"""Date columns: ordered multi-format parsing, field detection by name, sanitising of whole rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import clean_text, field, stripped

# The accepted date layouts in the order they are tried, so ``01/02/2024`` is
# 2 January and ``15/01/2024`` falls through to day-first.  Single pattern letters also accept
# unpadded numbers.
DATE_LAYOUTS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d H:m",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "M-d-yyyy",
    "M-d-yyyy H:m:s",
    "M-d-yyyy H:m",
    "d/M/yyyy",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d-M-yyyy",
    "d-M-yyyy H:m:s",
    "d-M-yyyy H:m",
    "yyyy/M/d",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "d.M.yyyy",
    "yyyy.M.d",
)

# Texts that mean "no date".
NO_DATE = ("none", "null", "nan")

# A field whose name contains one of these words is treated as a date field.
DATE_WORDS = (
    "date", "time", "timestamp", "created", "updated", "modified",
    "dob", "birth", "expiry", "expires", "valid", "start", "end",
)

# Text shapes that tell which layouts can match at all.  Each text gets a code from its shape and its
# number of colons, and only the layouts of that code are tried, so a row costs one or two parse
# attempts instead of one per layout (a failed attempt is dear).
ISO_LAYOUTS = ("yyyy-M-d",)
_SHAPES = (
    (r"^\d{4}-", ISO_LAYOUTS),
    (r"^\d{1,2}/", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}-\d", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{4}/", ("yyyy/M/d",)),
    (r"^\d{1,2} [A-Za-z]", ("d MMM",)),
    (r"^[A-Za-z]", ("MMM",)),
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{1,2}\.", ("d.M.yyyy",)),
    (r"^\d{4}\.", ("yyyy.M.d",)),
)
_MANY_COLONS = 3


def _wall_clock(instant: Column) -> Column:
    return instant.cast(T.TimestampNTZType())


def _free_form(text: Column) -> Column:
    """ISO date and time such as ``2024-01-15T10:30:00Z``; one with an offset is read as UTC.

    Spark's own reading also takes bare years of any length, so other shapes are kept out.
    """
    parsed = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text))
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), _wall_clock(parsed))
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), in_utc.cast("timestamp")).otherwise(parsed)


def _layout_code(text: Column) -> Column:
    """Number of the shape and colon count of a text; null when no layout can match it."""
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    shape = F
    for i, (pattern, _) in enumerate(_SHAPES):
        shape = shape.when(text.rlike(pattern), F.lit(i * (_MANY_COLONS + 1)))
    return F.when(~F.lower(text).isin(*NO_DATE), shape) + F.least(colons, F.lit(_MANY_COLONS))


def _by_code(text: Column, code: Column) -> Column:
    """The text parsed by the layouts of its code, in layout order."""
    choice = F
    for i, (_, prefixes) in enumerate(_SHAPES):
        for colons in range(_MANY_COLONS + 1):
            fitting = [p for p in DATE_LAYOUTS if p.startswith(prefixes) and p.count(":") == colons]
            attempts = [F.try_to_timestamp(text, F.lit(p)) for p in fitting]
            if prefixes == ISO_LAYOUTS:
                attempts.append(_free_form(text))
            if attempts:
                choice = choice.when(code == i * (_MANY_COLONS + 1) + colons, F.coalesce(*attempts))
    return _wall_clock(choice)


def parse_date(c: Column) -> Column:
    """Date text to a wall-clock timestamp, trying every layout in order; null when none fits.

    ``parse_date_columns`` is faster where a frame is at hand.
    """
    text = stripped(c.cast("string"))
    # A one-element array serves to compute text and code once instead of in every branch.
    read = F.array(F.struct(text.alias("text"), _layout_code(text).alias("code")))
    return F.transform(read, lambda r: _by_code(r["text"], r["code"]))[0]


def parse_date_columns(df: DataFrame, names: Sequence[str], keep_unparsed: bool = False) -> DataFrame:
    """Replace date texts by timestamps; the values of ``parse_date``.

    Three plain projections: trimmed text, its layout code, the parsed value.  Each of them uses the
    one before several times, so Catalyst keeps them apart and every step is computed once.
    ``keep_unparsed`` adds ``<name>_raw`` with the texts that could not be parsed.
    """
    names = list(names)
    if not names:
        return df
    texts = {n: f"__text_{n}" for n in names}
    codes = {n: f"__code_{n}" for n in names}
    step = df.withColumns({texts[n]: stripped(field(n).cast("string")) for n in names})
    step = step.withColumns({codes[n]: _layout_code(field(texts[n])) for n in names})
    step = step.withColumns({n: _by_code(field(texts[n]), field(codes[n])) for n in names})
    out: list[Column] = []
    for c in df.columns:
        out.append(field(c))
        if keep_unparsed and c in names:
            left = F.when(field(c).isNull() & (field(texts[c]) != ""), field(texts[c]))
            out.append(left.alias(f"{c}_raw"))
    return step.select(*out)


def parse_with_hints(c: Column, hints: Sequence[str]) -> Column:
    """Date text by the layouts of one source only, in the given order."""
    if not hints:
        raise ValueError("at least one date layout is needed")
    text = stripped(c.cast("string"))
    return F.coalesce(*[_wall_clock(F.try_to_timestamp(text, F.lit(h))) for h in hints])


def is_date_name(name: str, words: Sequence[str] = DATE_WORDS) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def sanitize(
    df: DataFrame, fields: Sequence[str] | None = None, date_fields: Sequence[str] | None = None
) -> DataFrame:
    """Clean the selected fields: dates parsed, texts trimmed, absent fields null.

    ``date_fields=None`` finds date fields by name.  A Spark column has one type, so a date text
    that cannot be parsed moves to ``<name>_raw`` (only added for text columns); the parsed column
    is null there.
    """
    wanted = list(fields) if fields is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    dates, out = [], []
    for name in wanted:
        if name not in types:
            out.append(F.lit(None).cast("string").alias(name))
        elif not isinstance(types[name], T.StringType):
            out.append(field(name))
        elif name in date_fields if date_fields is not None else is_date_name(name):
            dates.append(name)
            out.append(field(name))
        else:
            out.append(clean_text(field(name)).alias(name))
    return parse_date_columns(df.select(*out), dates, keep_unparsed=True)


def order_date(df: DataFrame) -> Column:
    """First non-empty of the columns that may hold the order date, as far as ``df`` has them."""
    types = {f.name: f.dataType for f in df.schema.fields}
    # The accepted names, in order.
    present = [n for n in ("order_date", "orderDate", "date", "created_at") if n in types]
    if not present:
        return F.lit(None).cast(T.TimestampNTZType())
    cells = [
        clean_text(field(n)) if isinstance(types[n], T.StringType) else field(n) for n in present
    ]
    if len({types[n] for n in present}) > 1:
        cells = [c.cast("string") for c in cells]
    return F.coalesce(*cells)


def preset_window(preset: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a named reporting window, seen from ``today``."""
    # Days back to the first and to the last day.
    offsets = {"today": (0, 0), "yesterday": (1, 1), "last7days": (7, 0), "last30days": (30, 0)}
    if preset not in offsets:
        raise ValueError(f"unknown window {preset!r}; use one of {sorted(offsets)}")
    first, last = offsets[preset]
    return today - dt.timedelta(days=first), today - dt.timedelta(days=last)
