"""Text clean-up columns: trimming, amounts, file names, outcome labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: characters stripped from both ends of a text cell.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Trim a text column; an empty text becomes null."""
    text = stripped(c)
    return F.when(text != "", text)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> str:
    """Column name quoted for use where dots and spaces would be parsed."""
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    return F.col(quoted(name))


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every text column of ``df`` in one projection; empty becomes null."""
    texts = set(string_columns(df))
    return df.select(
        *[clean_text(field(c)).alias(c) if c in texts else field(c) for c in df.columns]
    )


def parse_amount(c: Column, locale: str = "en_IN", precision: int = 18, scale: int = 2) -> Column:
    """Amount text to decimal: currency signs, blanks and grouping commas are dropped.

    Indian (``1,23,456.78``) and Western (``123,456.78``) grouping both use commas for groups and
    a point for decimals, so one rule reads both; ``de_DE``-like locales swap the two signs.
    A text that still is no plain number gives null.
    """
    text = stripped(c.cast("string"))
    if locale in ("de_DE", "es_ES", "it_IT"):
        text = F.translate(F.regexp_replace(text, r"\.", ""), ",", ".")
    text = F.regexp_replace(text, r"(?i)^(-?)\s*(?:₹|rs\.?|inr|\$|€|£)\s*", "$1")
    text = F.translate(text, ", ", "")
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    return F.when(plain, text).try_cast(T.DecimalType(precision, scale))


# Signs of a file name that become ``_``, signs that are dropped, and the lengths of long names.
RESERVED_SIGNS = r'[<>:"/\\|?*]'
OTHER_SIGNS = r"(?U)[^\w\s.-]"
LONGEST_NAME, KEPT_STEM = 100, 95


def safe_name(c: Column) -> Column:
    """File name that is safe to store: reserved signs become ``_``, other symbols are dropped.

    A name of over 100 characters keeps its first 95 characters before the extension.
    """
    name = F.regexp_replace(c, RESERVED_SIGNS, "_")
    name = F.regexp_replace(name, OTHER_SIGNS, "")
    name = stripped(name)
    extension = F.regexp_extract(name, r"^.*[^.].*?(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    short = F.concat(F.substring(stem, 1, KEPT_STEM), extension)
    return F.when(F.length(name) > LONGEST_NAME, short).otherwise(name)


def file_type(c: Column) -> Column:
    """Lower-case extension without its dot; empty when there is none."""
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))


def outcome_label(exceptions: Column, rate: Column | None = None) -> Column:
    """Headline of a match run: ``perfect``, ``few_exceptions`` (1 to 10) or ``many_exceptions``.

    With a match rate (percent) given, a run without exceptions is perfect only from 95 up.
    """
    clean = exceptions == 0
    if rate is not None:
        clean = clean & (rate >= 95)
    return (
        F.when(clean, "perfect")
        .when((exceptions >= 1) & (exceptions <= 10), "few_exceptions")
        .otherwise("many_exceptions")
    )


def batch_label(total: Column, failed: Column) -> Column:
    """``ok`` when nothing failed, ``partial`` when something did, ``failed`` when all did."""
    return F.when(failed == 0, "ok").when(failed < total, "partial").otherwise("failed")
