"""Data-quality rules evaluated in one pass over the rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.config import Rule
from tallybook.functions.rule_text import safe_predicate
from tallybook.functions.text import field
from tallybook.sources.splits import counted, write_split

_FAILED = "__failed"


def require_columns(*columns: str) -> list[Rule]:
    return [Rule(f"require_{c}", "require", c) for c in columns]


def non_null(*columns: str) -> list[Rule]:
    return [Rule(f"non_null_{c}", "non_null", c) for c in columns]


def valid_range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    return Rule(f"range_{column}", "range", column, {"min": low, "max": high})


def valid_dates(column: str, first: str | None = None, last: str | None = None) -> Rule:
    """Date limits as ``yyyy-MM-dd`` or ``today+N`` / ``today-N``."""
    return Rule(f"dates_{column}", "dates", column, {"min_date": first, "max_date": last})


def enum_set(column: str, values: Sequence[Any]) -> Rule:
    return Rule(f"enum_{column}", "enum", column, {"values": tuple(values)})


def readable(*columns: str) -> list[Rule]:
    """No cell of these columns was emptied because it could not be read (see ``rescued``)."""
    return [Rule(f"readable_{c}", "readable", c) for c in columns]


def business_rule(name: str, predicate: str) -> Rule:
    """A SQL predicate that must hold.  Unknown (null) counts as holding: an overflow, a quotient by zero, an unreadable text."""
    return Rule(name, "predicate", None, {"rule": predicate})


def rules_from_dict(config: Mapping[str, Any]) -> list[Rule]:
    """Rules from the ``dq_rules`` section of a source configuration."""
    rules = require_columns(*config.get("require_columns") or ())
    rules += non_null(*config.get("non_null") or ())
    for column, limits in (config.get("valid_range") or {}).items():
        if "min_date" in limits or "max_date" in limits:
            rules.append(valid_dates(column, limits.get("min_date"), limits.get("max_date")))
        else:
            rules.append(valid_range(column, limits.get("min"), limits.get("max")))
    rules += readable(*config.get("readable") or ())
    rules += [enum_set(c, v) for c, v in (config.get("enum_sets") or {}).items()]
    rules += [business_rule(r["name"], r["rule"]) for r in config.get("business_rules") or ()]
    return rules


def _day(text: str, today: dt.date) -> dt.date:
    relative = re.fullmatch(r"\s*today\s*(?:([+-])\s*(\d+))?\s*", text)
    if not relative:
        return dt.date.fromisoformat(text)
    days = int(relative[2] or 0)
    return today + dt.timedelta(days=-days if relative[1] == "-" else days)


def _exact(value: Any) -> Decimal | None:
    """The number that a value of a set stands for; None when it is none."""
    if isinstance(value, bool):
        return None
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def _not_in(c: Column, kind: T.DataType, values: Sequence[Any]) -> Column:
    """Values of the set are compared as numbers with a number column, else as text; others match nothing.

    Whole numbers and decimals are compared exactly, whatever their size.
    """
    if isinstance(kind, T.NumericType):
        numbers = [n for n in map(_exact, values) if n is not None]
        if isinstance(kind, T.IntegralType):
            usable = [int(n) for n in numbers if n == n.to_integral_value() and -(2**63) <= n < 2**63]
            c = c.cast("long")
        elif isinstance(kind, T.DecimalType):
            shift = Decimal(10) ** kind.scale
            usable = [F.lit(n).cast(kind) for n in numbers if n * shift == (n * shift).to_integral_value() and abs(n * shift) < Decimal(10) ** kind.precision]
        else:
            usable = [float(n) for n in numbers]
            c = c.cast("double")
        return ~c.isin(*usable) if usable else c.isNotNull()
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    return ~c.cast("string").isin(*texts) if texts else c.isNotNull()


def _broken(df: DataFrame, rule: Rule, today: dt.date, rescued: str | None = None) -> Column:
    """True where a row breaks the rule; a null value only breaks a non-null rule.

    A text that cannot be read as a number breaks a range.  A cell that typing emptied (it stands in ``rescued``) breaks every
    rule of its column but ``require``.
    """
    if rescued is None or rescued not in df.columns or rule.kind in ("predicate", "require") or rule.column not in df.columns:
        return F.lit(False) if rule.kind == "readable" else _broken_value(df, rule, today)
    lost = _rescued_text(rescued, rule.column).isNotNull()
    return lost if rule.kind == "readable" else lost | F.coalesce(_broken_value(df, rule, today), F.lit(False))


def _rescued_text(rescued: str, column: str) -> Column:
    """The text that a cell held before typing emptied it."""
    return F.get(F.filter(field(rescued), lambda c: c["field"] == column), F.lit(0))["value"]


def _broken_value(df: DataFrame, rule: Rule, today: dt.date) -> Column:
    if rule.kind == "predicate":
        return ~F.expr(safe_predicate(rule.options["rule"], df.schema))
    if rule.column not in df.columns:
        return F.lit(rule.kind in ("require", "non_null"))
    c = field(rule.column)
    if rule.kind == "require":
        return F.lit(False)
    if rule.kind == "non_null":
        return c.isNull()
    if rule.kind == "enum":
        return _not_in(c, df.schema[rule.column].dataType, rule.options["values"])
    if rule.kind == "range":
        low, high = rule.options.get("min"), rule.options.get("max")
        number = c if isinstance(df.schema[rule.column].dataType, T.NumericType) else c.cast("string").try_cast("double")
        tests = [number < low] if low is not None else []
        tests += [number > high] if high is not None else []
        if tests:
            return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], c.isNotNull() & number.isNull())
    elif rule.kind == "dates":
        first, last = rule.options.get("min_date"), rule.options.get("max_date")
        day = c.try_cast(T.DateType())
        tests = [day < F.lit(_day(first, today))] if first else []
        tests += [day > F.lit(_day(last, today))] if last else []
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    if not tests:
        return F.lit(False)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def with_failures(df: DataFrame, rules: Sequence[Rule], today: dt.date | None = None, rescued: str | None = None) -> DataFrame:
    """Add ``__failed``: rule, column and value of each rule that a row breaks.  A rescued cell shows the text it held."""
    today = today or dt.date.today()
    entries = []
    for rule in rules:
        value = field(rule.column).cast("string") if rule.column in df.columns else F.lit(None).cast("string")
        if rescued is not None and rule.column in df.columns:
            value = F.coalesce(value, _rescued_text(rescued, rule.column))
        entry = F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.column).cast("string").alias("column"),
            value.alias("value"),
        )
        entries.append(F.when(_broken(df, rule, today, rescued), entry))
    kind = "array<struct<rule:string,column:string,value:string>>"
    failed = F.array_compact(F.array(*entries)) if entries else F.array().cast(kind)
    return df.withColumn(_FAILED, failed)


def violations(
    df: DataFrame, rules: Sequence[Rule], key: str, today: dt.date | None = None, rescued: str | None = None
) -> DataFrame:
    """One row per broken rule and row: key, ``rule``, ``column``, ``value``."""
    # the outer form, so that Spark does not ask for the array's size first and build it twice
    exploded = with_failures(df, rules, today, rescued).select(field(key), F.explode_outer(_FAILED).alias("v"))
    return exploded.where("v.rule is not null").select(field(key), "v.rule", "v.column", "v.value")


def quarantine(
    df: DataFrame, rules: Sequence[Rule], today: dt.date | None = None, rescued: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the names of their ``failed_rules``.

    Both are lazy, so each computes ``df``; ``write_quarantine`` computes it once.
    """
    checked = with_failures(df, rules, today, rescued)
    good = checked.where(F.size(_FAILED) == 0).drop(_FAILED)
    bad = checked.where(F.size(_FAILED) > 0).withColumn("failed_rules", failed_names()).drop(_FAILED)
    return good, bad


def failed_names() -> Column:
    return F.transform(F.col(_FAILED), lambda v: v["rule"])


def judged(df: DataFrame, rules: Sequence[Rule], today: dt.date | None = None, rescued: str | None = None) -> DataFrame:
    """Add ``failed_rules`` and ``verdict``, ``good`` or ``bad``."""
    checked = with_failures(df, rules, today, rescued).withColumn("failed_rules", failed_names()).drop(_FAILED)
    return checked.withColumn("verdict", F.when(F.size("failed_rules") == 0, "good").otherwise("bad"))


def write_quarantine(
    df: DataFrame, rules: Sequence[Rule], path: str, today: dt.date | None = None, rescued: str | None = None
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``quarantine`` by one pass over the rows: both parts as written, and how many rows each has."""
    split = write_split(judged(df, rules, today, rescued), path, "verdict", **counted("verdict", "good", "bad"))
    return split.part("good").drop("failed_rules"), split.part("bad"), dict(split.figures)


def quality_report(
    df: DataFrame, rules: Sequence[Rule], today: dt.date | None = None, rescued: str | None = None
) -> DataFrame:
    """Per rule: ``failures`` and ``failure_rate``.  All rules are counted in one aggregation."""
    today = today or dt.date.today()
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_broken(df, r, today, rescued)).alias(f"f{i}") for i, r in enumerate(rules)],
    )
    lines = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("failures"))
            for i, r in enumerate(rules)
        ]
    )
    listed = counts.select("rows", F.explode(lines).alias("line"))
    rate = F.coalesce(F.try_divide(F.col("line.failures"), F.col("rows")), F.lit(0.0))
    return listed.select("line.rule", "line.failures", rate.alias("failure_rate"))
