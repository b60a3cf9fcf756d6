"""Typed definitions of reports, filters and data-quality rules.

Everything here is small driver-side configuration.  It is validated when it is built, so that a
bad report definition fails before any Spark job starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

FILTER_OPERATORS = (
    "equal",
    "not_equal",
    "greater_than",
    "less_than",
    "greater_equal",
    "less_equal",
    "in",
    "not_in",
)

BUCKET_TYPES = ("equal", "greater_than", "less_than", "greater_equal", "less_equal", "between")

# Words that stand for a null literal in a filter value.
NULL_WORDS = ("null", "none", "")


def number_or_none(value: Any) -> float | None:
    """Python number for ``value`` (text allowed), or None when it is not one."""
    if value is None or isinstance(value, bool):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


@dataclass(frozen=True)
class Condition:
    """One filter term on a source column."""

    column: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.operator not in FILTER_OPERATORS:
            raise ValueError(f"unknown filter operator {self.operator!r}")
        if self.operator in ("in", "not_in") and (
            isinstance(self.value, str) or not isinstance(self.value, Sequence)
        ):
            raise ValueError(f"{self.operator} on {self.column!r} needs a list of values")
        if isinstance(self.value, str) and self.value.strip().lower() in NULL_WORDS:
            object.__setattr__(self, "value", None)

    @classmethod
    def parse(cls, item: Condition | Mapping[str, Any]) -> Condition:
        if isinstance(item, cls):
            return item
        return cls(item["column"], item["operator"], item.get("value"))


@dataclass(frozen=True)
class Bucket:
    """One conditional outcome of a formula: when the base value matches, use ``result``."""

    kind: str
    low: float | None
    high: float | None
    result: float

    @classmethod
    def parse(cls, item: Bucket | Mapping[str, Any]) -> Bucket:
        if isinstance(item, cls):
            return item
        result = number_or_none(item.get("formulaValue", "0"))
        return cls(
            str(item.get("conditionType", "")).lower(),
            number_or_none(item.get("value1")),
            number_or_none(item.get("value2")),
            0.0 if result is None else result,
        )


@dataclass(frozen=True)
class Formula:
    """A calculated column: ``name`` in upper case by convention, ``text`` an arithmetic expression."""

    name: str
    text: str
    buckets: tuple[Bucket, ...] = ()

    @property
    def output(self) -> str:
        return self.name.lower()

    @classmethod
    def parse(cls, item: Formula | Mapping[str, Any]) -> Formula | None:
        """Formula from a stored document; None when the name or the text is missing."""
        if isinstance(item, cls):
            return item
        name, text = item.get("logicNameKey"), item.get("formulaText")
        if not name or not text:
            return None
        return cls(name, text, tuple(Bucket.parse(b) for b in item.get("conditions") or ()))


@dataclass(frozen=True)
class Delta:
    name: str
    text: str

    @property
    def output(self) -> str:
        return self.name.lower()

    @classmethod
    def parse(cls, item: Delta | Mapping[str, Any]) -> Delta | None:
        if isinstance(item, cls):
            return item
        name, text = item.get("delta_column_name"), item.get("value")
        return cls(name, text) if name and text else None


@dataclass(frozen=True)
class Reason:
    label: str
    delta: str
    threshold: float = 0.0
    must_check: bool = False

    @classmethod
    def parse(cls, item: Reason | Mapping[str, Any]) -> Reason | None:
        if isinstance(item, cls):
            return item
        label, delta = item.get("reason"), item.get("delta_column")
        if not label or not delta:
            return None
        return cls(label, delta, float(item.get("threshold") or 0), bool(item.get("must_check")))


def _parsed(kind: type, items: Sequence[Any] | None) -> tuple:
    return tuple(p for p in map(kind.parse, items or ()) if p is not None)


@dataclass(frozen=True)
class ReportDefinition:
    """A reconciliation report: formulas per source, keys that join the sources, deltas, reasons."""

    name: str
    formulas: tuple[Formula, ...]
    mapping_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    conditions: Mapping[str, tuple[Condition, ...]] = field(default_factory=dict)
    deltas: tuple[Delta, ...] = ()
    reasons: tuple[Reason, ...] = ()

    def __post_init__(self) -> None:
        if not self.formulas:
            raise ValueError(f"report {self.name!r} has no usable formula")
        outputs = [f.output for f in self.formulas]
        repeated = sorted({o for o in outputs if outputs.count(o) > 1})
        if repeated:
            raise ValueError(f"report {self.name!r} defines {repeated} more than once")

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any]) -> ReportDefinition:
        return cls(
            name=doc["report_name"],
            formulas=_parsed(Formula, doc.get("formulas")),
            mapping_keys={s: tuple(k) for s, k in (doc.get("mapping_keys") or {}).items()},
            conditions={
                s: tuple(Condition.parse(c) for c in terms or ())
                for s, terms in (doc.get("conditions") or {}).items()
            },
            deltas=_parsed(Delta, doc.get("delta_columns")),
            reasons=_parsed(Reason, doc.get("reasons")),
        )


@dataclass(frozen=True)
class Rule:
    """A data-quality rule.  Build it with the functions of ``operators.quality``."""

    name: str
    kind: str
    column: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class CollectionConfig:
    """How a raw collection becomes a processed one."""

    fields: tuple[str, ...]
    unique_ids: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    date_fields: tuple[str, ...] | None = None
