"""tallybook: record reconciliation as Spark DataFrame jobs."""

from tallybook.config import (
    Bucket,
    CollectionConfig,
    Condition,
    Delta,
    Formula,
    Reason,
    ReportDefinition,
    Rule,
)

__all__ = [
    "Bucket",
    "CollectionConfig",
    "Condition",
    "Delta",
    "Formula",
    "Reason",
    "ReportDefinition",
    "Rule",
]
