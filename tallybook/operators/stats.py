"""Summaries of runs, sessions, messages, loads and reports, and listings of recent records."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import clean_text, field


def _rows() -> Column:
    return F.count(F.lit(1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def status_counts(runs: DataFrame) -> DataFrame:
    """Runs per status; a run without one counts as ``unknown``."""
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    return runs.groupBy(status.alias("status")).agg(_rows().alias("runs"))


def run_stats(runs: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """One row: runs, completed, failed, success rate (% of finished), runs of the last 24 hours."""
    end = now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    completed = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    recent = F.col("started_at").cast("timestamp_ntz") > end - F.expr("interval 24 hours")
    return runs.agg(
        _rows().alias("total_runs"),
        completed.alias("completed"),
        failed.alias("failed"),
        F.round(_ratio(completed, completed + failed) * 100, 2).alias("success_rate_percent"),
        F.count_if(recent).alias("recent_24h"),
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """One row over download sessions (``total_files, successful, processing_time, timestamp``)."""
    files = F.coalesce(F.sum("total_files"), F.lit(0))
    good = F.coalesce(F.sum("successful"), F.lit(0))
    return sessions.agg(
        _rows().alias("total_sessions"),
        files.alias("total_files"),
        good.alias("successful_files"),
        _ratio(good, files).alias("success_rate"),
        F.avg("processing_time").alias("average_processing_time"),
        F.max("timestamp").alias("last_download"),
    )


def message_stats(messages: DataFrame) -> DataFrame:
    """One row over messages (``attachments`` array with ``is_data_file``, flag ``processed``)."""
    data_files = F.size(
        F.filter("attachments", lambda a: F.coalesce(a["is_data_file"], F.lit(False)))
    )
    attached = F.coalesce(F.size(F.coalesce("attachments", F.array())), F.lit(0))
    return messages.agg(
        _rows().alias("total_messages"),
        F.coalesce(F.sum(attached), F.lit(0)).alias("total_attachments"),
        F.coalesce(F.sum(F.greatest(data_files, F.lit(0))), F.lit(0)).alias("data_files"),
        _ratio(F.count_if(F.col("processed")), _rows()).alias("success_rate"),
    )


def workflow_summary(results: DataFrame, seconds: float | Column) -> DataFrame:
    """One row over upload results (``status`` of success, failed, skipped; ``records``)."""
    spent = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    total = F.coalesce(F.sum("records"), F.lit(0))
    return results.agg(
        _rows().alias("total_files"),
        F.count_if(F.col("status") == "success").alias("successful_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        total.alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("records"))), F.lit(0)).alias(
            "successful_records"
        ),
        F.coalesce(F.try_divide(total.cast("double"), spent), F.lit(0.0)).alias("records_per_second"),
    )


def severity_of(amount: Column, medium: float, high: float) -> Column:
    """Severity of an exception by the size of its amount."""
    size = F.abs(F.coalesce(amount, F.lit(0.0)))
    return F.when(size >= high, "high").when(size >= medium, "medium").otherwise("low")


def recon_summary(
    report: DataFrame,
    matched: Column,
    amount: str,
    kind: str,
    medium: float = 1_000.0,
    high: float = 10_000.0,
) -> DataFrame:
    """One line per exception kind and severity, and a line ``TOTAL``/``ALL`` for the whole report.

    ``matched`` says which rows are fine; ``kind`` is the column that classifies the others.  The
    report is read once: lines and total both come from its few (kind, severity) groups.
    """
    label = F.when(matched, F.lit("MATCHED")).otherwise(F.coalesce(field(kind), F.lit("UNKNOWN")))
    severity = F.when(matched, F.lit("none")).otherwise(severity_of(field(amount), medium, high))
    fine = F.when(matched, 1).otherwise(0)
    groups = report.groupBy(
        label.alias("exception_type"), severity.alias("severity"), fine.alias("__fine")
    ).agg(_rows().alias("__n"), F.sum(F.coalesce(field(amount), F.lit(0.0))).alias("__amount"))
    # One group of no rows, so that an empty report has a total line as well.
    none = report.sparkSession.range(1).select(
        F.lit("MATCHED").alias("exception_type"),
        F.lit("none").alias("severity"),
        F.lit(1).alias("__fine"),
        F.lit(0).cast("long").alias("__n"),
        F.lit(0.0).alias("__amount"),
    )
    is_fine = F.col("__fine") == 1
    sets = [["exception_type", "severity"], []]
    lines = (
        groups.unionByName(none)
        .groupingSets(sets, "exception_type", "severity")
        .agg(
            (F.grouping_id() > 0).alias("__total"),
            F.min("__fine").alias("__fine"),
            F.sum("__n").alias("rows"),
            F.coalesce(F.sum(F.when(is_fine, F.col("__n"))), F.lit(0)).alias("__good"),
            F.coalesce(F.sum(F.when(~is_fine, F.col("__amount"))), F.lit(0.0)).alias("amount_at_risk"),
        )
        .where(F.col("__total") | (F.col("__fine") == 0))
    )
    total = F.col("__total")
    return lines.select(
        F.when(total, "TOTAL").otherwise(F.col("exception_type")).alias("exception_type"),
        F.when(total, "ALL").otherwise(F.col("severity")).alias("severity"),
        "rows",
        "amount_at_risk",
        F.when(total, _ratio(F.col("__good"), F.col("rows")) * 100).alias("match_rate"),
        (F.col("rows") - F.col("__good")).alias("exceptions"),
    )


def alert_flags(
    summary: DataFrame,
    minutes: float,
    exception_rate: float = 0.05,
    amount_variance: float = 10_000.0,
    processing_minutes: float = 90.0,
) -> DataFrame:
    """One row of alert flags from the total line of ``recon_summary``."""
    total = summary.where((F.col("exception_type") == "TOTAL") & (F.col("severity") == "ALL"))
    return total.select(
        (_ratio(F.col("exceptions"), F.col("rows")) > exception_rate).alias("exception_rate_alert"),
        (F.abs("amount_at_risk") > amount_variance).alias("amount_variance_alert"),
        F.lit(minutes > processing_minutes).alias("processing_time_alert"),
    )


def issue_severity(issues: DataFrame) -> DataFrame:
    """One row: issues of high, medium and low severity, whatever the letter case."""
    level = F.lower(F.coalesce(F.col("severity"), F.lit("")))
    return issues.agg(*[F.count_if(level == s).alias(s) for s in ("high", "medium", "low")])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.lit(name).alias("table_name"), _rows().alias("rows")) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def reason_breakdown(report: DataFrame) -> DataFrame:
    """Rows per single reason of the joined reason text.

    The report is first reduced to its few different texts, which are then taken apart.
    """
    texts = report.where(F.col("reason") != "").groupBy("reason").agg(_rows().alias("n"))
    single = texts.select(F.explode(F.split("reason", ", ")).alias("reason"), "n")
    return single.groupBy("reason").agg(F.sum("n").alias("rows"))


def recent_uploads(
    registry: DataFrame, datasource: str | None = None, status: str | None = None, limit: int = 100
) -> DataFrame:
    """Uploads, newest first; a limit of 0 keeps all.  Datasources are stored in upper case."""
    if datasource:
        registry = registry.where(F.col("datasource") == datasource.upper())
    if status:
        registry = registry.where(F.col("status") == status)
    ordered = registry.orderBy(F.desc_nulls_last("uploaded_at"), F.desc("upload_id"))
    return ordered.limit(limit) if limit else ordered


def recent_runs(
    runs: DataFrame, job_id: str | None = None, status: str | None = None, limit: int = 100
) -> DataFrame:
    """Runs, newest first, with their duration in seconds; a limit of 0 keeps all."""
    if job_id:
        runs = runs.where(F.col("job_id") == job_id)
    if status:
        runs = runs.where(F.col("status") == status)
    # As an interval of wall-clock times this does not depend on the session time zone.
    lasted = F.col("completed_at").cast("timestamp_ntz") - F.col("started_at").cast("timestamp_ntz")
    units = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}
    parts = [F.extract(F.lit(u), lasted).cast("double") * F.lit(n) for u, n in units.items()]
    timed = runs.withColumn("duration_seconds", reduce(lambda a, b: a + b, parts))
    ordered = timed.orderBy(F.desc_nulls_last("started_at"), F.desc("execution_id"))
    return ordered.limit(limit) if limit else ordered


def sorted_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty names in order."""
    name = clean_text(field(column)).alias(column)
    return df.select(name).where(field(column).isNotNull()).distinct().orderBy(field(column))
