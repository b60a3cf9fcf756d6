"""Summaries and listings over tables read as run logs, sessions, messages and registries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.keyed import REGISTRY, upload_registry
from catalog.registry import query, table
from tallybook.operators.stats import (
    issue_severity,
    message_stats,
    recent_runs,
    recent_uploads,
    run_stats,
    session_stats,
    sorted_names,
    status_counts,
    table_counts,
    workflow_summary,
)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as runs: purchases completed, errors failed, views still running."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "view", "running")
    )
    lasted = F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18,6)))")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("execution_id"),
        F.concat(F.lit("job"), "user_id").alias("job_id"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + lasted).alias("completed_at"),
    )


RUNS = """(SELECT event_id AS execution_id, 'job' || user_id AS job_id,
            CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
            END AS status, ts AS started_at, value FROM events)"""


@query(f"""
    SELECT count(*) AS total_runs, count(*) FILTER (status = 'completed') AS completed,
        count(*) FILTER (status = 'failed') AS failed,
        round(count(*) FILTER (status = 'completed')::DOUBLE
            / count(*) FILTER (status IN ('completed', 'failed')) * 100, 2) AS success_rate_percent,
        count(*) FILTER (started_at > TIMESTAMP '2024-01-29 12:00:00') AS recent_24h
    FROM {RUNS}
""")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return run_stats(run_log(spark, sf), dt.datetime(2024, 1, 30, 12))


@query(f"SELECT coalesce(status, 'unknown') AS status, count(*) AS runs FROM {RUNS} GROUP BY 1")
def run_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status_counts(run_log(spark, sf))


@query("""
    SELECT count(*) AS total_sessions, CAST(sum(k) AS BIGINT) AS total_files,
        CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE k END) AS BIGINT) AS successful_files,
        sum(CASE WHEN event_type = 'error' THEN 0 ELSE k END)::DOUBLE / sum(k) AS success_rate,
        round(avg(value), 6) AS average_processing_time, max(ts) AS last_download
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def session_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = F.get_json_object("props", "$.k").cast("long")
    sessions = table(spark, sf, "events").select(
        files.alias("total_files"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(files).alias("successful"),
        F.col("value").alias("processing_time"),
        F.col("ts").alias("timestamp"),
    )
    average = F.round("average_processing_time", 6)
    return session_stats(sessions).withColumn("average_processing_time", average)


@query("""
    WITH m AS (SELECT string_split(text, chr(10)) AS parts, role <> 'system' AS processed FROM conversations)
    SELECT count(*) AS total_messages, CAST(sum(len(parts)) AS BIGINT) AS total_attachments,
        CAST(sum(len(list_filter(parts, lambda x: length(x) > 40))) AS BIGINT) AS data_files,
        count(*) FILTER (processed)::DOUBLE / count(*) AS success_rate
    FROM m
""")
def message_totals(spark: SparkSession, sf: str) -> DataFrame:
    attachments = F.transform(
        F.split("text", "\n"), lambda line: F.struct((F.length(line) > 40).alias("is_data_file"))
    )
    messages = table(spark, sf, "conversations").select(
        attachments.alias("attachments"), (F.col("role") != "system").alias("processed")
    )
    return message_stats(messages)


@query("""
    SELECT count(*) AS total_files, count(*) FILTER (lang = 'en') AS successful_files,
        count(*) FILTER (lang = 'fr') AS failed_files, count(*) FILTER (lang NOT IN ('en', 'fr')) AS skipped_files,
        CAST(sum(n_chars) AS BIGINT) AS total_records,
        CAST(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS BIGINT) AS successful_records,
        sum(n_chars)::DOUBLE / 3600 AS records_per_second
    FROM documents
""")
def workflow_totals(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("lang") == "en", "success").when(F.col("lang") == "fr", "failed").otherwise("skipped")
    results = table(spark, sf, "documents").select(status.alias("status"), F.col("n_chars").alias("records"))
    return workflow_summary(results, 3600)


@query("""
    SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS high,
        count(*) FILTER (o_orderpriority IN ('2-HIGH', '3-MEDIUM')) AS medium,
        count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders
""")
def issue_totals(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    severity = (
        F.when(priority == "1-URGENT", "HIGH")
        .when(priority.isin("2-HIGH", "3-MEDIUM"), "Medium")
        .when(priority == "5-LOW", "low")
    )
    return issue_severity(table(spark, sf, "orders").select(severity.alias("severity")))


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES))
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table_counts({t: table(spark, sf, t) for t in TABLES})


@query(f"""
    SELECT upload_id, status, uploaded_at FROM {REGISTRY} WHERE datasource = 'SRC7' AND status = 'processed'
    ORDER BY uploaded_at DESC, upload_id DESC LIMIT 20
""")
def uploads_recent(spark: SparkSession, sf: str) -> DataFrame:
    newest = recent_uploads(upload_registry(spark, sf), "src7", "processed", limit=20)
    return newest.select("upload_id", "status", "uploaded_at")


@query(f"SELECT upload_id, status, uploaded_at FROM {REGISTRY} WHERE status = 'failed'")
def uploads_all(spark: SparkSession, sf: str) -> DataFrame:
    newest = recent_uploads(upload_registry(spark, sf), status="failed", limit=0)
    return newest.select("upload_id", "status", "uploaded_at")


@query(f"""
    SELECT execution_id, job_id, started_at, round(value, 6) AS duration_seconds FROM {RUNS}
    WHERE status = 'failed' ORDER BY started_at DESC, execution_id DESC LIMIT 50
""")
def runs_recent(spark: SparkSession, sf: str) -> DataFrame:
    newest = recent_runs(run_log(spark, sf), status="failed", limit=50)
    seconds = F.round("duration_seconds", 6).alias("duration_seconds")
    return newest.select("execution_id", "job_id", "started_at", seconds)


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def names_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return sorted_names(table(spark, sf, "documents"), "source")
