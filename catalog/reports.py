"""Reconciliation reports over orders, line items and events."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from tallybook.config import ReportDefinition
from tallybook.functions.formula import calculated_columns
from tallybook.operators.stats import alert_flags, reason_breakdown, recon_summary
from tallybook.plans.batch import build_reports
from tallybook.plans.report import build_dashboard, build_report, keyed_source, refresh_report, source_accounts


def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Line items summed to order grain."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.round(F.sum(net), 4).alias("line_net"))


def order_definition(
    threshold: float = 50_000, status: str | None = "F", deltas=None, reasons=None
) -> ReportDefinition:
    """Orders against their line totals; orders of one status may be left out."""
    conditions = [{"column": "o_orderstatus", "operator": "not_equal", "value": status}]
    return ReportDefinition.from_dict({
        "report_name": "orders_vs_lines",
        "formulas": [
            {"logicNameKey": "TOTAL_SALES", "formulaText": "orders.o_totalprice"},
            {"logicNameKey": "LINE_NET", "formulaText": "lineitem.line_net"},
        ],
        "mapping_keys": {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]},
        "conditions": {"orders": conditions if status else []},
        "delta_columns": deltas
        or [{"delta_column_name": "SALES_DELTA", "value": "TOTAL_SALES - LINE_NET"}],
        "reasons": reasons
        or [
            {
                "reason": "AMOUNT_DIFF",
                "delta_column": "SALES_DELTA",
                "threshold": threshold,
                "must_check": True,
            }
        ],
    })


def order_report(spark: SparkSession, sf: str, definition: ReportDefinition | None = None) -> DataFrame:
    sources = {"orders": table(spark, sf, "orders"), "lineitem": line_totals(spark, sf)}
    return build_report(
        sources, definition or order_definition(), unique=["lineitem"], stamp=False
    )


LINES = """(SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS line_net
        FROM lineitem GROUP BY l_orderkey)"""

MERGED = f"""(SELECT CAST(o.o_orderkey AS VARCHAR) AS orders_mapping_key,
            CAST(l.l_orderkey AS VARCHAR) AS lineitem_mapping_key,
            o.o_totalprice AS total_sales, l.line_net,
            coalesce(o.o_totalprice, 0) - coalesce(l.line_net, 0) AS sales_delta
        FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o
        FULL JOIN {LINES} l ON o.o_orderkey = l.l_orderkey)"""

LABELLED = f"""(SELECT *, CASE WHEN abs(sales_delta) > 50000 THEN 'AMOUNT_DIFF' ELSE '' END AS reason,
            CASE WHEN abs(sales_delta) > 50000 THEN 'UNRECONCILED' ELSE 'RECONCILED' END
                AS reconciliation_status
        FROM {MERGED})"""


@query(f"SELECT * FROM {LABELLED}")
def report_orders_vs_lines(spark: SparkSession, sf: str) -> DataFrame:
    return order_report(spark, sf)


@query("""
    WITH o AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS ordered
               FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey),
         l AS (SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS shipped
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
         e AS (SELECT user_id, round(sum(value), 2) AS paid FROM events GROUP BY user_id),
         m AS (SELECT o.o_custkey AS a, l.o_custkey AS b, o.ordered, l.shipped
               FROM o FULL JOIN l ON o.o_custkey = l.o_custkey)
    SELECT CAST(m.a AS VARCHAR) AS sales_mapping_key, CAST(m.b AS VARCHAR) AS lines_mapping_key,
        CAST(e.user_id AS VARCHAR) AS clicks_mapping_key,
        m.ordered AS total_sales, m.shipped AS shipped, e.paid AS paid,
        CASE WHEN e.user_id IS NULL THEN NULL WHEN m.a IS NULL THEN 0.0
             ELSE CASE WHEN m.ordered = 0 THEN 0.0 ELSE e.paid / m.ordered END END AS paid_share,
        coalesce(m.ordered, 0) - coalesce(m.shipped, 0) AS ship_delta,
        coalesce(m.ordered, 0) - coalesce(m.shipped, 0) - coalesce(e.paid, 0) AS all_delta,
        CASE WHEN abs(coalesce(m.ordered, 0) - coalesce(m.shipped, 0)) > 500000 THEN 'SHIPPING' ELSE '' END
            AS reason,
        CASE WHEN abs(coalesce(m.ordered, 0) - coalesce(m.shipped, 0)) > 500000 THEN 'UNRECONCILED'
             ELSE 'RECONCILED' END AS reconciliation_status
    FROM m FULL JOIN e ON m.a = e.user_id
""")
def report_three_sources(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    sales = (
        orders.where(F.col("o_orderstatus").isin("O", "P"))
        .groupBy("o_custkey")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(net).alias("net"))
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.round(F.sum("net"), 4).alias("shipped"))
    )
    events = table(spark, sf, "events")
    clicks = events.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("paid"))
    definition = ReportDefinition.from_dict({
        "report_name": "customers",
        "formulas": [
            {"logicNameKey": "TOTAL_SALES", "formulaText": "sales.ordered"},
            {"logicNameKey": "SHIPPED", "formulaText": "lines.shipped"},
            {"logicNameKey": "PAID", "formulaText": "clicks.paid"},
            {"logicNameKey": "PAID_SHARE", "formulaText": "clicks.paid / TOTAL_SALES"},
        ],
        "mapping_keys": {"sales": ["o_custkey"], "lines": ["o_custkey"], "clicks": ["user_id"]},
        "delta_columns": [
            {"delta_column_name": "SHIP_DELTA", "value": "TOTAL_SALES - SHIPPED"},
            {"delta_column_name": "ALL_DELTA", "value": "SHIP_DELTA - PAID"},
        ],
        "reasons": [
            {"reason": "SHIPPING", "delta_column": "SHIP_DELTA", "threshold": 500_000, "must_check": True}
        ],
    })
    sources = {"sales": sales, "lines": lines, "clicks": clicks}
    return build_report(sources, definition, unique=list(sources), stamp=False)


@query("""
    WITH p AS (SELECT o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS k,
                   CAST(o_orderkey AS VARCHAR) AS id, o_totalprice
               FROM orders WHERE o_orderstatus <> 'F'),
         s AS (SELECT k, id, l_linenumber, l_extendedprice FROM (
                   SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber DESC, l_extendedprice DESC) AS rn
                   FROM (SELECT l_orderkey || '_' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS k,
                             CAST(l_orderkey AS VARCHAR) AS id, l_linenumber, l_extendedprice FROM lineitem))
               WHERE rn = 1),
         free AS (SELECT id, min(k) AS pk FROM p WHERE k NOT IN (SELECT k FROM s) GROUP BY id),
         rest AS (SELECT s.*, free.pk FROM s LEFT JOIN free ON s.id = free.id
                  WHERE s.k NOT IN (SELECT k FROM p)),
         claims AS (SELECT k, pk AS mk, l_extendedprice FROM (
                        SELECT *, row_number() OVER (PARTITION BY pk
                            ORDER BY l_linenumber DESC, l_extendedprice DESC, k DESC) AS rn
                        FROM rest WHERE pk IS NOT NULL) WHERE rn = 1),
         r AS (SELECT k, k AS mk, l_extendedprice FROM s WHERE k IN (SELECT k FROM p)
               UNION ALL SELECT k, mk, l_extendedprice FROM claims
               UNION ALL SELECT k, k, l_extendedprice FROM rest WHERE pk IS NULL)
    SELECT p.k AS orders_mapping_key, r.k AS lineitem_mapping_key, p.o_totalprice AS total_sales,
        r.l_extendedprice AS line_price,
        coalesce(p.o_totalprice, 0) - coalesce(r.l_extendedprice, 0) AS price_delta,
        '' AS reason, 'RECONCILED' AS reconciliation_status
    FROM p FULL JOIN r ON p.k = r.mk
""")
def report_fallback_key(spark: SparkSession, sf: str) -> DataFrame:
    definition = ReportDefinition.from_dict({
        "report_name": "fallback",
        "formulas": [
            {"logicNameKey": "TOTAL_SALES", "formulaText": "orders.o_totalprice"},
            {"logicNameKey": "LINE_PRICE", "formulaText": "lineitem.l_extendedprice"},
        ],
        "mapping_keys": {
            "orders": ["o_orderkey", "o_orderdate"],
            "lineitem": ["l_orderkey", "l_shipdate"],
        },
        "conditions": {
            "orders": [{"column": "o_orderstatus", "operator": "not_equal", "value": "F"}]
        },
        "delta_columns": [{"delta_column_name": "PRICE_DELTA", "value": "TOTAL_SALES - LINE_PRICE"}],
    })
    sources = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem")}
    order = {"lineitem": ["l_linenumber", "l_extendedprice"]}
    return build_report(sources, definition, order=order, fallback=True, stamp=False)


@query(f"""
    WITH stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice + 1 AS total_sales,
                        'first' AS note FROM orders WHERE o_orderstatus <> 'O'),
         l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, line_net FROM {LINES}),
         fresh AS (SELECT CAST(o.o_orderkey AS VARCHAR) AS k, l.k AS lk, o.o_totalprice AS total_sales, l.line_net
                   FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o
                   FULL JOIN l ON CAST(o.o_orderkey AS VARCHAR) = l.k)
    SELECT coalesce(s.k, f.k) AS orders_mapping_key, f.lk AS lineitem_mapping_key,
        CASE WHEN f.hit THEN f.total_sales ELSE s.total_sales END AS total_sales, f.line_net, s.note,
        coalesce(f.total_sales, 0) - coalesce(f.line_net, 0) AS sales_delta,
        CASE WHEN f.hit THEN CASE WHEN abs(coalesce(f.total_sales, 0) - coalesce(f.line_net, 0)) > 50000
             THEN 'AMOUNT_DIFF' ELSE '' END END AS reason
    FROM stored s FULL JOIN (SELECT *, true AS hit FROM fresh) f ON s.k = f.k
""")
def report_refresh(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    stored = orders.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").cast("string").alias("orders_mapping_key"),
        F.lit(None).cast("string").alias("lineitem_mapping_key"),
        (F.col("o_totalprice") + 1).alias("total_sales"),
        F.lit("first").alias("note"),
    )
    sources = {"orders": orders, "lineitem": line_totals(spark, sf)}
    merged = refresh_report(
        stored, sources, order_definition(), unique=["orders", "lineitem"], stamp=False
    )
    delta = F.coalesce(F.col("sales_delta"), F.lit(0.0)).alias("sales_delta")
    return merged.select(
        "orders_mapping_key", "lineitem_mapping_key", "total_sales", "line_net", "note", delta, "reason"
    )


@query("""
    WITH old AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
         new AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice, o_orderdate FROM orders
                 WHERE o_orderstatus <> 'O')
    SELECT coalesce(n.k, o.k) AS orders_mapping_key,
        CASE WHEN n.k IS NOT NULL THEN n.o_totalprice
             ELSE (SELECT o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) = o.k) END AS total_sales,
        coalesce(n.o_orderdate, o.o_orderdate) AS order_date,
        CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '2024-02-02 00:00:00'
             ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at,
        CASE WHEN o.k IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00'
             ELSE TIMESTAMP '2024-02-02 00:00:00' END AS created_at
    FROM old o FULL JOIN new n ON o.k = n.k
""")
def dashboard_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "order_date")
    sources = {"orders": orders, "lineitem": line_totals(spark, sf)}
    first, second = order_definition(status="F"), order_definition(status="O")
    options = {"unique": ["orders", "lineitem"], "stamp": False}
    days = [F.lit(f"2024-02-0{d} 00:00:00").cast("timestamp_ntz") for d in (1, 2)]
    board = build_dashboard(build_report(sources, first, **options), first, now=days[0])
    report = build_report(sources, second, **options)
    return build_dashboard(report, second, existing=board, now=days[1])


def over_lines(spark: SparkSession, sf: str, formulas: list[dict], *kept: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    names = [f["logicNameKey"].lower() for f in formulas]
    return calculated_columns(lines, formulas).select("l_orderkey", "l_linenumber", *kept, *names)


@query("""
    SELECT l_orderkey, l_linenumber, net, gross, gross / l_quantity AS unit,
        floor(gross / l_quantity / 7.0) AS steps, net * net AS squared
    FROM (SELECT *, net * (1 + l_tax) AS gross
          FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem))
""")
def formula_chain(spark: SparkSession, sf: str) -> DataFrame:
    return over_lines(spark, sf, [
        {"logicNameKey": "STEPS", "formulaText": "UNIT / 7 // 1"},
        {"logicNameKey": "UNIT", "formulaText": "GROSS / lineitem.l_quantity"},
        {"logicNameKey": "GROSS", "formulaText": "NET * (1 + lineitem.l_tax)"},
        {"logicNameKey": "NET", "formulaText": "lineitem.l_extendedprice * (1 - lineitem.l_discount)"},
        {"logicNameKey": "SQUARED", "formulaText": "NET ** 2"},
    ])


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_shipdate AS shipped,
        l_partkey AS part, l_quantity AS amount, CAST(0.0 AS DOUBLE) AS absent
    FROM lineitem
""")
def formula_direct(spark: SparkSession, sf: str) -> DataFrame:
    always = [{"conditionType": "greater_equal", "value1": "0", "formulaValue": "1"}]
    return over_lines(spark, sf, [
        {"logicNameKey": "FLAG", "formulaText": "lineitem.l_returnflag"},
        {"logicNameKey": "SHIPPED", "formulaText": "lineitem.l_shipdate"},
        {"logicNameKey": "PART", "formulaText": "lineitem.l_partkey"},
        {"logicNameKey": "AMOUNT", "formulaText": "lineitem.l_quantity", "conditions": always},
        {"logicNameKey": "ABSENT", "formulaText": "lineitem.l_nothing"},
    ])


@query("""
    SELECT l_orderkey, l_linenumber,
        CASE WHEN l_quantity = 1 THEN 0.5 WHEN l_quantity BETWEEN 2 AND 10 THEN 1.0
             WHEN l_quantity > 40 THEN 4.0 WHEN l_quantity < 20 THEN 2.0 ELSE 0.0 END::DOUBLE AS slab,
        CASE WHEN l_extendedprice >= 90000 THEN 3.0 WHEN l_extendedprice <= 1000 THEN 7.0
             ELSE 0.0 END::DOUBLE AS band
    FROM lineitem
""")
def formula_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return over_lines(spark, sf, [
        {
            "logicNameKey": "SLAB",
            "formulaText": "lineitem.l_quantity * 1",
            "conditions": [
                {"conditionType": "equal", "value1": "1", "formulaValue": "0.5"},
                {"conditionType": "between", "value1": "2", "value2": "10", "formulaValue": "1"},
                {"conditionType": "greater_than", "value1": "40", "formulaValue": "4"},
                {"conditionType": "less_than", "value1": "20", "formulaValue": "2"},
            ],
        },
        {
            "logicNameKey": "BAND",
            "formulaText": "lineitem.l_extendedprice + 0",
            "conditions": [
                {"conditionType": "greater_equal", "value1": "90000", "formulaValue": "3"},
                {"conditionType": "less_equal", "value1": "1000", "formulaValue": "7"},
            ],
        },
    ])


@query("""
    SELECT l_orderkey, l_linenumber,
        CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity / l_discount END AS ratio,
        CAST(0.0 AS DOUBLE) AS missing,
        CASE WHEN l_tax = 0 THEN 1.0 ELSE l_quantity / l_tax + 1 END AS shifted
    FROM lineitem
""")
def formula_div_zero(spark: SparkSession, sf: str) -> DataFrame:
    return over_lines(spark, sf, [
        {"logicNameKey": "RATIO", "formulaText": "lineitem.l_quantity / lineitem.l_discount"},
        {"logicNameKey": "MISSING", "formulaText": "NOT_THERE + lineitem.l_quantity"},
        {"logicNameKey": "PER_TAX", "formulaText": "lineitem.l_quantity / lineitem.l_tax"},
        {"logicNameKey": "SHIFTED", "formulaText": "PER_TAX + 1"},
    ]).drop("per_tax")


@query(f"""
    SELECT orders_mapping_key, lineitem_mapping_key, total_sales, line_net, sales_delta,
        sales_delta * 2 - coalesce(line_net, 0) AS twice,
        CASE WHEN coalesce(line_net, 0) = 0 THEN 0.0 ELSE coalesce(total_sales, 0) / line_net END AS ratio,
        sales_delta + 1 AS shifted, '' AS reason, 'RECONCILED' AS reconciliation_status
    FROM {MERGED}
""")
def delta_chain(spark: SparkSession, sf: str) -> DataFrame:
    deltas = [
        {"delta_column_name": "SALES_DELTA", "value": "TOTAL_SALES - LINE_NET"},
        {"delta_column_name": "TWICE", "value": "SALES_DELTA * 2 - LINE_NET"},
        {"delta_column_name": "RATIO", "value": "TOTAL_SALES / LINE_NET"},
        {"delta_column_name": "SHIFTED", "value": "sales_delta + NOWHERE + 1"},
    ]
    never = [{"reason": "NEVER", "delta_column": "NOWHERE", "threshold": 0, "must_check": True}]
    return order_report(spark, sf, order_definition(deltas=deltas, reasons=never))


STEPS = [
    {"reason": "Any gap", "delta_column": "SALES_DELTA", "threshold": 1000, "must_check": True},
    {"reason": "Large gap", "delta_column": "SALES_DELTA", "threshold": 50000, "must_check": False},
    {"reason": "Huge gap", "delta_column": "SALES_DELTA", "threshold": -200000, "must_check": True},
    {"reason": "Small gap", "delta_column": "SALES_DELTA", "threshold": 10, "must_check": False},
]

STEPPED = f"""(SELECT *, CASE WHEN abs(sales_delta) > 200000 THEN 'Any gap, Huge gap'
                WHEN abs(sales_delta) > 1000 THEN 'Any gap'
                WHEN abs(sales_delta) > 10 THEN 'Small gap' ELSE '' END AS reason
        FROM {MERGED})"""


@query(f"""
    SELECT *, CASE WHEN reason <> '' THEN 'UNRECONCILED' ELSE 'RECONCILED' END AS reconciliation_status
    FROM {STEPPED}
""")
def reasons_must_check(spark: SparkSession, sf: str) -> DataFrame:
    return order_report(spark, sf, order_definition(reasons=STEPS))


@query(f"""
    SELECT reason, count(*) AS rows
    FROM (SELECT unnest(string_split(reason, ', ')) AS reason FROM {STEPPED} WHERE reason <> '')
    GROUP BY reason
""")
def reasons_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return reason_breakdown(order_report(spark, sf, order_definition(reasons=STEPS)))


SUMMARY = f"""
    WITH r AS (SELECT reconciliation_status = 'RECONCILED' AS ok, reason AS kind,
                   coalesce(sales_delta, 0) AS amount,
                   CASE WHEN abs(sales_delta) >= 200000 THEN 'high'
                        WHEN abs(sales_delta) >= 100000 THEN 'medium' ELSE 'low' END AS severity
               FROM {LABELLED}),
         s AS (SELECT kind AS exception_type, severity, count(*) AS rows, round(sum(amount), 2) AS amount_at_risk,
                   CAST(NULL AS DOUBLE) AS match_rate, count(*) AS exceptions
               FROM r WHERE NOT ok GROUP BY ALL
               UNION ALL
               SELECT 'TOTAL', 'ALL', count(*), round(coalesce(sum(amount) FILTER (NOT ok), 0), 2),
                   round(100.0 * count(*) FILTER (ok) / count(*), 6), count(*) FILTER (NOT ok) FROM r)
"""


def order_summary(spark: SparkSession, sf: str) -> DataFrame:
    fine = F.col("reconciliation_status") == "RECONCILED"
    report = order_report(spark, sf)
    return recon_summary(report, fine, "sales_delta", "reason", medium=100_000, high=200_000)


@query(SUMMARY + "SELECT * FROM s")
def recon_totals(spark: SparkSession, sf: str) -> DataFrame:
    return order_summary(spark, sf).withColumns({
        "amount_at_risk": F.round("amount_at_risk", 2), "match_rate": F.round("match_rate", 6),
    })


@query(SUMMARY + """
    SELECT exceptions * 1.0 / rows > 0.05 AS exception_rate_alert,
        abs(amount_at_risk) > 10000 AS amount_variance_alert, true AS processing_time_alert
    FROM s WHERE exception_type = 'TOTAL' AND severity = 'ALL'
""")
def recon_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alert_flags(order_summary(spark, sf), minutes=95)


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 9 <> 4 THEN user_id END AS k FROM events)
    SELECT 'events' AS source, count(*) AS read, count(*) FILTER (event_type = 'signup') AS filtered,
        count(*) FILTER (event_type <> 'signup' AND k IS NULL) AS skipped,
        count(k) FILTER (event_type <> 'signup') - count(DISTINCT k) FILTER (event_type <> 'signup') AS superseded,
        count(DISTINCT k) FILTER (event_type <> 'signup') AS merged FROM e
    UNION ALL SELECT 'customer', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FROM customer
""")
def report_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of every source row: rows without mapping key vanish from the report, not from the numbers."""
    sources, definition = customer_events(spark, sf)
    return source_accounts(sources, definition)


@query("""
    SELECT event_id, CASE WHEN event_id % 9 <> 4 AND event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS events_mapping_key FROM events
""")
def report_keys_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The report key written back to the rows of a source."""
    sources, definition = customer_events(spark, sf)
    return keyed_source("events", sources["events"], definition).select("event_id", "events_mapping_key")


def customer_events(spark: SparkSession, sf: str):
    """Customers against their events, some of which have no user."""
    events = table(spark, sf, "events").withColumn("user_id", F.when(F.col("event_id") % 9 != 4, F.col("user_id")))
    definition = ReportDefinition.from_dict({
        "report_name": "customer_events",
        "formulas": [{"logicNameKey": "BALANCE", "formulaText": "customer.c_acctbal"}, {"logicNameKey": "SPENT", "formulaText": "events.value"}],
        "mapping_keys": {"customer": ["c_custkey"], "events": ["user_id"]},
        "conditions": {"events": [{"column": "event_type", "operator": "not_equal", "value": "signup"}]},
    })
    return {"customer": table(spark, sf, "customer"), "events": events}, definition


@query(f"""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END AS price FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS orders_mapping_key, price AS total_sales, line_net,
        CASE WHEN o_orderkey % 100 = 0 THEN 'new' ELSE 'old' END AS state
    FROM o JOIN {LINES} ON o_orderkey = l_orderkey
""")
def report_refresh_changed(spark: SparkSession, sf: str) -> DataFrame:
    """One order in a hundred has another price: only their keys are computed again, every other row stays."""
    orders, lines = table(spark, sf, "orders"), line_totals(spark, sf)
    definition = order_definition(status=None)
    stored = build_report({"orders": orders, "lineitem": lines}, definition, unique=["orders", "lineitem"], stamp=False).withColumn("total_before", F.col("total_sales"))
    altered = orders.where("o_orderkey % 100 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1000)
    now = {"orders": orders.where("o_orderkey % 100 <> 0").unionByName(altered), "lineitem": lines}
    fresh = refresh_report(stored, now, definition, changed={"orders": altered}, unique=["orders", "lineitem"], stamp=False)
    state = F.when(F.col("total_sales") == F.col("total_before"), "old").otherwise("new").alias("state")
    return fresh.where("lineitem_mapping_key IS NOT NULL AND orders_mapping_key IS NOT NULL").select("orders_mapping_key", "total_sales", "line_net", state)


def _run_sql(name: str, status: str, threshold: int) -> str:
    return f"""SELECT '{name}' AS report_name, CAST(o.o_orderkey AS VARCHAR) AS orders_mapping_key,
            CAST(l.l_orderkey AS VARCHAR) AS lineitem_mapping_key, o.o_totalprice AS total_sales, l.line_net,
            coalesce(o.o_totalprice, 0) - coalesce(l.line_net, 0) AS sales_delta,
            CASE WHEN abs(coalesce(o.o_totalprice, 0) - coalesce(l.line_net, 0)) > {threshold} THEN 'AMOUNT_DIFF' ELSE '' END AS reason,
            CASE WHEN abs(coalesce(o.o_totalprice, 0) - coalesce(l.line_net, 0)) > {threshold} THEN 'UNRECONCILED' ELSE 'RECONCILED' END
                AS reconciliation_status
        FROM (SELECT * FROM orders WHERE o_orderstatus <> '{status}') o FULL JOIN {LINES} l ON o.o_orderkey = l.l_orderkey"""


@query(" UNION ALL ".join([_run_sql("closed", "F", 50_000), _run_sql("open", "O", 10_000), _run_sql("all", "-", 100_000)]))
def reports_in_one_run(spark: SparkSession, sf: str) -> DataFrame:
    """Three reports over orders and line totals from one reading of each source."""
    wanted = {"closed": ("F", 50_000), "open": ("O", 10_000), "all": (None, 100_000)}
    definitions = [dataclasses.replace(order_definition(threshold, status), name=name) for name, (status, threshold) in wanted.items()]
    sources = {"orders": table(spark, sf, "orders"), "lineitem": line_totals(spark, sf)}
    found = build_reports(sources, definitions, stamp=False)
    return reduce(DataFrame.union, [df.withColumn("report_name", F.lit(name)) for name, df in found.items()])
