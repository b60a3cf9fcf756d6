"""Filters, projections, text, date and key columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from tallybook.functions.dates import order_date, parse_date_columns, parse_with_hints, sanitize
from tallybook.functions.keys import key_head, mapping_key, unique_id
from tallybook.functions.predicates import bucket_value, scan_filtered
from tallybook.functions.text import (
    batch_label,
    clean_strings,
    file_type,
    outcome_label,
    parse_amount,
    safe_name,
)
from tallybook.operators.projections import (
    cast_to_schema,
    date_window,
    drop_empty_rows,
    project_dashboard,
    rename_columns,
    select_fields,
    stamp,
)
from tallybook.sources.landing import detect_date_columns


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, which many do not have."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    terms = [
        {"column": "o_orderstatus", "operator": "equal", "value": "P"},
        {"column": "o_orderstatus", "operator": "equal", "value": "F"},
    ]
    return scan_filtered(table(spark, sf, "orders"), terms)


@query(f"SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM {LABELLED} WHERE quality IS NULL")
def filter_eq_null(spark: SparkSession, sf: str) -> DataFrame:
    terms = [{"column": "quality", "operator": "equal", "value": "null"}]
    return scan_filtered(labelled_documents(spark, sf), terms).select("doc_id", F.col("quality").cast("double"))


@query(f"""
    SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM {LABELLED} WHERE quality <> 1 OR quality IS NULL
""")
def filter_ne_null(spark: SparkSession, sf: str) -> DataFrame:
    terms = [{"column": "quality", "operator": "not_equal", "value": 1}]
    return scan_filtered(labelled_documents(spark, sf), terms).select("doc_id", F.col("quality").cast("double"))


@query(
    "SELECT * FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000"
    " AND o_orderdate > TIMESTAMP '1996-01-01' AND o_orderkey <= 5000000"
)
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    terms = [
        {"column": "o_totalprice", "operator": "greater_equal", "value": 50000},
        {"column": "o_totalprice", "operator": "less_than", "value": 200000.0},
        {"column": "o_orderdate", "operator": "greater_than", "value": dt.datetime(1996, 1, 1)},
        {"column": "o_orderkey", "operator": "less_equal", "value": 5_000_000},
    ]
    return scan_filtered(table(spark, sf, "orders"), terms)


@query(f"""
    SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM {LABELLED} WHERE quality IN (0) OR quality IS NULL
""")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    terms = [{"column": "quality", "operator": "in", "value": [0, None, "0"]}]
    return scan_filtered(labelled_documents(spark, sf), terms).select("doc_id", F.col("quality").cast("double"))


@query("SELECT * FROM events WHERE event_type NOT IN ('view', 'click')")
def filter_not_in(spark: SparkSession, sf: str) -> DataFrame:
    terms = [
        {"column": "event_type", "operator": "not_in", "value": ["view", "click", 3]},
        {"column": "value", "operator": "not_equal", "value": "12.31"},
    ]
    return scan_filtered(table(spark, sf, "events"), terms)


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_email, c_name FROM customer")
def select_missing(spark: SparkSession, sf: str) -> DataFrame:
    return select_fields(table(spark, sf, "customer"), ["c_custkey", "c_email", "c_name"])


@query("""
    SELECT c_custkey AS merchant_id, c_name AS payment_ref, c_nationkey, c_acctbal AS amount, c_mktsegment
    FROM customer
""")
def rename_map(spark: SparkSession, sf: str) -> DataFrame:
    names = {
        "c_custkey": "merchant_id", "c_name": "payment_ref", "c_acctbal": "amount",
        "c_unknown": "ignored", "c_mktsegment": "",
    }
    return rename_columns(table(spark, sf, "customer"), names)


@query("""
    SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price,
        CAST(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS DOUBLE) AS quantity,
        CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS day, l_shipdate AS moment, l_partkey AS part
    FROM lineitem
""")
def cast_schema(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    texts = lines.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("string").alias("price"),
        F.when(F.col("l_returnflag") == "N", "n/a")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("quantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.col("l_partkey").cast("string").alias("part"),
    )
    types = {
        "price": "decimal(10,2)", "quantity": "integer", "day": "date",
        "moment": "datetime", "part": "bigint", "nothing": "int",
    }
    typed = cast_to_schema(texts, types)
    typed = typed.withColumn("day", F.col("day").cast("timestamp_ntz"))
    return typed.withColumns({c: F.col(c).cast("double") for c in ("price", "quantity")})


@query("SELECT quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM labels")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    kept = drop_empty_rows(labelled_documents(spark, sf).select("quality", "toxic"))
    return kept.select(F.col("quality").cast("double"), F.col("toxic").cast("double"))


@query("SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'")
def date_window_preset(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return date_window(events, "ts", preset="last7days", today=dt.date(2024, 1, 15))


@query("""
    SELECT l_orderkey, l_linenumber,
        CASE WHEN l_discount BETWEEN 0.02 AND 0.05 THEN 10.0 WHEN l_discount > 0.08 THEN 20.0
             ELSE 0.0 END::DOUBLE AS bucket
    FROM lineitem
""")
def bucket_values(spark: SparkSession, sf: str) -> DataFrame:
    buckets = [
        {"conditionType": "between", "value1": "0.02", "value2": "0.05", "formulaValue": "10"},
        {"conditionType": "greater_than", "value1": "0.08", "formulaValue": "20"},
    ]
    value = bucket_value(F.col("l_discount"), buckets).alias("bucket")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value)


@query("SELECT o_orderkey, o_totalprice, o_orderdate AS order_date FROM orders")
def dashboard_projection(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "orderDate")
    return project_dashboard(orders, "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, true AS stamped FROM orders")
def stamped_orders(spark: SparkSession, sf: str) -> DataFrame:
    stamped = stamp(table(spark, sf, "orders"))
    return stamped.select("o_orderkey", F.col("processed_at").isNotNull().alias("stamped"))


BLANKS = r"(E' \t\n\r\x0B\x0C\x1C\x1D\x1E\x1F' || chr(133) || chr(160))"


@query(f"""
    SELECT doc_id, lang, source, n_chars, md5(nullif(trim(text, {BLANKS}), '')) AS text_hash FROM documents
""")
def cleaned_strings(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "documents").withColumn("source", F.concat(F.lit(" \t"), "source", F.lit("\n ")))
    clean = clean_strings(padded)
    return clean.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_hash"))


PRINTED = {
    "1-URGENT": "MM/dd/yyyy",
    "2-HIGH": "dd-MM-yyyy HH:mm",
    "3-MEDIUM": "d MMM yyyy",
    "4-NOT SPECIFIED": "yyyyMMdd",
    "5-LOW": "yyyy-MM-dd'T'HH:mm:ss'Z'",
}


def printed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their date printed in a layout that depends on the priority."""
    text = F
    for priority, layout in PRINTED.items():
        text = text.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", layout))
    return table(spark, sf, "orders").withColumn("printed", text.otherwise(F.lit("n/a")))


@query("""
    SELECT o_orderkey, CASE
        WHEN o_orderpriority = '2-HIGH' AND day(o_orderdate) <= 12
            THEN CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP)
        WHEN left(o_orderpriority, 1) IN ('1', '2', '3', '4', '5') THEN o_orderdate END AS parsed
    FROM orders
""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_date_columns(printed_orders(spark, sf), ["printed"])
    return parsed.select("o_orderkey", F.col("printed").alias("parsed"))


@query("SELECT o_orderkey, o_orderdate AS shipped, o_orderdate AS created, o_orderpriority FROM orders")
def detected_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The text columns that turn out to be dates, by content or by name, are parsed."""
    texts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("shipped"),
        F.date_format("o_orderdate", "d MMM yyyy").alias("created"),
        "o_orderpriority",
    )
    return parse_date_columns(texts, detect_date_columns(texts))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS seen,
        CASE WHEN o_orderkey % 5 = 0 THEN 'order ' || o_orderkey END AS seen_raw,
        CASE WHEN o_orderkey % 5 > 2 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') ELSE o_orderstatus END AS remark
    FROM orders
""")
def detected_dates_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A column that mostly holds dates is parsed and its other texts are kept; one that rarely does stays text."""
    day, rest = F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"), F.col("o_orderkey") % 5
    texts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(rest != 0, day).otherwise(F.concat(F.lit("order "), "o_orderkey")).alias("seen"),
        F.when(rest > 2, day).otherwise(F.col("o_orderstatus")).alias("remark"),
    )
    return parse_date_columns(texts, detect_date_columns(texts), keep_unparsed=True)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderdate END AS parsed
    FROM orders
""")
def hinted_dates(spark: SparkSession, sf: str) -> DataFrame:
    hints = ["MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    parsed = parse_with_hints(F.col("printed"), hints).alias("parsed")
    return printed_orders(spark, sf).select("o_orderkey", parsed)


@query("""
    SELECT o_orderkey, o_orderpriority AS priority,
        CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderdate END AS order_date,
        CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'soon' END AS order_date_raw,
        CAST(NULL AS VARCHAR) AS remark
    FROM orders
""")
def sanitized_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderpriority") == "3-MEDIUM", " soon ").otherwise(
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")
    )
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("  "), "o_orderpriority").alias("priority"), text.alias("order_date")
    )
    return sanitize(raw, ["o_orderkey", "priority", "order_date", "remark"])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS amount, CAST(NULL AS DOUBLE) AS unreadable FROM orders")
def parsed_amounts(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.format_string("%.2f", "o_totalprice")
    indian = F.regexp_replace(plain, r"(?<=\d)(?=(\d{2})*\d{3}\.)", ",")
    western = F.format_number("o_totalprice", 2)
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("₹ "), indian))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" Rs. "), western))
        .otherwise(plain)
    )
    orders = table(spark, sf, "orders")
    return orders.select(
        "o_orderkey",
        parse_amount(text).cast("double").alias("amount"),
        parse_amount(F.concat("o_orderpriority", text)).cast("double").alias("unreadable"),
    )


@query(r"""
    WITH n AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'),
                   '[^\w\s.-]', '', 'g')) AS name FROM pages),
         x AS (SELECT *, regexp_extract(name, '(\.[^.]*)$', 1) AS ext FROM n)
    SELECT page_id, CASE WHEN length(name) > 100
               THEN left(left(name, length(name) - length(ext)), 95) || ext ELSE name END AS safe,
        lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS kind
    FROM x
""")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    url = F.col("url")
    return pages.select("page_id", safe_name(url).alias("safe"), file_type(url).alias("kind"))


@query("SELECT event_id, user_id || '_' || event_type AS uid FROM events")
def unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    padded = events.withColumn("event_type", F.concat(F.lit(" "), "event_type"))
    return padded.select("event_id", unique_id(padded, ["user_id", "event_type"]).alias("uid"))


@query("""
    SELECT event_id, user_id || '_' || CASE WHEN microsecond(ts) % 1000000 = 0
            THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END
            || '_' || CAST(value AS VARCHAR) AS mapping_key,
        CAST(event_id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS no_key
    FROM events
""")
def mapping_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        mapping_key(events, ["user_id", "ts", "value"]).alias("mapping_key"),
        mapping_key(events, [], row_id="event_id").alias("row_key"),
        mapping_key(events, ["user_id", "missing"]).alias("no_key"),
    )


@query("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS head, CAST(NULL AS VARCHAR) AS no_head FROM orders
""")
def key_heads(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key = mapping_key(orders, ["o_orderkey", "o_orderdate"])
    return orders.select(
        "o_orderkey",
        key_head(key).alias("head"),
        key_head(F.col("o_orderpriority")).alias("no_head"),
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date
    FROM orders
""")
def order_dates(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(" ").alias("orderDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )
    return orders.select("o_orderkey", order_date(orders).alias("order_date"))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'error') AS exceptions,
        CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'perfect'
             WHEN count(*) FILTER (event_type = 'error') <= 10 THEN 'few_exceptions'
             ELSE 'many_exceptions' END AS outcome,
        CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'ok'
             WHEN count(*) FILTER (event_type = 'error') < count(*) THEN 'partial' ELSE 'failed' END AS batch
    FROM events GROUP BY user_id
""")
def outcome_labels(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    counts = events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("exceptions"), F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        "user_id",
        "exceptions",
        outcome_label(F.col("exceptions")).alias("outcome"),
        batch_label(F.col("n"), F.col("exceptions")).alias("batch"),
    )
