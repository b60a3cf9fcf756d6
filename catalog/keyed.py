"""Joins, upserts, duplicates and matching over keyed tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from tallybook.config import CollectionConfig
from tallybook.operators.joins import (
    chain_match,
    keys_present,
    merge_on_key,
    merge_with_fallback,
    settlement_match,
    unmatched,
)
from tallybook.operators.stored import store
from tallybook.operators.tables import (
    archive_processed,
    change_counts,
    change_labels,
    combine_sources,
    duplicate_rows,
    latest_per_key,
    observed_fields,
    set_status,
    status_changes,
    upsert,
    write_archive,
)
from tallybook.plans.collection import process_collection
from tallybook.plans.match import match_sources
from tallybook.sources.files import scratch_folder


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Print whole-number columns that may be null as doubles."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("""
    SELECT coalesce(c.c_custkey, u.user_id) AS id, c.c_name, c.c_acctbal, u.paid
    FROM customer c FULL JOIN (SELECT user_id, round(sum(value), 2) AS paid FROM events GROUP BY user_id) u
        ON c.c_custkey = u.user_id
""")
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    paid = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.round(F.sum("value"), 2).alias("paid")
    )
    return merge_on_key(customers, paid, ["id"])


@query("""
    WITH p AS (SELECT o_orderkey || '_' || o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS id,
                   o_totalprice FROM orders),
         s AS (SELECT l_orderkey || '_' || l_returnflag AS key, CAST(l_orderkey AS VARCHAR) AS id,
                   max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
    SELECT p.key, p.o_totalprice, s.key AS secondary_key, s.price
    FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price DESC, key DESC) AS rn FROM s) s
        ON p.id = s.id AND s.rn = 1
""")
def merged_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.concat_ws("_", "o_orderkey", "o_orderpriority").alias("key"), "o_totalprice"
    )
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.concat_ws("_", "l_orderkey", "l_returnflag").alias("key"))
        .agg(F.max("l_extendedprice").alias("price"))
    )
    return merge_with_fallback(orders, lines, "key", order=["price"])


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def present_keys(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return keys_present(table(spark, sf, "customer"), known, ["c_custkey"])


@query("""
    SELECT id, name, CAST(NULL AS VARCHAR) AS event_type, 'left_only' AS side
    FROM (SELECT c_custkey AS id, c_name AS name FROM customer) WHERE id NOT IN (SELECT user_id FROM events)
    UNION ALL
    SELECT user_id, NULL, event_type, 'right_only' FROM events
    WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)
        AND user_id NOT IN (SELECT c_custkey FROM customer)
""")
def unmatched_sides(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")
    return unmatched(customers, events, ["id"], hot_rows=50)


def order_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A stored orders table without open orders, and an update without finished ones.

    Urgent orders arrive with a higher price; every order arrives twice, the second time with the
    later version.
    """
    orders = table(spark, sf, "orders")
    stored = orders.where("o_orderstatus <> 'O'").withColumn("note", F.lit("old"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    fresh = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.when(urgent, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice"))
    )
    first = fresh.withColumns({"o_totalprice": F.lit(0.0), "version": F.lit(1)})
    return stored, first.unionByName(fresh.withColumn("version", F.lit(2)))


FRESH = """(SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 10
            ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderstatus <> 'F')"""


@query(f"""
    SELECT coalesce(s.o_orderkey, f.o_orderkey) AS o_orderkey,
        coalesce(f.o_totalprice, s.o_totalprice) AS o_totalprice, s.note,
        coalesce(f.o_orderstatus, s.o_orderstatus) AS o_orderstatus,
        CASE WHEN f.o_orderkey IS NOT NULL THEN 2.0 END::DOUBLE AS version
    FROM (SELECT *, 'old' AS note FROM orders WHERE o_orderstatus <> 'O') s
    FULL JOIN {FRESH} f ON s.o_orderkey = f.o_orderkey
""")
def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = order_tables(spark, sf)
    merged = upsert(stored, incoming, "o_orderkey", order=["version"])
    kept = merged.select("o_orderkey", "o_totalprice", "note", "o_orderstatus", "version")
    return as_double(kept, "version")


@query(f"""
    SELECT coalesce(s.o_orderkey, f.o_orderkey)::DOUBLE AS o_orderkey, coalesce(f.o_totalprice, s.o_totalprice) AS o_totalprice, s.note,
        coalesce(f.o_orderstatus, s.o_orderstatus) AS o_orderstatus, CASE WHEN f.o_orderkey IS NOT NULL THEN 2.0 END::DOUBLE AS version
    FROM (SELECT *, 'old' AS note FROM orders WHERE o_orderstatus <> 'O') s FULL JOIN {FRESH} f ON s.o_orderkey = f.o_orderkey
    UNION ALL SELECT NULL, o_totalprice, 'old', o_orderstatus, NULL FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '2-HIGH'
    UNION ALL SELECT NULL, o_totalprice, NULL, o_orderstatus, 3.0 FROM orders WHERE o_orderpriority = '5-LOW'
""")
def upsert_stored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert of orders onto a table in buckets, in two versions; both sides bring rows without key."""
    stored, incoming = order_tables(spark, sf)
    orders = table(spark, sf, "orders").withColumn("o_orderkey", F.lit(None).cast("long"))
    old = orders.where("o_orderstatus <> 'O' AND o_orderpriority = '2-HIGH'").withColumn("note", F.lit("old"))
    new = orders.where("o_orderpriority = '5-LOW'").withColumn("version", F.lit(3))
    first = store(stored.unionByName(old), scratch_folder(spark, "orders"), "o_orderkey")
    later = first.upsert(incoming, ["version"]).upsert(new, ["version"])
    kept = later.table().select("o_orderkey", "o_totalprice", "note", "o_orderstatus", "version")
    return as_double(kept, "o_orderkey", "version")


CHANGES = f"""(SELECT f.o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'insert'
            WHEN s.o_totalprice <> f.o_totalprice THEN 'update' ELSE 'unchanged' END AS change,
            CASE WHEN s.o_totalprice <> f.o_totalprice THEN 'o_totalprice' ELSE '' END AS changed_fields
        FROM {FRESH} f LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'O') s
            ON s.o_orderkey = f.o_orderkey)"""


@query(f"SELECT * FROM {CHANGES}")
def change_rows(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = order_tables(spark, sf)
    labels = change_labels(stored, incoming, "o_orderkey", ["version"], ignore=["version"])
    return labels.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"""
    SELECT count(*) FILTER (change = 'insert') AS inserted, count(*) FILTER (change = 'update') AS updated,
        count(*) FILTER (change = 'unchanged') AS skipped, count(*) AS processed FROM {CHANGES}
""")
def change_totals(spark: SparkSession, sf: str) -> DataFrame:
    stored, incoming = order_tables(spark, sf)
    return change_counts(change_labels(stored, incoming, "o_orderkey", ["version"], ignore=["version"]))


@query("""
    SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 300)
        THEN 'backup' ELSE 'raw' END AS part FROM events
""")
def archive_split(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    done = events.where("event_type = 'signup' AND value > 300").select("user_id")
    backup, rest, _ = write_archive(events, done, "user_id")
    parts = [backup.withColumn("part", F.lit("backup")), rest.withColumn("part", F.lit("raw"))]
    return combine_sources([p.select("event_id", "part") for p in parts])


@query("""
    SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1
""")
def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("""
    SELECT * FROM (SELECT event_id, user_id, event_type,
        count(*) OVER (PARTITION BY user_id, event_type) AS copies,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS copy_number
        FROM events) WHERE copies > 1
""")
def duplicate_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    copies = duplicate_rows(events, ["user_id", "event_type"], ["ts", "event_id"])
    return copies.select("event_id", "user_id", "event_type", "copies", "copy_number")


@query("""
    SELECT event_id, event_type, copies, copy_number FROM (SELECT event_id, event_type,
        count(*) OVER (PARTITION BY event_type) AS copies,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS copy_number
        FROM events)
""")
def duplicate_hot_events(spark: SparkSession, sf: str) -> DataFrame:
    """A few keys hold all rows."""
    copies = duplicate_rows(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"])
    return copies.select("event_id", "event_type", "copies", "copy_number")


def upload_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read as an upload registry."""
    docs = table(spark, sf, "documents")
    day = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(n_chars as int), 0)")
    status = F.when(F.col("lang") == "en", "processed").when(F.col("lang") == "fr", "failed").otherwise("stored")
    return docs.select(
        F.format_string("u%08d", "doc_id").alias("upload_id"),
        F.upper("source").alias("datasource"),
        status.alias("status"),
        F.col("n_chars").alias("file_size"),
        day.alias("uploaded_at"),
        day.alias("updated_at"),
    )


REGISTRY = """(SELECT 'u' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS upload_id, upper(source) AS datasource,
            CASE lang WHEN 'en' THEN 'processed' WHEN 'fr' THEN 'failed' ELSE 'stored' END AS status,
            n_chars AS file_size, TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS uploaded_at
        FROM documents)"""


@query(f"""
    SELECT upload_id, datasource, CASE WHEN datasource = 'SRC3' THEN 'processed' ELSE status END AS status,
        CASE WHEN datasource = 'SRC3' AND status <> 'processed' THEN TIMESTAMP '2024-06-01 00:00:00'
             ELSE uploaded_at END AS updated_at
    FROM {REGISTRY}
""")
def status_update(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    changed = set_status(upload_registry(spark, sf), "SRC3", "processed", now)
    return changed.select("upload_id", "datasource", "status", "updated_at")


@query(f"SELECT count(*) FILTER (datasource = 'SRC3' AND status <> 'processed') AS changed FROM {REGISTRY}")
def status_update_count(spark: SparkSession, sf: str) -> DataFrame:
    return status_changes(upload_registry(spark, sf), "SRC3", "processed")


@query("""
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
        CAST(c_nationkey AS DOUBLE) AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, CAST(s_nationkey AS DOUBLE) FROM supplier
""")
def combined_sources(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment",
        "double(c_nationkey) nation",
    )
    suppliers = table(spark, sf, "supplier").selectExpr(
        "s_suppkey id", "s_name name", "s_acctbal balance", "double(s_nationkey) nation"
    )
    return combine_sources([customers, suppliers])


@query("""
    SELECT DISTINCT field FROM (SELECT unnest(json_keys(props)) AS field FROM events
        UNION ALL SELECT event_type FROM events) WHERE field NOT IN ('_id', 'created_at', 'updated_at')
""")
def observed_names(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    registered = events.select(F.col("event_type").alias("field")).distinct()
    return observed_fields(events, "props", registered)


CONFIG = CollectionConfig(
    fields=("user_id", "event_type", "value", "event_date", "channel"),
    unique_ids=("user_id", "event_type"),
    order=("event_id",),
    date_fields=("event_date",),
)


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as they would arrive in a text file."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit(" "), "event_type").alias("event_type"),
        "value",
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("event_date"),
    )


def collection_run(spark: SparkSession, sf: str):
    raw = raw_events(spark, sf)
    old, new = raw.where("ts < '2024-01-15'"), raw.where("ts >= '2024-01-10'")
    existing = process_collection(old, None, CONFIG, stamp=False).processed.drop("channel")
    return process_collection(new, existing.withColumn("first_seen", F.lit("old")), CONFIG, stamp=False)


SPLIT = """
    WITH e AS (SELECT *, user_id || '_' || event_type AS unique_id FROM events),
         old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY event_id DESC) AS rn
                 FROM e WHERE ts < TIMESTAMP '2024-01-15') WHERE rn = 1),
         new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY event_id DESC) AS rn
                 FROM e WHERE ts >= TIMESTAMP '2024-01-10') WHERE rn = 1)
"""


@query(SPLIT + """
    SELECT coalesce(n.unique_id, o.unique_id) AS unique_id,
        CAST(coalesce(n.user_id, o.user_id) AS VARCHAR) AS user_id,
        coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value,
        date_trunc('second', coalesce(n.ts, o.ts)) AS event_date, CAST(NULL AS VARCHAR) AS channel,
        CAST(NULL AS VARCHAR) AS event_date_raw,
        CASE WHEN o.unique_id IS NOT NULL THEN 'old' END AS first_seen
    FROM old o FULL JOIN new n ON o.unique_id = n.unique_id
""")
def collection_processed(spark: SparkSession, sf: str) -> DataFrame:
    return collection_run(spark, sf).processed


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def collection_backup(spark: SparkSession, sf: str) -> DataFrame:
    return collection_run(spark, sf).backup.select("event_id", "value")


@query(SPLIT + """
    SELECT count(*) FILTER (o.unique_id IS NULL) AS inserted,
        count(*) FILTER (o.unique_id IS NOT NULL AND o.event_id <> n.event_id) AS updated,
        count(*) FILTER (o.event_id = n.event_id) AS skipped, count(*) AS processed
    FROM new n LEFT JOIN old o ON o.unique_id = n.unique_id
""")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return collection_run(spark, sf).counts


def three_books(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as transactions, line items as processor rows, shipped line items as bank rows."""
    lines = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    mpr = lines.select("l_orderkey", net.alias("net"))
    bank = lines.where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("ref"), F.col("l_extendedprice").alias("credited")
    )
    return table(spark, sf, "orders"), mpr, bank


KEYS = {"trm": "o_orderkey", "mpr": "l_orderkey", "bank": "ref"}
AMOUNTS = {"trm": "o_totalprice", "mpr": "net", "bank": "credited"}

CHAIN = """(SELECT o.*, round(m.net, 4) AS mpr_amount, round(b.credited, 4) AS bank_amount,
            CASE WHEN m.l_orderkey IS NULL THEN 'MISSING_MPR' WHEN b.l_orderkey IS NULL THEN 'MISSING_BANK'
                 WHEN abs(o_totalprice - m.net) <= 100000 AND abs(o_totalprice - b.credited) <= 100000
                 THEN 'FULL_CHAIN' ELSE 'AMOUNT_MISMATCH' END AS level
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY ALL) m
            ON o_orderkey = m.l_orderkey
        LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS credited FROM lineitem WHERE l_linestatus = 'F'
            GROUP BY ALL) b ON o_orderkey = b.l_orderkey)"""


def rounded_chain(matched: DataFrame) -> DataFrame:
    return matched.withColumns({c: F.round(c, 4) for c in ("mpr_amount", "bank_amount")})


@query(f"SELECT * FROM {CHAIN}")
def chain_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_chain(chain_match(*three_books(spark, sf), KEYS, AMOUNTS, tolerance=100_000))


def as_ints(books: tuple, *names: str) -> tuple:
    """The same books with int keys in place of bigint ones, where named."""
    return tuple(b.withColumns({n: F.col(n).cast("int") for n in names if n in b.columns}) for b in books)


@query(f"SELECT * FROM {CHAIN}")
def chain_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Int keys of the books against bigint keys of the transactions, every key handled as a hot one."""
    trm, mpr, bank = three_books(spark, sf)
    books = (trm, *as_ints((mpr, bank), "l_orderkey", "ref"))
    return rounded_chain(chain_match(*books, KEYS, AMOUNTS, tolerance=100_000, hot_rows=1))


@query(f"""
    SELECT o_orderkey, level, bank_amount FROM {CHAIN} WHERE o_orderkey % 4 <> 1
    UNION ALL SELECT l_orderkey, 'MISSING_TRM', round(sum(l_extendedprice) FILTER (l_linestatus = 'F'), 4) FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1) GROUP BY l_orderkey
""")
def chain_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Processor and bank rows of transactions that are not there."""
    trm, mpr, bank = three_books(spark, sf)
    matched = chain_match(trm.where("o_orderkey % 4 <> 1"), mpr, bank, KEYS, AMOUNTS, tolerance=100_000, orphans=True)
    return rounded_chain(matched).select("o_orderkey", "level", "bank_amount")


SETTLED = """
    SELECT o_orderkey, CASE WHEN s.l_orderkey IS NULL THEN 'UNSETTLED' WHEN abs(o_totalprice - s.paid) <= 50000 THEN 'SETTLED'
        ELSE 'VARIANCE' END AS settlement_status
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS paid FROM lineitem GROUP BY ALL) s
        ON o_orderkey = s.l_orderkey
"""


@query(SETTLED)
def settlement_hot(spark: SparkSession, sf: str) -> DataFrame:
    payments = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("order_id"), "o_totalprice")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_extendedprice")
    matched = settlement_match(payments, lines, "order_id", "o_totalprice", "l_extendedprice", tolerance=50_000, hot_rows=1)
    return matched.select(F.col("order_id").cast("long").alias("o_orderkey"), "settlement_status")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def present_keys_hot(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    known = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("int").alias("l_orderkey"))
    return keys_present(lines, known, ["l_orderkey"], hot_rows=5)


@query("""
    SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'backup' ELSE 'rest' END AS part FROM events
""")
def archive_split_hot(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("int").alias("user_id"))
    done = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("user_id"))
    backup, rest = archive_processed(events, done, "user_id", hot_rows=5)
    return backup.select("event_id", F.lit("backup").alias("part")).unionByName(rest.select("event_id", F.lit("rest").alias("part")))


@query("""
    SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS copies,
        row_number() OVER (PARTITION BY lang ORDER BY md5(source || doc_id), doc_id) AS copy_number
    FROM documents
""")
def duplicate_hot_text_order(spark: SparkSession, sf: str) -> DataFrame:
    """A few very frequent keys, numbered in the order of a text."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.concat("source", "doc_id").cast("binary")).alias("mark"))
    return duplicate_rows(docs, ["lang"], ["mark", "doc_id"]).drop("mark")


@query("""
    SELECT o_orderkey, o_totalprice, round(s.paid, 2) AS statement_amount,
        round(o_totalprice - round(s.paid, 2), 2) AS variance,
        CASE WHEN s.l_orderkey IS NULL THEN 'UNSETTLED' WHEN abs(o_totalprice - s.paid) <= 50000 THEN 'SETTLED'
             ELSE 'VARIANCE' END AS settlement_status
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS paid FROM lineitem GROUP BY ALL) s
        ON o_orderkey = s.l_orderkey
""")
def settlement_levels(spark: SparkSession, sf: str) -> DataFrame:
    payments = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "order_id")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_extendedprice")
    matched = settlement_match(
        payments, lines, "order_id", "o_totalprice", "l_extendedprice", tolerance=50_000
    )
    return matched.select(
        F.col("order_id").alias("o_orderkey"),
        "o_totalprice",
        F.round("statement_amount", 2).alias("statement_amount"),
        F.round(F.col("o_totalprice") - F.round("statement_amount", 2), 2).alias("variance"),
        "settlement_status",
    )


def order_match(spark: SparkSession, sf: str):
    trm, mpr, bank = three_books(spark, sf)
    first, last = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
    return match_sources(
        trm, mpr, bank, KEYS, AMOUNTS, "o_orderdate", first, last,
        tolerance=100_000, medium=100_000, high=300_000,
    )


IN_PERIOD = f"(SELECT * FROM {CHAIN} WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')"


@query(f"SELECT o_orderkey, o_totalprice, level FROM {IN_PERIOD} WHERE level <> 'FULL_CHAIN'")
def match_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return order_match(spark, sf).exceptions.select("o_orderkey", "o_totalprice", "level")


@query(f"""
    WITH r AS (SELECT level = 'FULL_CHAIN' AS ok, level, o_totalprice AS amount,
                   CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium'
                        ELSE 'low' END AS severity FROM {IN_PERIOD})
    SELECT level AS exception_type, severity, count(*) AS rows, round(sum(amount), 2) AS amount_at_risk,
        CAST(NULL AS DOUBLE) AS match_rate, count(*) AS exceptions FROM r WHERE NOT ok GROUP BY ALL
    UNION ALL
    SELECT 'TOTAL', 'ALL', count(*), round(coalesce(sum(amount) FILTER (NOT ok), 0), 2),
        round(100.0 * count(*) FILTER (ok) / count(*), 6), count(*) FILTER (NOT ok) FROM r
""")
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    return order_match(spark, sf).summary.withColumns({
        "amount_at_risk": F.round("amount_at_risk", 2), "match_rate": F.round("match_rate", 6),
    })
