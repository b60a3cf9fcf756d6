"""Files in and out, and the same logic on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.keyed import CONFIG
from catalog.registry import query, table
from tallybook.config import ReportDefinition
from tallybook.operators.quality import enum_set, valid_range
from tallybook.plans.load import load_file
from tallybook.plans.report import report_columns
from tallybook.plans.source import SourceConfig, load_source
from tallybook.sources.files import (
    append_evolving,
    landing_manifest,
    read_any,
    read_delimited,
    read_inferred,
    read_split_records,
    scratch_folder,
    write_summary,
)
from tallybook.sources.landing import (
    HeadersNotRegistered,
    append_raw,
    classify_landing,
    header_gate,
    normalize_headers,
)
from tallybook.plans.collection import UNIQUE_ID
from tallybook.streaming.streams import (
    ONCE,
    ChangeTable,
    file_source,
    run_stream,
    split_part,
    stream_report,
    stream_split,
    stream_upsert,
    upserted,
)


# Bytes of text that go to one landed file: two splits of Spark's usual size.
FILE_BYTES = 256 * 2**20


def dealt(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows dealt out to ``least`` files or more, so that no file holds much over ``FILE_BYTES`` of ``text``, however large the table."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(least, -(-size // FILE_BYTES)))


def written_csv(df: DataFrame, spark: SparkSession, label: str) -> str:
    path = f"{scratch_folder(spark, label)}/landed.csv"
    df.write.options(header=True, quote='"', escape='"').csv(path)
    return path


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS text_hash FROM documents")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, quotes and commas survive."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = written_csv(dealt(docs, "text", 4), spark, "csv")
    read = read_delimited(spark, path, multiline=True)
    return read.select("doc_id", "lang", F.md5("text").alias("text_hash"))


@query("""
    SELECT o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey::VARCHAR END AS b,
        CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || ',' || o_custkey || ',' || o_orderstatus
            WHEN 1 THEN o_orderkey::VARCHAR END AS malformed
    FROM orders
""")
def csv_ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a cell too many or too few keep their text."""
    kind = F.col("o_orderkey") % 3
    full = F.concat_ws(",", "o_orderkey", "o_custkey")
    line = F.when(kind == 0, F.concat_ws(",", full, "o_orderstatus")).when(kind == 1, F.col("o_orderkey").cast("string")).otherwise(full)
    path = f"{scratch_folder(spark, 'ragged')}/landed.csv"
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return read_delimited(spark, path, header=False, schema="a string, b string", malformed="malformed")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 100 <> 7 THEN o_totalprice END AS amount,
        CASE WHEN o_orderkey % 100 = 7 THEN o_orderkey || ',unknown' END AS _corrupt
    FROM orders
""")
def csv_inferred_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A number column with some words, read under the schema of a file without them: the words stay in the line."""
    orders = table(spark, sf, "orders")
    amount = F.when(F.col("o_orderkey") % 100 == 7, "unknown").otherwise(F.col("o_totalprice").cast("string"))
    path = written_csv(orders.select("o_orderkey", amount.alias("amount")), spark, "mixed")
    if dict(read_inferred(spark, path).dtypes)["amount"] != "string":
        raise ValueError("a column with words was taken for numbers")
    return read_delimited(spark, path, schema="o_orderkey bigint, amount double", malformed="_corrupt")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'tsv')}/part.tsv"
    table(spark, sf, "part").select("p_partkey", "p_name").write.options(header=True, sep="\t", quote='"', escape='"').csv(path)
    return read_any(spark, path)


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def read_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'xml')}/part.xml"
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("rowTag", "row").xml(path)
    return read_any(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").drop("o_orderdate")
    found = read_inferred(spark, written_csv(orders, spark, "inferred"), malformed=None)
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}
    if not set(types.items()) - {("o_orderkey", "bigint"), ("o_custkey", "bigint")} <= set(found.dtypes):
        raise ValueError(f"unexpected inferred types {found.dtypes}")
    return found.withColumns({n: F.col(n).cast(t) for n, t in types.items()})


@query("""
    SELECT p_partkey, p_name, p_retailprice, NULL::VARCHAR AS p_brand FROM part WHERE p_size <= 25
    UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part WHERE p_size > 25
""")
def evolving_append(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    path = f"{scratch_folder(spark, 'evolving')}/part"
    append_evolving(parts.where("p_size <= 25").select("p_partkey", "p_name", "p_retailprice"), path)
    return append_evolving(parts.where("p_size > 25").select("p_partkey", "p_name", "p_brand"), path)


def registered_headers(spark: SparkSession) -> dict[str, list[str]]:
    """Headers by table, from a stored registry."""
    path = f"{scratch_folder(spark, 'registry')}/headers"
    names = {"customer": ["customer_key", "name_of_customer", "balance_percentage", "segment", "segment_1", "phone"], "supplier": ["supplier_key"]}
    rows = [(t, c) for t, columns in names.items() for c in columns]
    spark.createDataFrame(rows, "table_name string, header string").write.parquet(path)
    stored = spark.read.parquet(path).groupBy("table_name").agg(F.collect_list("header").alias("headers"))
    return {r["table_name"]: r["headers"] for r in stored.collect()}  # a registry: one row per table


@query("""
    SELECT c_custkey AS customer_key, c_name AS name_of_customer, c_acctbal AS balance_percentage,
        c_mktsegment AS segment, c_mktsegment AS segment_1, true AS stamped FROM customer
""")
def landed_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Messy headers cleaned, checked against the registered ones, stamped and appended."""
    messy = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Customer-Key"),
        F.col("c_name").alias(" Name of (Customer)"),
        F.col("c_acctbal").alias("Balance %"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_mktsegment").alias("SEGMENT "),
    )
    registered = registered_headers(spark)
    landed = header_gate(normalize_headers(messy), registered["customer"])
    try:
        header_gate(landed, registered["supplier"])
    except HeadersNotRegistered:
        pass
    else:
        raise ValueError("columns that are not registered passed the gate")
    path = f"{scratch_folder(spark, 'raw')}/customer"
    append_raw(landed, path)
    stored = spark.read.parquet(path)
    stamped = F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
    return stored.withColumn("stamped", stamped).drop("created_at", "updated_at")


@query("""
    SELECT 'json' AS fmt, l_returnflag, count(*) AS rows FROM lineitem GROUP BY ALL
    UNION ALL SELECT 'csv', l_returnflag, count(*) FROM lineitem GROUP BY ALL
""")
def written_summaries(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"))
    folder = scratch_folder(spark, "summary")
    parts = []
    for fmt in ("json", "csv"):
        write_summary(counts, f"{folder}/flags.{fmt}", fmt)
        read = read_any(spark, f"{folder}/flags.{fmt}")
        parts.append(read.select(F.lit(fmt).alias("fmt"), "l_returnflag", F.col("rows").cast("long").alias("rows")))
    return parts[0].unionByName(parts[1])


@query("SELECT event_type, 'has_rows' AS state, count(*) AS rows FROM events GROUP BY event_type")
def landed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per event type in the files that the manifest of a folder accepts."""
    events = table(spark, sf, "events")
    folder = f"{scratch_folder(spark, 'manifest')}/in"
    events.repartition(3).write.option("header", True).csv(folder)
    events.limit(0).write.mode("append").json(folder)
    listed = landing_manifest(spark, folder, ["*.csv", "*.crc"], max_mb=10_000).where("accepted")
    rows = spark.read.option("header", True).csv(f"{folder}/*.csv")
    state = classify_landing(rows)
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    accepted = named.join(listed.select("file_name"), "file_name", "left_semi")
    counted = accepted.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("state", F.lit(state))


LOAD_NAMES = {"o_orderkey": "payment_ref", "o_totalprice": "amount", "o_orderdate": "settled_on"}
LOAD_TYPES = {"payment_ref": "bigint", "amount": "decimal(10,2)", "settled_on": "date"}


def loaded_orders(spark: SparkSession, sf: str):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderpriority")).alias("remark"),
    )
    path = written_csv(orders, spark, "settlements")
    target = f"{scratch_folder(spark, 'loaded')}/orders"
    return load_file(spark, path, target, LOAD_NAMES, LOAD_TYPES, multiline=False, stamp=False)


LOADED = """(SELECT o_orderkey AS payment_ref, o_totalprice AS amount, o_orderdate AS settled_on,
            CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS remark FROM orders)"""


@query(f"""
    SELECT *, CASE WHEN remark IS NULL THEN 0.75 ELSE 1.0 END::DOUBLE AS _data_quality_score FROM {LOADED}
""")
def load_settlements(spark: SparkSession, sf: str) -> DataFrame:
    table_ = loaded_orders(spark, sf).table
    return table_.withColumns({
        "amount": F.col("amount").cast("double"), "settled_on": F.col("settled_on").cast("timestamp_ntz"),
    })


def loaded_profile_sql() -> str:
    texts = {"payment_ref": "CAST({} AS VARCHAR)", "amount": "CAST(CAST({} AS DECIMAL(10,2)) AS VARCHAR)", "settled_on": "strftime({}, '%Y-%m-%d')", "remark": "{}"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,"
        f" {t.format(f'min({c})')} AS min_value, {t.format(f'max({c})')} AS max_value, (count(*) - count({c}))::DOUBLE / count(*) AS null_share FROM {LOADED}"
        for c, t in texts.items()
    )


@query(loaded_profile_sql())
def load_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Every figure of every column of the table as written."""
    return loaded_orders(spark, sf).profile.drop("position")


@query("""
    WITH d AS (SELECT *, o_orderkey % 40 = 5 AS ragged, o_orderkey % 35 = 4 AS twelve, o_orderkey % 28 = 7 AS someday, o_orderstatus = 'F' AS blank FROM orders)
    SELECT CASE WHEN ragged THEN 'malformed' WHEN twelve OR o_totalprice > 300000 THEN 'quarantined' ELSE 'good' END AS verdict,
        CASE WHEN NOT ragged THEN CAST(o_orderkey AS VARCHAR) END AS payment_ref,
        CASE WHEN NOT ragged AND NOT twelve THEN o_totalprice END AS amount,
        CASE WHEN NOT ragged AND NOT someday THEN o_orderdate END AS settled_on,
        CASE WHEN NOT ragged AND NOT blank THEN o_orderpriority END AS remark,
        CASE WHEN ragged THEN '' ELSE concat_ws('+', CASE WHEN twelve THEN 'amount=twelve' END, CASE WHEN someday THEN 'settled_on=someday' END) END AS lost,
        CASE WHEN NOT ragged AND (twelve OR o_totalprice > 300000) THEN 'range_amount' ELSE '' END AS failed_rules,
        CASE WHEN NOT ragged THEN 1 - (twelve::INT + someday::INT + blank::INT)::DOUBLE / 4 END AS score
    FROM d
""")
def load_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of a file that is loaded with rules, wherever it went: ragged lines, unreadable cells, broken ranges."""
    key = F.col("o_orderkey")
    line = F.concat_ws(
        ",", key.cast("string"), F.when(key % 35 == 4, "twelve").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")),
        F.when(key % 28 == 7, "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderpriority")), F.when(key % 40 == 5, "surplus"),
    )
    folder = scratch_folder(spark, "judged")
    lines = table(spark, sf, "orders").select(line.alias("o_orderkey,o_totalprice,o_orderdate,remark"))
    lines.repartition(3).write.options(header=True, quote="", escapeQuotes=False, sep="\x01").csv(f"{folder}/in")
    loaded = load_file(spark, f"{folder}/in", f"{folder}/table", LOAD_NAMES, LOAD_TYPES, stamp=False, rules=[valid_range("amount", 0, 300_000)])
    lost = F.array_join(F.transform("_rescued", lambda c: F.concat(c["field"], F.lit("="), c["value"])), "+")
    parts = [
        loaded.table.withColumns({"verdict": F.lit("good"), "failed_rules": F.lit("")}),
        loaded.quarantined.withColumns({"verdict": F.lit("quarantined"), "failed_rules": F.array_join("failed_rules", "+")}),
        loaded.malformed.select(F.lit("malformed").alias("verdict"), F.lit("").alias("failed_rules")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(
        "verdict", F.col("payment_ref").cast("string").alias("payment_ref"), F.col("amount").cast("double").alias("amount"),
        F.col("settled_on").cast("timestamp_ntz").alias("settled_on"), "remark", F.coalesce(lost, F.lit("")).alias("lost"), "failed_rules",
        F.col("_data_quality_score").alias("score"),
    )


ORDER_SOURCE = {
    "registered": ["order_ref", "settlement_amount", "ordered_on", "state", "batch", "remark"],
    "mapping": {"Order Ref.": "payment_ref", "Settlement Amount": "amount", "Ordered On": "settled_on"},
    "types": {"payment_ref": "bigint", "amount": "decimal", "settled_on": "date", "batch": "bigint"},
    "date_format_hints": ["dd-MM-yyyy", "yyyy-MM-dd"],
    "dq_rules": {
        "require_columns": ["payment_ref"], "valid_range": {"amount": {"min": 0, "max": 300000}},
        "enum_sets": {"state": ["F", "O", "P"]}, "business_rules": [{"name": "ratio", "rule": "100 / (payment_ref % 10) > 0"}],
    },
    "load": {"dedupe_keys": ["batch"], "upsert_key": ["payment_ref"]},
}
DELIVERED = """(SELECT *, NOT ragged AND (twelve OR o_totalprice > 300000 OR o_orderkey % 45 = 2) AS refused,
            CASE WHEN NOT someday AND NOT noday THEN o_orderdate END AS day,
            concat_ws('+', CASE WHEN twelve THEN 'amount=twelve' END, CASE WHEN someday THEN 'settled_on=someday' END) AS lost
        FROM (SELECT *, o_orderkey % 40 = 5 AS ragged, o_orderkey % 50 = 3 AS keyless, o_orderkey % 35 = 4 AS twelve, o_orderkey % 80 = 7 AS someday,
            o_orderkey % 70 = 1 AS noday, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey END AS batch,
            CASE WHEN o_orderkey % 6 IN (0, 4) THEN 2 ELSE 1 END AS times FROM orders))"""
STORED = "(SELECT o_orderkey, o_totalprice - o_orderkey % 2 AS amount, o_orderdate, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 = 0)"
STORED_OTHERS = STORED.replace("o_orderstatus AS", "CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS")


def loaded_source(spark: SparkSession, sf: str, keys: tuple[str, ...] = ("payment_ref",)):
    """Orders as a messy file into a table of a third of them.

    Grouped amounts, two date layouts, repeats with and without a batch, ragged and keyless lines, cells that cannot be read.
    """
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.when(key % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat(
        F.when(key % 50 == 3, " ").otherwise(key.cast("string")), F.lit(',"'), F.when(key % 35 == 4, "twelve").otherwise(F.format_number("o_totalprice", 2)),
        F.lit('",'), F.when(key % 80 == 7, "someday").when(key % 70 == 1, "").otherwise(day),
        F.lit(","), F.when(key % 45 == 2, "?").otherwise(F.col("o_orderstatus")), F.lit(","), F.when(key % 3 == 1, "").otherwise(key.cast("string")),
        F.when(key % 40 == 5, ",surplus,cell").otherwise(""),
    )
    folder = scratch_folder(spark, "source")
    lines = orders.union(orders.where("o_orderkey % 6 IN (0, 4)")).select(line.alias("Order Ref.,Settlement Amount,Ordered On,State,Batch"))
    lines.repartition(3).write.options(header=True, quote="", escapeQuotes=False, sep="\x01").csv(f"{folder}/in")
    state = F.col("o_orderstatus") if len(keys) == 1 else F.when(key % 6 == 0, "X").otherwise(F.col("o_orderstatus"))
    existing = orders.where("o_orderkey % 3 = 0").select(
        key.alias("payment_ref"), (F.col("o_totalprice") - key % 2).cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").cast("date").alias("settled_on"),
        state.alias("state"),
    )
    config = SourceConfig.from_dict(ORDER_SOURCE | {"load": {"dedupe_keys": ["batch"], "upsert_key": list(keys)}})
    return load_source(spark, f"{folder}/in", config, existing, folder)


def _shown(rows: DataFrame) -> DataFrame:
    """Types that both engines print alike, and the rescued cells as text."""
    lost = F.array_join(F.transform("_rescued", lambda c: F.concat(c["field"], F.lit("="), c["value"])), "+")
    return rows.withColumns({
        "amount": F.col("amount").cast("double"), "settled_on": F.col("settled_on").cast("timestamp_ntz"), "lost": F.coalesce(lost, F.lit("")),
        "batch": F.col("batch").cast("string"), "payment_ref": F.col("payment_ref").cast("string"),
    }).drop("_rescued")


def _loaded_sql(stored: str, on: str) -> str:
    cell = lambda new, old, name: f"CASE WHEN d.o_orderkey IS NOT NULL THEN {new} ELSE {old} END AS {name}"
    return f"""
    SELECT CAST(coalesce(d.o_orderkey, s.o_orderkey) AS VARCHAR) AS payment_ref, {cell("d.o_totalprice", "s.amount", "amount")},
        {cell("d.day", "s.o_orderdate", "settled_on")}, {cell("d.o_orderstatus", "s.state", "state")}, CAST(d.batch AS VARCHAR) AS batch, coalesce(d.lost, '') AS lost
    FROM (SELECT * FROM {DELIVERED} WHERE NOT ragged AND NOT keyless AND NOT refused) d FULL JOIN {stored} s ON {on}
"""


@query(_loaded_sql(STORED, "d.o_orderkey = s.o_orderkey"))
def source_load(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(loaded_source(spark, sf).table)


@query(_loaded_sql(STORED_OTHERS, "d.o_orderkey = s.o_orderkey AND d.o_orderstatus = s.state"))
def source_load_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that share the first key field but not the second do not replace each other."""
    return _shown(loaded_source(spark, sf, ("payment_ref", "state")).table)


@query(f"""
    WITH d AS (SELECT *, NOT ragged AND NOT keyless AND NOT refused AS good FROM {DELIVERED}),
         ok AS (SELECT d.*, s.o_orderkey AS old, s.amount = d.o_totalprice AND s.o_orderdate IS NOT DISTINCT FROM d.day AND d.batch IS NULL AND lost = '' AS same
                FROM d LEFT JOIN {STORED} s ON d.o_orderkey = s.o_orderkey WHERE good)
    SELECT CAST(sum(times) AS BIGINT) AS read, CAST(sum(times) FILTER (ragged) AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS empty,
        CAST(sum(times) FILTER (refused) AS BIGINT) AS quarantined, CAST(sum(times) FILTER (keyless AND NOT ragged AND NOT refused) AS BIGINT) AS keyless,
        CAST(sum(times - 1) FILTER (good AND batch IS NOT NULL) AS BIGINT) AS duplicates,
        CAST(sum(times - 1) FILTER (good AND batch IS NULL) AS BIGINT) AS superseded,
        CAST(sum(times * (twelve::INT + someday::INT)) FILTER (NOT ragged) AS BIGINT) AS rescued_cells,
        (SELECT count(*) FILTER (old IS NULL) FROM ok) AS inserted, (SELECT count(*) FILTER (old IS NOT NULL AND NOT same) FROM ok) AS updated,
        (SELECT count(*) FILTER (old IS NOT NULL AND same) FROM ok) AS skipped FROM d
""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered row under one heading."""
    return loaded_source(spark, sf).counts


@query(f"""
    SELECT CASE WHEN NOT keyless THEN CAST(o_orderkey AS VARCHAR) END AS payment_ref, CASE WHEN NOT twelve THEN o_totalprice END AS amount, day AS settled_on,
        CASE WHEN o_orderkey % 45 = 2 THEN '?' ELSE o_orderstatus END AS state, CAST(batch AS VARCHAR) AS batch, lost, concat_ws('+',
        CASE WHEN twelve OR o_totalprice > 300000 THEN 'range_amount' END, CASE WHEN o_orderkey % 45 = 2 THEN 'enum_state' END) AS failed
    FROM (SELECT * FROM {DELIVERED} UNION ALL SELECT * FROM {DELIVERED} WHERE times = 2) WHERE refused
""")
def source_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Every refused row, as often as it was delivered."""
    bad = loaded_source(spark, sf).quarantined
    return _shown(bad).withColumn("failed", F.array_join("failed_rules", "+")).drop("failed_rules")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, length(t) AS n_chars, md5(t) AS md5
    FROM (SELECT doc_id, source, replace(text, chr(13), ' ') || chr(10) || '"' || lang || '", ' AS t FROM documents)
""")
def csv_split_records(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, quotes and commas through a delimited file whose records lie over the ends of its splits."""
    folder = scratch_folder(spark, "records")
    text = F.concat(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit('\n"'), "lang", F.lit('", '))
    docs = table(spark, sf, "documents").select("doc_id", "source", text.alias("t"))
    dealt(docs, "t", 2).write.options(header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(f"{folder}/in")
    found = read_split_records(spark, f"{folder}/in")
    return found.select("doc_id", "source", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return file_source(spark, sf, schema, "events.parquet")


LAST_EVENTS = """
    SELECT user_id || '_' || event_type AS unique_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
        date_trunc('second', ts) AS event_date, NULL::VARCHAR AS event_date_raw, NULL::VARCHAR AS channel
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events)
    WHERE rn = 1
"""


@query(LAST_EVENTS)
def streamed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Four files that land one after the other, one per micro-batch."""
    folder = scratch_folder(spark, "stream")
    land(table(spark, sf, "events"), f"{folder}/in", range(4), 4)
    stream_upsert(raw_events(spark, sf, f"{folder}/in"), f"{folder}/table", CONFIG, f"{folder}/checkpoint").awaitTermination()
    return upserted(spark, f"{folder}/table", CONFIG)


def land(events: DataFrame, path: str, turns: range, of: int) -> None:
    """Write the events as ``of`` files in the order of their ids; here those of ``turns``."""
    last = events.agg(F.max("event_id")).first()[0] + 1
    for turn in turns:
        part = events.where((F.col("event_id") >= last * turn // of) & (F.col("event_id") < last * (turn + 1) // of))
        part.coalesce(1).write.mode("append").parquet(path)


def raw_events(spark: SparkSession, sf: str, path: str) -> DataFrame:
    return file_source(spark, path, table(spark, sf, "events").schema, "*.parquet", files_per_batch=1).select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit(" "), "event_type").alias("event_type"),
        "value",
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("event_date"),
    )


@query(LAST_EVENTS)
def streamed_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The stream goes on with a new checkpoint after a compaction, on the files that came later."""
    folder = scratch_folder(spark, "stream")
    events = table(spark, sf, "events")
    for turn in range(2):
        land(events, f"{folder}/in{turn}", range(2 * turn, 2 * turn + 2), 4)
        raw = raw_events(spark, sf, f"{folder}/in{turn}")
        stream_upsert(raw, f"{folder}/table", CONFIG, f"{folder}/checkpoint{turn}").awaitTermination()
        changes = ChangeTable(spark, f"{folder}/table", UNIQUE_ID, [f"__rank{i}" for i in range(len(CONFIG.order))])
        if turn == 0:
            changes.compact()
            changes.clean()
    return upserted(spark, f"{folder}/table", CONFIG)


EVENT_REPORT = ReportDefinition.from_dict({
    "report_name": "events",
    "formulas": [
        {"logicNameKey": "GROSS", "formulaText": "events.value"},
        {"logicNameKey": "FEE", "formulaText": "GROSS * 0.02"},
        {"logicNameKey": "NET", "formulaText": "GROSS - FEE"},
    ],
    "mapping_keys": {"events": ["event_id"]},
    "conditions": {"events": [{"column": "event_type", "operator": "not_in", "value": ["signup"]}]},
    "delta_columns": [{"delta_column_name": "GAP", "value": "GROSS - 100"}],
    "reasons": [{"reason": "LARGE", "delta_column": "GAP", "threshold": 90, "must_check": True}],
})

EVENT_ROWS = """
    SELECT CAST(event_id AS VARCHAR) AS events_mapping_key, value AS gross, value * 0.02::DOUBLE AS fee,
        value - value * 0.02::DOUBLE AS net, value - 100 AS gap,
        CASE WHEN abs(value - 100) > 90 THEN 'LARGE' ELSE '' END AS reason,
        CASE WHEN abs(value - 100) > 90 THEN 'UNRECONCILED' ELSE 'RECONCILED' END AS reconciliation_status
    FROM events WHERE event_type <> 'signup'
"""


@query(EVENT_ROWS)
def event_report(spark: SparkSession, sf: str) -> DataFrame:
    return report_columns(table(spark, sf, "events"), EVENT_REPORT)


@query(EVENT_ROWS)
def streamed_report(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark, "stream")
    started = run_stream(
        event_stream(spark, sf),
        lambda df: stream_report(df, EVENT_REPORT),
        f"{folder}/checkpoint",
        path=f"{folder}/report",
        fmt="parquet",
        trigger=ONCE,
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/report")


@query("""
    SELECT event_id, CASE WHEN value BETWEEN 5 AND 150 AND event_type <> 'error' THEN 'good' ELSE 'bad' END AS part
    FROM events
""")
def streamed_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark, "stream")
    rules = [valid_range("value", 5, 150), enum_set("event_type", ["view", "click", "purchase", "signup"])]
    events = event_stream(spark, sf)
    stream_split(events, rules, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    parts = [split_part(spark, f"{folder}/events", events.schema, n).select("event_id", F.lit(n).alias("part")) for n in ("good", "bad")]
    return parts[0].unionByName(parts[1])
