"""Data-quality rules and column profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from catalog.scalars import labelled_documents
from tallybook.operators.profile import (
    folded_profile,
    load_sketches,
    complexity_score,
    describe_input,
    exact_quantiles,
    load_summary,
    null_fraction,
    overall_quality,
    profile_columns,
    row_quality,
)
from tallybook.operators.quality import (
    business_rule,
    enum_set,
    non_null,
    quality_report,
    require_columns,
    rules_from_dict,
    valid_dates,
    valid_range,
    violations,
    write_quarantine,
)
from tallybook.sources.files import scratch_folder

TODAY = dt.date(1999, 12, 31)

LINE_RULES = {
    "require_columns": ["l_orderkey", "l_extendedprice"],
    "non_null": ["l_orderkey", "flag"],
    "valid_range": {
        "l_extendedprice": {"min": 1000, "max": 50000},
        "l_shipdate": {"min_date": "1996-01-01", "max_date": "today+1"},
    },
    "enum_sets": {"l_linestatus": ["F"]},
    "business_rules": [{"name": "discount_limit", "rule": "l_extendedprice * l_discount <= 3000"}],
}


def lines_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a row id and a flag that some do not have."""
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    row = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return table(spark, sf, "lineitem").withColumns({"flag": flag, "row_id": row})


GAPS = """(SELECT *, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag,
            concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS row_id FROM lineitem)"""

# rule, column, broken when, value as text
BROKEN = f"""
    WITH l AS (SELECT * FROM {GAPS}),
         v AS (
             SELECT row_id, 'non_null_flag' AS rule, 'flag' AS "column", NULL AS value FROM l WHERE flag IS NULL
             UNION ALL SELECT row_id, 'range_l_extendedprice', 'l_extendedprice', CAST(l_extendedprice AS VARCHAR)
                 FROM l WHERE l_extendedprice < 1000 OR l_extendedprice > 50000
             UNION ALL SELECT row_id, 'dates_l_shipdate', 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
                 FROM l WHERE CAST(l_shipdate AS DATE) < DATE '1996-01-01' OR CAST(l_shipdate AS DATE) > DATE '2000-01-01'
             UNION ALL SELECT row_id, 'enum_l_linestatus', 'l_linestatus', l_linestatus FROM l WHERE l_linestatus <> 'F'
             UNION ALL SELECT row_id, 'discount_limit', NULL, NULL FROM l WHERE l_extendedprice * l_discount > 3000)
"""


@query(BROKEN + "SELECT * FROM v")
def dq_violations(spark: SparkSession, sf: str) -> DataFrame:
    return violations(lines_with_gaps(spark, sf), rules_from_dict(LINE_RULES), "row_id", TODAY)


@query(BROKEN + """
    SELECT l.row_id, CASE WHEN b.n IS NULL THEN 'good' ELSE 'bad' END AS part, coalesce(b.n, 0) AS failures
    FROM l LEFT JOIN (SELECT row_id, count(DISTINCT rule) AS n FROM v GROUP BY row_id) b ON l.row_id = b.row_id
""")
def dq_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    good, bad, _ = write_quarantine(lines_with_gaps(spark, sf), rules_from_dict(LINE_RULES), scratch_folder(spark, "quarantine") + "/rows", TODAY)
    size = F.size("failed_rules").cast("long").alias("failures")
    return good.select("row_id", F.lit("good").alias("part"), F.lit(0).cast("long").alias("failures")).unionByName(
        bad.select("row_id", F.lit("bad").alias("part"), size)
    )


@query(BROKEN + """
    , r AS (SELECT unnest(['require_l_orderkey', 'require_l_extendedprice', 'non_null_l_orderkey', 'non_null_flag',
                'range_l_extendedprice', 'dates_l_shipdate', 'enum_l_linestatus', 'discount_limit']) AS rule)
    SELECT r.rule, count(v.rule) AS failures,
        count(v.rule) * 1.0::DOUBLE / (SELECT count(*) FROM lineitem) AS failure_rate
    FROM r LEFT JOIN v ON r.rule = v.rule GROUP BY r.rule
""")
def dq_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality_report(lines_with_gaps(spark, sf), rules_from_dict(LINE_RULES), TODAY)


def failing(spark: SparkSession, sf: str, *rules) -> DataFrame:
    return violations(table(spark, sf, "events"), rules, "event_id", dt.date(2024, 1, 20))


@query("SELECT event_id, 'require_amount' AS rule, 'amount' AS \"column\", NULL::VARCHAR AS value FROM events")
def dq_required(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf, *require_columns("amount", "value"))


@query(
    "SELECT doc_id, 'non_null_quality' AS rule, 'quality' AS \"column\", NULL::VARCHAR AS value"
    " FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"
)
def dq_non_null(spark: SparkSession, sf: str) -> DataFrame:
    return violations(labelled_documents(spark, sf), non_null("quality", "doc_id"), "doc_id")


@query("""
    SELECT event_id, 'range_value' AS rule, 'value' AS "column", CAST(value AS VARCHAR) AS value
    FROM events WHERE NOT value BETWEEN 1 AND 100
""")
def dq_range(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf, valid_range("value", 1, 100))


@query("""
    SELECT event_id, 'dates_ts' AS rule, 'ts' AS "column",
        rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS value FROM events
    WHERE NOT CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'
""")
def dq_dates(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf, valid_dates("ts", "2024-01-05", "today-2"))


@query("""
    SELECT event_id, 'range_amount' AS rule, 'amount' AS "column", amount AS value FROM (
        SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id % 200 AS VARCHAR) END AS amount FROM events)
    WHERE amount = 'n/a' OR CAST(nullif(amount, 'n/a') AS DOUBLE) > 120
""")
def dq_text_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """A range over text: what cannot be read breaks it and stops nothing."""
    amount = F.when(F.col("user_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 200).cast("string"))
    texts = table(spark, sf, "events").select("event_id", amount.alias("amount"))
    return violations(texts, [valid_range("amount", 0, 120)], "event_id")


@query("""
    SELECT event_id, 'enum_user_id' AS rule, 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value FROM events
    WHERE user_id NOT IN (1, 2, 3)
    UNION ALL SELECT event_id, 'enum_event_type', 'event_type', event_type FROM events WHERE event_type <> 'click'
""")
def dq_mixed_enum(spark: SparkSession, sf: str) -> DataFrame:
    return violations(
        table(spark, sf, "events"), [enum_set("user_id", ["x", "1", 2, 3.0]), enum_set("event_type", ["click", 5])], "event_id"
    )


@query("""
    SELECT event_id, 'ratio' AS rule, NULL::VARCHAR AS "column", NULL::VARCHAR AS value FROM events
    WHERE user_id % 10 <> 0 AND 12.0 / (user_id % 10) <= 2
""")
def dq_div_zero(spark: SparkSession, sf: str) -> DataFrame:
    """A quotient by zero is unknown, which counts as holding."""
    return failing(spark, sf, business_rule("ratio", "12 / (user_id % 10) > 2"))


@query("""
    SELECT event_id, 'enum_event_type' AS rule, 'event_type' AS "column", event_type AS value FROM events
    WHERE event_type NOT IN ('view', 'click', 'purchase')
""")
def dq_enum(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf, enum_set("event_type", ["view", "click", "purchase"]))


@query("""
    SELECT event_id, 'cheap_errors' AS rule, NULL::VARCHAR AS "column", NULL::VARCHAR AS value FROM events
    WHERE event_type = 'error' AND value > 50
""")
def dq_business(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf, business_rule("cheap_errors", "event_type <> 'error' OR value <= 50"))


LINE_COLUMNS = {
    "l_orderkey": "CAST({} AS VARCHAR)", "l_partkey": "CAST({} AS VARCHAR)", "l_suppkey": "CAST({} AS VARCHAR)",
    "l_linenumber": "CAST({} AS VARCHAR)", "l_quantity": "CAST({} AS VARCHAR)",
    "l_extendedprice": "CAST({} AS VARCHAR)", "l_discount": "CAST({} AS VARCHAR)", "l_tax": "CAST({} AS VARCHAR)",
    "l_returnflag": "{}", "l_linestatus": "{}", "l_shipdate": "strftime({}, '%Y-%m-%d %H:%M:%S')", "flag": "{}",
}


def profile_sql() -> str:
    parts = []
    for i, (c, text) in enumerate(LINE_COLUMNS.items()):
        low, high = text.format(f"min({c})"), text.format(f"max({c})")
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS non_null_count,"
            f" count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,"
            f" {low} AS min_value, {high} AS max_value,"
            f" (count(*) - count({c})) * 1.0::DOUBLE / count(*) AS null_share FROM {GAPS}"
        )
    return " UNION ALL ".join(parts)


@query(profile_sql())
def profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return profile_columns(lines_with_gaps(spark, sf).drop("row_id"))


@query(f"SELECT * EXCLUDE (distinct_count), true AS near FROM ({profile_sql()})")
def profile_lineitem_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Everything but the distinct counts is exact; they are within a tenth of the exact ones."""
    lines = lines_with_gaps(spark, sf).drop("row_id")
    exact = profile_columns(lines).select("position", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.1 * F.col("exact")
    found = profile_columns(lines, approx=True).join(exact, "position").withColumn("near", near)
    return found.drop("distinct_count", "exact")


LABELLED = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

NULLS = "(quality IS NULL)::BIGINT + (toxic IS NULL)::BIGINT"


@query(f"""
    SELECT CAST(sum({NULLS}) AS BIGINT) AS null_cells, count(*) * 6 AS cells,
        sum({NULLS})::DOUBLE / (count(*) * 6) AS null_fraction FROM {LABELLED}
""")
def null_cells(spark: SparkSession, sf: str) -> DataFrame:
    return null_fraction(labelled_documents(spark, sf))


@query(f"SELECT doc_id, round(1 - ({NULLS}) / 6.0::DOUBLE, 9) AS score FROM {LABELLED}")
def row_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = row_quality(labelled_documents(spark, sf))
    return scored.select("doc_id", F.round("_data_quality_score", 9).alias("score"))


@query(f"SELECT round(avg(1 - ({NULLS}) / 6.0::DOUBLE), 9) AS overall_quality FROM {LABELLED}")
def overall_score(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round("overall_quality", 9).alias("overall_quality")
    return overall_quality(labelled_documents(spark, sf)).select(score)


@query(f"""
    SELECT round(least(1.0, 0.4 * 3 / 6 + 0.3 * 6 / 100 + 0.3 * sum({NULLS})::DOUBLE / (count(*) * 6)), 9)
        AS complexity FROM {LABELLED}
""")
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    score = complexity_score(labelled_documents(spark, sf))
    return score.select(F.round("complexity", 9).alias("complexity"))


@query("""
    SELECT count(*) AS rows, 6 AS columns, 'o_orderstatus, o_orderpriority' AS string_columns,
        'o_orderkey, o_custkey, o_totalprice' AS numeric_columns,
        round(count(*) * 6 * 50 / 1048576.0::DOUBLE, 6) AS estimated_mb FROM orders
""")
def described_input(spark: SparkSession, sf: str) -> DataFrame:
    described = describe_input(table(spark, sf, "orders"))
    return described.withColumn("estimated_mb", F.round("estimated_mb", 6))


@query(f"""
    SELECT count(*) AS rows, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day,
        CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day,
        CAST(CAST(max(l_shipdate) AS DATE) - CAST(min(l_shipdate) AS DATE) AS INTEGER) AS days,
        round(sum(l_extendedprice), 2) AS total_l_extendedprice, round(sum(l_quantity), 2) AS total_l_quantity,
        100.0::DOUBLE AS fill_l_shipdate, 100.0::DOUBLE AS fill_l_extendedprice, 100.0::DOUBLE AS fill_l_quantity,
        count(flag) * 100.0::DOUBLE / count(*) AS fill_flag
    FROM {GAPS}
""")
def load_figures(spark: SparkSession, sf: str) -> DataFrame:
    lines = lines_with_gaps(spark, sf).select("l_shipdate", "l_extendedprice", "l_quantity", "flag")
    summary = load_summary(lines, "l_shipdate", ["l_extendedprice", "l_quantity"])
    return summary.withColumns({
        "first_day": F.col("first_day").cast("string"),
        "last_day": F.col("last_day").cast("string"),
        "total_l_extendedprice": F.round("total_l_extendedprice", 2),
        "total_l_quantity": F.round("total_l_quantity", 2),
    })


@query("""
    WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_linenumber + 9007199254740992 AS big FROM lineitem)
    SELECT row_id, 'enum_big' AS rule, CAST(big AS VARCHAR) AS value FROM l WHERE big NOT IN (9007199254740993, 9007199254740996)
    UNION ALL SELECT row_id, 'int', NULL FROM l WHERE row_id % 7 = 3
""")
def dq_large_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over whole numbers and decimals that overflow on most rows (and then hold), a set beyond 2^53."""
    large = F.when(F.col("row_id") % 7 == 3, -5).otherwise(2147483647)
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_linenumber") + 9007199254740992).alias("big")
    ).withColumns({"x": large, "y": F.lit(9223372036854775807), "z": F.lit("9e37").cast("decimal(38,0)")})
    rules = [
        enum_set("big", [9007199254740993, 9007199254740996.0, "9007199254740996"]), business_rule("int", "x * 2 > 0"),
        business_rule("long", "y + 1 > 0"), business_rule("decimal", "z * z > z"),
    ]
    return violations(lines, rules, "row_id", TODAY).select("row_id", "rule", "value")


def _bound_sql(name: str) -> str:
    return f"""SELECT '{name}' AS column_name, count({name}) AS non_null_count, count(*) - count({name}) AS null_count,
        CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value, true AS close FROM lineitem"""


@query("\n    UNION ALL ".join(_bound_sql(n) for n in ("l_orderkey", "l_linenumber", "l_returnflag")))
def profile_of_three_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Three loads folded from their sketches; ``close``: distinct counts and quantiles are within the stated error of the exact ones."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    loads = [load_sketches(lines.where(F.pmod("l_orderkey", F.lit(3)) == k), f"load {k}") for k in range(3)]
    folded = folded_profile(loads[0].unionByName(loads[1]).unionByName(loads[2]))
    exact = profile_columns(lines).select("column_name", F.col("distinct_count").alias("exact"))
    rank = exact_quantiles(lines, "l_orderkey", [0.2, 0.3, 0.45, 0.55, 0.7, 0.8])
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.08 * F.col("exact")
    middle = (F.col("column_name") != "l_orderkey") | (
        F.col("q25").between(F.col("p")[0], F.col("p")[1]) & F.col("q50").between(F.col("p")[2], F.col("p")[3]) & F.col("q75").between(F.col("p")[4], F.col("p")[5])
    )
    met = folded.join(exact, "column_name").join(rank.withColumn("column_name", F.explode(F.array(*[F.lit(c) for c in lines.columns]))), "column_name")
    return met.select("column_name", "non_null_count", "null_count", "min_value", "max_value", (near & middle).alias("close"))
