import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import rules
from tallybook.functions.rule_text import safe_predicate
from tallybook.operators.profile import (
    complexity_score,
    describe_input,
    exact_quantiles,
    folded_profile,
    load_sketches,
    load_summary,
    null_fraction,
    overall_quality,
    profile_columns,
    row_quality,
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
from tallybook.operators.quality import business_rule, enum_set, quality_report, quarantine, rules_from_dict, violations
from tallybook.operators.stats import (
    alert_flags,
    issue_severity,
    message_stats,
    reason_breakdown,
    recent_runs,
    recent_uploads,
    recon_summary,
    run_stats,
    session_stats,
    sorted_names,
    status_counts,
    table_counts,
    workflow_summary,
)
from tests.conftest import rows

RULES = {
    "require_columns": ["payment_ref", "amount", "settlement_date"],
    "non_null": ["payment_ref", "amount"],
    "valid_range": {
        "amount": {"min": 0, "max": 50000},
        "settlement_date": {"min_date": "2020-01-01", "max_date": "today+1"},
    },
    "enum_sets": {"status": ["SETTLED", "PENDING", "FAILED"]},
    "business_rules": [
        {"name": "commission_validation", "rule": "gross_amount - amount <= gross_amount * 0.30"}
    ],
}
TODAY = dt.date(2024, 6, 1)


@pytest.fixture(scope="module")
def payments(spark):
    good = dt.date(2024, 5, 1)
    return spark.createDataFrame(
        [
            (1, "p1", 100.0, good, "SETTLED", 120.0),
            (2, None, 100.0, good, "SETTLED", 120.0),
            (3, "p3", None, good, "SETTLED", 120.0),
            (4, "p4", 50001.0, good, "PENDING", 50001.0),
            (5, "p5", 100.0, dt.date(2024, 6, 3), "FAILED", 100.0),
            (6, "p6", 100.0, dt.date(2024, 6, 2), "OPEN", 100.0),
            (7, "p7", 50.0, good, "SETTLED", 100.0),
            (8, None, -1.0, dt.date(2019, 12, 31), None, None),
        ],
        "id int, payment_ref string, amount double, settlement_date date, status string, gross_amount double",
    )


def test_quality_rules(payments):
    rules = rules_from_dict(RULES)
    found = {}
    for r in violations(payments, rules, "id", TODAY).collect():
        found.setdefault(r["id"], set()).add(r["rule"])
    assert found == {
        2: {"non_null_payment_ref"},
        3: {"non_null_amount"},
        4: {"range_amount"},
        5: {"dates_settlement_date"},
        6: {"enum_status"},
        7: {"commission_validation"},
        8: {"non_null_payment_ref", "range_amount", "dates_settlement_date"},
    }
    good, bad = quarantine(payments, rules, TODAY)
    assert [r["id"] for r in good.collect()] == [1]
    assert good.columns == payments.columns
    assert {r["id"]: set(r["failed_rules"]) for r in bad.collect()} == found
    report = {r["rule"]: (r["failures"], r["failure_rate"]) for r in quality_report(payments, rules, TODAY).collect()}
    assert report["non_null_payment_ref"] == (2, 0.25) and report["require_amount"] == (0, 0.0)
    assert len(report) == len(rules)


def test_absent_columns(payments):
    rules = rules_from_dict({"require_columns": ["id", "gone"], "non_null": ["lost"], "enum_sets": {"x": [1]}})
    found = violations(payments.limit(1), rules, "id").collect()
    assert sorted(r["rule"] for r in found) == ["non_null_lost", "require_gone"]
    with pytest.raises(ValueError):
        rules_from_dict({"valid_range": {"id": {"min_date": "soon"}}}) and quality_report(
            payments, rules_from_dict({"valid_range": {"settlement_date": {"min_date": "soon"}}})
        )
    empty = payments.limit(0)
    assert {r["failure_rate"] for r in quality_report(empty, rules_from_dict(RULES), TODAY).collect()} == {0.0}


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5, None), (2, None, 2.5, None), (2, "a", None, None), (None, "b", 0.0, None)],
        "n int, s string, d double, _internal string",
    )


@pytest.mark.parametrize("approx", [False, True])
def test_profile(gaps, approx):
    found = {r["column_name"]: r for r in profile_columns(gaps, approx).collect()}
    assert list(found) == ["n", "s", "d"] or set(found) == {"n", "s", "d"}
    n = found["n"]
    assert (n["non_null_count"], n["null_count"], n["distinct_count"]) == (3, 1, 2)
    assert (n["min_value"], n["max_value"], n["null_share"]) == ("1", "2", 0.25)
    assert (found["d"]["min_value"], found["s"]["max_value"]) == ("0.0", "b")
    empty = profile_columns(gaps.limit(0), approx).collect()
    assert {r["null_share"] for r in empty} == {0.0} and {r["non_null_count"] for r in empty} == {0}


def test_table_quality(gaps):
    df = gaps.drop("_internal")
    f = null_fraction(df).first()
    assert (f["null_cells"], f["cells"], f["null_fraction"]) == (3, 12, 0.25)
    assert null_fraction(df.limit(0)).first()["null_fraction"] == 0.0
    scores = sorted(r["_data_quality_score"] for r in row_quality(df).collect())
    assert [round(s, 6) for s in scores] == [0.666667, 0.666667, 0.666667, 1.0]
    assert round(overall_quality(df).first()[0], 6) == 0.75
    assert round(complexity_score(df).first()[0], 6) == round(0.4 + 0.3 * 0.25 + 0.3 * 0.03, 6)
    d = describe_input(df).first()
    assert (d["rows"], d["columns"], d["string_columns"], d["numeric_columns"]) == (4, 3, "s", "n, d")


def test_load_summary(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 5), None)], "day date, amount double"
    )
    s = load_summary(df, "day", ["amount"]).first()
    assert (s["rows"], s["days"], s["total_amount"], s["fill_amount"]) == (2, 4, 1.0, 50.0)


def test_projections(spark):
    df = spark.createDataFrame([("7", "1.005", "2024-01-02 03:04:05", None)], "i string, d string, t string, x string")
    typed = cast_to_schema(df, {"i": "bigint", "d": "NUMERIC", "t": "timestamp", "x": "date", "gone": "int"})
    assert dict(typed.dtypes) == {"i": "bigint", "d": "decimal(10,2)", "t": "timestamp_ntz", "x": "date"}
    assert typed.first()["t"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert cast_to_schema(df, {"d": "int"}).first()["d"] == 1
    assert cast_to_schema(df, {"x": "text"}).dtypes == df.dtypes
    assert rename_columns(df, {"i": "id", "gone": "g", "d": ""}).columns == ["id", "d", "t", "x"]
    assert select_fields(df, ["x", "zzz"]).columns == ["x", "zzz"]
    assert stamp(df).first()["processed_at"] is not None
    two = spark.createDataFrame([(None, None), (1, None)], "a int, b int")
    assert drop_empty_rows(two).count() == 1
    days = spark.createDataFrame([(dt.datetime(2024, 1, d, 23, 59),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert date_window(days, "t", dt.date(2024, 1, 2), dt.date(2024, 1, 3)).count() == 2
    assert date_window(days, "t", preset="yesterday", today=dt.date(2024, 1, 3)).count() == 1
    with pytest.raises(ValueError):
        date_window(days, "t", start=dt.date(2024, 1, 1))
    assert project_dashboard(df.withColumnRenamed("t", "date"), "i", "none").columns == ["i", "order_date"]


def test_run_and_session_stats(spark):
    now = dt.datetime(2024, 1, 2, 12)
    runs = spark.createDataFrame(
        [(1, "a", "completed", now, now), (2, "a", "failed", dt.datetime(2024, 1, 1, 12), None),
         (3, "b", "completed", dt.datetime(2024, 1, 1, 13), dt.datetime(2024, 1, 1, 13, 0, 1, 500000)),
         (4, "b", None, None, None)],
        "execution_id int, job_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz",
    )
    s = run_stats(runs, now).first()
    assert (s["total_runs"], s["completed"], s["failed"], s["success_rate_percent"], s["recent_24h"]) == (4, 2, 1, 66.67, 2)
    assert run_stats(runs.limit(0), now).first()["success_rate_percent"] == 0.0
    assert {r["status"]: r["runs"] for r in status_counts(runs).collect()} == {"completed": 2, "failed": 1, "unknown": 1}
    assert [r["execution_id"] for r in recent_runs(runs).collect()] == [1, 3, 2, 4]
    only = recent_runs(runs, "b", "completed", 1).first()
    assert (only["execution_id"], only["duration_seconds"]) == (3, 1.5)
    sessions = spark.createDataFrame([(4, 3, 2.0, now), (0, 0, 4.0, now)], "total_files int, successful int, processing_time double, timestamp timestamp_ntz")
    t = session_stats(sessions).first()
    assert (t["total_files"], t["success_rate"], t["average_processing_time"]) == (4, 0.75, 3.0)
    assert session_stats(sessions.limit(0)).first()["success_rate"] == 0.0


def test_messages_and_workflow(spark):
    m = spark.createDataFrame(
        [([(True,), (None,)], True), ([], False), (None, True)],
        "attachments array<struct<is_data_file:boolean>>, processed boolean",
    )
    s = message_stats(m).first()
    assert (s["total_messages"], s["total_attachments"], s["data_files"]) == (3, 2, 1)
    r = spark.createDataFrame([("success", 10), ("failed", 5), ("skipped", 0)], "status string, records int")
    w = workflow_summary(r, 5).first()
    assert (w["total_files"], w["total_records"], w["successful_records"], w["records_per_second"]) == (3, 15, 10, 3.0)
    assert workflow_summary(r, 0).first()["records_per_second"] == 0.0


def test_recon_summary_and_alerts(spark):
    df = spark.createDataFrame(
        [("ok", 10.0), ("ok", 1.0), ("bad", -20000.0), ("bad", 10.0), (None, 2000.0)], "kind string, amount double"
    )
    s = recon_summary(df, F.coalesce(F.col("kind"), F.lit("")) == "ok", "amount", "kind")
    found = {(r["exception_type"], r["severity"]): r for r in s.collect()}
    assert set(found) == {("bad", "high"), ("bad", "low"), ("UNKNOWN", "medium"), ("TOTAL", "ALL")}
    total = found[("TOTAL", "ALL")]
    assert (total["rows"], total["exceptions"], total["match_rate"], total["amount_at_risk"]) == (5, 3, 40.0, -17990.0)
    flags = alert_flags(s, minutes=90).first().asDict()
    assert flags == {"exception_rate_alert": True, "amount_variance_alert": True, "processing_time_alert": False}
    none = recon_summary(df.limit(0), F.lit(True), "amount", "kind")
    assert alert_flags(none, 91).first()["processing_time_alert"] is True


def test_listings(spark):
    issues = spark.createDataFrame([("High",), ("high",), (None,), ("LOW",)], "severity string")
    assert issue_severity(issues).first().asDict() == {"high": 2, "medium": 0, "low": 1}
    assert {r["table_name"]: r["rows"] for r in table_counts({"a": issues, "b": issues.limit(1)}).collect()} == {"a": 4, "b": 1}
    report = spark.createDataFrame([("A, B",), ("A",), ("",)], "reason string")
    assert {r["reason"]: r["rows"] for r in reason_breakdown(report).collect()} == {"A": 2, "B": 1}
    reg = spark.createDataFrame(
        [("u1", "SRC", "x", 1), ("u2", "SRC", "y", 2), ("u3", "OTHER", "x", 3)],
        "upload_id string, datasource string, status string, uploaded_at int",
    )
    assert [r["upload_id"] for r in recent_uploads(reg).collect()] == ["u3", "u2", "u1"]
    assert [r["upload_id"] for r in recent_uploads(reg, "src", limit=1).collect()] == ["u2"]
    assert [r["upload_id"] for r in recent_uploads(reg, status="x", limit=0).collect()] == ["u3", "u1"]
    names = spark.createDataFrame([(" b",), ("a",), ("b ",), ("",), (None,)], "n string")
    assert [r["n"] for r in sorted_names(names, "n").collect()] == ["a", "b"]


@pytest.mark.parametrize("rule, text", [
    ("a * 2 > 0", "try_multiply(a, 2) > 0"),
    ("a - b - 1 <= -3 * b", "try_subtract(try_subtract(a, b), 1) <= try_multiply(-3, b)"),
    ("t + 1 > b", "try_add(try_cast(t AS DOUBLE), 1) > b"),
    ("t > 5 AND t = 'x - 1'", "try_cast(t AS DOUBLE) > 5 AND t = 'x - 1'"),
    ("t NOT BETWEEN 1 AND 2 OR t IN (1, 2)", "try_cast(t AS DOUBLE) NOT BETWEEN 1 AND 2 OR try_cast(t AS DOUBLE) IN (1, 2)"),
    ("CAST(t AS DECIMAL(10,2)) / b > 1 OR t::int IS NOT NULL", "try_divide(try_cast(t AS DECIMAL(10,2)), b) > 1 OR try_cast(t AS int) IS NOT NULL"),
    ("CASE WHEN a / b > 1 THEN a ELSE -b END * 2 = abs(t)", "try_multiply(CASE WHEN try_divide(a, b) > 1 THEN a ELSE try_subtract(0, b) END, 2) = abs(try_cast(t AS DOUBLE))"),
    ("t >= DATE '2024-01-01' AND d + INTERVAL 1 DAY > t", "try_cast(t AS DATE) >= DATE '2024-01-01' AND try_add(d, INTERVAL 1 DAY) > try_cast(t AS DATE)"),
    ("substring(t, 1 + 1, 2) || '-' = `odd name`", "substring(t, try_add(1, 1), 2) || '-' = `odd name`"),
    ("a # b", "a # b"),
])
def test_rules_by_their_try_forms(rule, text):
    schema = T._parse_datatype_string("a int, b bigint, t string, d date")
    assert safe_predicate(rule, schema) == text


def test_rules_do_not_wrap_and_leave_the_session_alone(spark):
    df = spark.sql(
        "SELECT 1 AS id, 2147483647 AS x, 9223372036854775807L AS y, CAST(9e37 AS DECIMAL(38,0)) AS z, 'seven' AS t"
        " UNION ALL SELECT 2, -3, -3L, CAST(-3 AS DECIMAL(38,0)), '-3'"
    )
    rules = [business_rule(n, r) for n, r in (
        ("int", "x * 2 > 0"), ("long", "y + 1 > 0"), ("decimal", "z * z - z > 0 AND z > 0"), ("zero", "x / (x - x) > 0"), ("text", "t > 0"), ("cast", "CAST(t AS INT) > 0"),
    )]
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = {(r["id"], r["rule"]) for r in violations(df, rules, "id").collect()}
    assert got == {(2, n) for n in ("int", "long", "decimal", "text", "cast")}
    assert {r["rule"]: r["failures"] for r in quality_report(df, rules).collect()} == {"int": 1, "long": 1, "decimal": 1, "zero": 0, "text": 1, "cast": 1}
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_enums_are_exact(spark):
    df = spark.sql("SELECT 9007199254740993L AS n, CAST('9007199254740993.5' AS DECIMAL(30,1)) AS d, 0.5D AS f UNION ALL SELECT 7, 7, 7")
    rules = [enum_set("n", [9007199254740992, "7.0"]), enum_set("d", ["9007199254740993.5", 7.5, 8]), enum_set("f", ["0.5", "x"])]
    assert sorted((r["n"], r["rule"]) for r in violations(df, rules, "n").collect()) == [(7, "enum_d"), (7, "enum_f"), (9007199254740993, "enum_n")]


def test_profile_of_loads_equals_that_of_their_union(spark):
    df = spark.range(3000).selectExpr("id", "IF(id % 4 = 0, NULL, id * 0.5) AS v", "IF(id < 1000, NULL, concat('t', id % 50)) AS t", "date_add(DATE'2024-01-01', CAST(id % 90 AS INT)) AS d")
    loads = [df.where(f"id >= {a} AND id < {b}") for a, b in ((0, 1000), (1000, 1100), (1100, 3000), (9000, 9001))]
    sketches = [load_sketches(d, str(i)) for i, d in enumerate(loads)]
    folded = {r["column_name"]: r for r in folded_profile(sketches[0].union(sketches[1]).union(sketches[2]).union(sketches[3])).collect()}
    exact = {r["column_name"]: r for r in profile_columns(df).collect()}
    assert set(folded) == set(exact)
    for name, e in exact.items():
        f = folded[name]
        assert all(f[c] == e[c] for c in ("position", "non_null_count", "null_count", "min_value", "max_value", "null_share"))
        assert abs(f["distinct_count"] - e["distinct_count"]) <= 0.08 * e["distinct_count"]
    assert abs(folded["id"]["q50"] - 1500) < 100 and abs(folded["v"]["q25"] - 375) < 50 and folded["t"]["q75"] is None
    nothing = folded_profile(load_sketches(df.limit(0), "0")).where("column_name = 'v'").first()
    assert (nothing["non_null_count"], nothing["distinct_count"], nothing["min_value"], nothing["q50"]) == (0, 0, None, None)


def test_exact_quantiles_are_those_of_percentile(spark):
    """Repeated values, gaps, few rows, no rows; places between two values, on one, and at both ends."""
    asked = [0.0, 0.2, 0.3, 0.45, 0.5, 0.77, 1.0]
    tables = [
        [k * 7 % 101 for k in range(500)] + [50] * 700 + [None] * 30, [5], [1, 2], [-3, -3, 8, None], [], [None, None],
    ]
    for values in tables:
        df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
        want = df.agg(F.percentile("v", asked).alias("p")).first()["p"]
        assert exact_quantiles(df, "v", asked).first()["p"] == want
    halves = spark.range(1001).select((F.col("id") / 8).alias("odd name"))
    assert exact_quantiles(halves, "odd name", [0.333]).first()["p"] == halves.agg(F.percentile("odd name", F.array(F.lit(0.333)))).first()[0]


def test_profile_of_loads_gathers_no_values_in_one_task(spark, tmp_path):
    lines = spark.range(3000).select((F.col("id") % 997).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("A").alias("l_returnflag"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = rules.profile_of_three_loads(spark, str(tmp_path))
    assert "percentile(" not in found._jdf.queryExecution().toString()
    assert [r["close"] for r in rows(found)] == [True] * 3
