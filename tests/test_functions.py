import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.config import Condition, Formula
from tallybook.functions.dates import (
    is_date_name,
    order_date,
    parse_date,
    parse_with_hints,
    preset_window,
    sanitize,
)
from tallybook.functions.formula import FormulaError, calculated_columns, delta_columns, parse_formula
from tallybook.functions.keys import key_head, mapping_key, unique_id
from tallybook.functions.predicates import bucket_value, scan_filtered
from tallybook.functions.reasons import with_reasons
from tallybook.functions.text import (
    batch_label,
    clean_strings,
    file_type,
    outcome_label,
    parse_amount,
    safe_name,
)
from tallybook.sources.landing import normalize_header, normalize_names
from tests.conftest import rows

D = dt.datetime


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()[0]


def many(spark, column, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    found = df.select("i", column(F.col("c")).alias("r")).collect()
    return [r["r"] for r in sorted(found, key=lambda r: r["i"])]


def test_headers():
    cases = {
        "PG Chgs %": "pg_chgs_percentage",
        "Order ID (Primary)": "order_id_primary",
        "No_ of Covers - AIB": "no_of_covers_aib",
        "Time when Trans_ Closed": "time_when_trans_closed",
        "A/B": "aorb",
        "Amount $USD": "amount_dollarusd",
        "***": "unnamed_column",
        "": "unnamed_column",
        "a.b": "ab",
    }
    assert {h: normalize_header(h) for h in cases} == cases
    assert normalize_names(["Amount", "amount", "AMOUNT"]) == ["amount", "amount_1", "amount_2"]
    assert len(set(normalize_names(["a", "a", "a_1", "A_1"]))) == 4


def test_dates(spark):
    jan15 = D(2024, 1, 15)
    cases = {
        "01/02/2024": D(2024, 1, 2),
        "15/01/2024": jan15,
        "11/25/2024 0:00": D(2024, 11, 25),
        "2024-01-15 10:30:45": D(2024, 1, 15, 10, 30, 45),
        "2024-01-15 10:30:45.25": D(2024, 1, 15, 10, 30, 45, 250000),
        "20240115": jan15,
        "15 Jan 2024": jan15,
        "15 January 2024": jan15,
        "15.01.2024": jan15,
        "2024.01.15": jan15,
        "2024/1/15 1:02": D(2024, 1, 15, 1, 2),
        "13-01-2024": D(2024, 1, 13),
        "Jan 5, 2024": D(2024, 1, 5),
        "january 5, 2024": D(2024, 1, 5),
        "2024-1-5": D(2024, 1, 5),
        " 2024-1-5 ": D(2024, 1, 5),
        "2024-01-15T10:30:00Z": D(2024, 1, 15, 10, 30),
        "2024-01-15T10:30:00+05:30": D(2024, 1, 15, 5, 0),
        "202411": None,
        "nan": None,
        "null": None,
        "None": None,
        "  ": None,
        "x": None,
        "5": None,
        "31/02/2024": None,
    }
    assert dict(zip(cases, many(spark, parse_date, list(cases)))) == cases


def test_date_hints_and_names(spark):
    hints = ["dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy"]
    found = many(spark, lambda c: parse_with_hints(c, hints), ["05-02-2024", "2024-02-05", "05/02/24", "?"])
    assert found == [D(2024, 2, 5)] * 3 + [None]
    assert is_date_name("vendor") and is_date_name("Order Date") and not is_date_name("amount")
    assert preset_window("last7days", dt.date(2024, 3, 8)) == (dt.date(2024, 3, 1), dt.date(2024, 3, 8))
    with pytest.raises(ValueError):
        preset_window("tomorrow", dt.date(2024, 3, 8))


def test_sanitize(spark):
    df = spark.createDataFrame(
        [(" a ", "15/01/2024", 1), ("  ", "soon", 2)], "name string, order_date string, n int"
    )
    clean = sanitize(df, ["name", "order_date", "n", "gone"])
    assert clean.columns == ["name", "order_date", "order_date_raw", "n", "gone"]
    assert rows(clean, "n") == [
        {"name": "a", "order_date": D(2024, 1, 15), "order_date_raw": None, "n": 1, "gone": None},
        {"name": None, "order_date": None, "order_date_raw": "soon", "n": 2, "gone": None},
    ]
    assert sanitize(df, ["order_date"], date_fields=[]).columns == ["order_date"]


def test_order_date(spark):
    df = spark.createDataFrame([("", "b"), ("a", "b"), (None, None)], "order_date string, date string")
    assert [r[0] for r in df.select(order_date(df)).collect()] == ["b", "a", None]


def test_keys(spark):
    df = spark.createDataFrame(
        [(1, " 7 ", "x", 1e10, 12345678.5, True, D(2024, 1, 15), [1, 2], {"b": 1, "a": 2}),
         (2, "7", None, 0.0, -0.25, False, D(2024, 1, 15, 1, 2, 3, 4), [], {}),
         (3, "7", "", 7.0, 1e-3, None, None, None, None)],
        "id int, a string, b string, d double, e double, f boolean, t timestamp_ntz, l array<int>, m map<string,int>",
    )

    def keyed(*fields):
        found = df.select("id", mapping_key(df, fields).alias("k")).collect()
        return [r["k"] for r in sorted(found, key=lambda r: r["id"])]

    assert keyed("a", "b") == ["7_x", None, None]
    assert keyed("d") == ["10000000000.0", "0.0", "7.0"]
    assert keyed("e") == ["12345678.5", "-0.25", "0.001"]
    assert keyed("t") == ["2024-01-15 00:00:00", "2024-01-15 01:02:03.000004", None]
    assert keyed("l") == ["1_2", None, None]
    assert keyed("m") == ['{"a":2,"b":1}', "{}", None]
    assert keyed("f") == ["True", "False", None]
    assert keyed("nope") == [None] * 3
    assert [r[0] for r in df.select(unique_id(df, [])).collect()] == [None] * 3
    assert {r[0] for r in df.select(mapping_key(df, [], row_id="id")).collect()} == {"1", "2", "3"}
    assert many(spark, key_head, ["A_1_2", "A", "_x", None]) == ["A", None, None, None]


FORMULA_ROW = ("a double, b double, z double, n double, t string, s string, day timestamp_ntz, k long", (5.0, -3.0, 0.0, None, "12.5", "abc", D(2024, 1, 1), None))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("src.a - src.b", 8.0),
        ("src.a / src.z", 0.0),
        ("src.n + 1", 1.0),
        ("src.t * 2", 25.0),
        ("src.s + 1", 1.0),
        ("src.a // 2", 2.0),
        ("src.b // 2", -2.0),
        ("1 // 0.1", 9.0),
        ("src.a // src.z", 0.0),
        ("(src.a + 1) * 2 ** 2", 24.0),
        ("src.z ** -1", 0.0),
        ("src.b ** 2", 9.0),
        ("-src.a + +1", -4.0),
        ("src.s", "abc"),
        ("src.n", 0.0),
        ("src.k", 0),
        ("src.day", D(2024, 1, 1)),
        ("src.day + 1", 1.0),
        ("src.missing + 1", 1.0),
        ("src.missing", 0.0),
        ("OTHER + 1", 0.0),
        ("src.a * 1e-5", 5e-05),
        ("0.05 * src.a", 0.25),
    ],
)
def test_formulas(spark, text, want):
    df = spark.createDataFrame([FORMULA_ROW[1]], FORMULA_ROW[0])
    found = calculated_columns(df, [Formula("OUT", text)]).first()["out"]
    assert found == want and type(found) is type(want)


def test_formula_chain_and_name_shadowing(spark):
    df = spark.createDataFrame([(10.0, 2.0)], "net double, fee double")
    formulas = [
        {"logicNameKey": "SUM", "formulaText": "NET * 2 + s.net"},
        {"logicNameKey": "NET", "formulaText": "s.net - s.fee"},
        {"logicNameKey": "VIA", "formulaText": "s.SUM + 1"},
        {"logicNameKey": "", "formulaText": "1"},
    ]
    out = calculated_columns(df, formulas)
    assert out.columns == ["fee", "sum", "net", "via"]
    assert out.first().asDict() == {"fee": 2.0, "sum": 26.0, "net": 8.0, "via": 27.0}


def test_text_result_as_input(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,)], "t string")
    out = calculated_columns(
        df, [{"logicNameKey": "TXT", "formulaText": "s.t"}, {"logicNameKey": "USE", "formulaText": "TXT + 1"}]
    )
    assert [(r["txt"], r["use"]) for r in out.collect()] == [("12.5", 13.5), ("abc", 0.0), ("0", 1.0)]


def test_formula_rejects_code(spark):
    for text in ("__import__('os')", "s.x % 2", "f(s.x)", "s.x if 1 else 2", "'a'", "s.x.y", "1 +"):
        with pytest.raises(FormulaError):
            parse_formula(text)
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.warns(UserWarning):
        assert calculated_columns(df, [{"logicNameKey": "BAD", "formulaText": "s.x % 2"}]).first()["bad"] == 0.0
    with pytest.raises(ValueError, match="circle"):
        calculated_columns(df, [{"logicNameKey": "AAA", "formulaText": "AAA + 1"}])


def test_buckets(spark):
    conditions = [
        {"conditionType": "equal", "value1": 0, "formulaValue": "1"},
        {"conditionType": "BETWEEN", "value1": "1", "value2": "5", "formulaValue": 2},
        {"conditionType": "less_than", "value1": "-5", "formulaValue": "3"},
        {"conditionType": "greater_equal", "value1": "x", "formulaValue": "4"},
        {"conditionType": "strange", "value1": "1", "formulaValue": "5"},
        {"conditionType": "greater_than", "value1": "5", "formulaValue": "bad"},
    ]
    found = many(spark, lambda c: bucket_value(c, conditions), [0.0, 1.0, 5.0, 5.5, -6.0, -1.0], "double")
    assert found == [1.0, 2.0, 2.0, 0.0, 3.0, 0.0]
    df = spark.createDataFrame([(3.0, 0.0)], "a double, z double")
    out = calculated_columns(df, [
        {"logicNameKey": "DIRECT", "formulaText": "s.a", "conditions": conditions},
        {"logicNameKey": "BASED", "formulaText": "s.a * 1", "conditions": conditions},
        {"logicNameKey": "ERROR", "formulaText": "s.a / s.z", "conditions": conditions},
    ]).first()
    # a plain reference ignores its conditions, an error gives 0 rather than the bucket of 0
    assert out["direct"] == 3.0 and out["based"] == 2.0 and out["error"] == 0.0


@pytest.mark.parametrize(
    ("operator", "value", "want"),
    [
        ("equal", 1, {1}), ("not_equal", 1, {2, None}), ("greater_than", 1, {2}),
        ("less_than", 2, {1}), ("greater_equal", 2, {2}), ("less_equal", 1, {1}),
        ("in", [1], {1}), ("not_in", [1], {2, None}), ("equal", "null", {None}),
        ("not_equal", " None ", {1, 2}), ("equal", "1", set()), ("not_equal", "1", {1, 2, None}),
        ("greater_than", "0", set()), ("in", [1, None], {1, None}), ("not_in", [1, None], {2}),
        ("in", ["1"], set()), ("greater_than", None, set()),
    ],
)
def test_filters(spark, operator, value, want):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    kept = scan_filtered(df, [{"column": "v", "operator": operator, "value": value}])
    assert {r["v"] for r in kept.collect()} == want


def test_filter_combinations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "v int, s string")
    same = [Condition("v", "greater_than", 0), Condition("v", "greater_than", 2)]
    assert [r["v"] for r in scan_filtered(df, same).collect()] == [3]
    both = [Condition("v", "greater_than", 1), Condition("s", "not_equal", "b")]
    assert [r["v"] for r in scan_filtered(df, both).collect()] == [3]
    assert scan_filtered(df, [Condition("gone", "equal", None)]).count() == 3
    assert scan_filtered(df, [Condition("gone", "equal", 1)]).count() == 0
    assert scan_filtered(df, []) is df
    with pytest.raises(ValueError):
        Condition("v", "like", 1)
    with pytest.raises(ValueError):
        Condition("v", "in", "abc")


def test_text(spark):
    df = spark.createDataFrame([(" a\t", "", 1)], "a string, b string, n int")
    assert clean_strings(df).first().asDict() == {"a": "a", "b": None, "n": 1}
    amounts = many(spark, parse_amount, ["1,23,456.78", "₹ 500", "abc", "-12.5", "Rs. 1,000", "", None, "1.2.3"])
    assert [None if a is None else str(a) for a in amounts] == [
        "123456.78", "500.00", None, "-12.50", "1000.00", None, None, None,
    ]
    assert str(one(spark, lambda c: parse_amount(c, "de_DE"), "1.234,50 €".replace(" €", ""))) == "1234.50"
    names = many(spark, safe_name, ['a<b>:"c|?*.csv', " x$y é.txt ", "n" * 120 + ".xlsx", "plain"])
    assert names == ["a_b___c___.csv", "xy é.txt", "n" * 95 + ".xlsx", "plain"]
    assert many(spark, file_type, ["A.CSV", "noext", "x.tar.gz"]) == ["csv", "", "gz"]
    assert many(spark, outcome_label, [0, 1, 10, 11], "int") == [
        "perfect", "few_exceptions", "few_exceptions", "many_exceptions",
    ]
    assert many(spark, lambda c: outcome_label(c, F.lit(90.0)), [0], "int") == ["many_exceptions"]
    assert many(spark, lambda c: batch_label(F.lit(3), c), [0, 1, 3], "int") == ["ok", "partial", "failed"]


def test_deltas(spark):
    df = spark.createDataFrame(
        [(5.0, None, "abc", "k")], "total_sales double, pos double, txt string, a_mapping_key string"
    )
    out = delta_columns(df, [
        {"delta_column_name": "ONE", "value": "TOTAL_SALES - POS"},
        {"delta_column_name": "TWO", "value": "ONE * 2 + unknown"},
        {"delta_column_name": "THREE", "value": "TOTAL_SALES / POS"},
        {"delta_column_name": "FOUR", "value": "TXT + 1"},
        {"delta_column_name": "FIVE", "value": "a_mapping_key + 2"},
        {"delta_column_name": "", "value": "1"},
    ]).first()
    assert (out["one"], out["two"], out["three"], out["four"], out["five"]) == (5.0, 10.0, 0.0, 1.0, 2.0)


def test_reasons(spark):
    df = spark.createDataFrame([(60.0, 0.0), (-2.0, 9.0), (1.0, 0.0), (None, None)], "d double, e double")
    reasons = [
        {"reason": "A", "delta_column": "D", "threshold": -1, "must_check": False},
        {"reason": "B", "delta_column": "D", "threshold": 50, "must_check": False},
        {"reason": "C", "delta_column": "e", "threshold": 5, "must_check": True},
        {"reason": "D", "delta_column": "gone", "threshold": 0, "must_check": True},
        {"reason": "", "delta_column": "e"},
    ]
    found = [(r["reason"], r["reconciliation_status"]) for r in with_reasons(df, reasons).collect()]
    assert found == [
        ("A", "UNRECONCILED"), ("A, C", "UNRECONCILED"), ("", "RECONCILED"), ("", "RECONCILED"),
    ]
    assert {r["reconciliation_status"] for r in with_reasons(df, []).collect()} == {"RECONCILED"}
