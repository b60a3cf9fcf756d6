import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.config import ReportDefinition
from tallybook.plans.batch import build_reports
from tallybook.plans.report import (
    assign_formulas,
    build_dashboard,
    build_report,
    changed_sources,
    refresh_report,
    report_columns,
)
from tests.conftest import rows

DEFINITION = {
    "report_name": "settlement_vs_pos",
    "formulas": [
        {
            "logicNameKey": "NET_AMOUNT",
            "formulaText": "sales.bill_subtotal - sales.mvd + sales.merchant_pack_charge",
        },
        {"logicNameKey": "TOTAL_SALES", "formulaText": "NET_AMOUNT * 1.05"},
        {"logicNameKey": "FEE_BAND", "formulaText": "sales.bill_subtotal", "conditions": []},
        {
            "logicNameKey": "SLAB",
            "formulaText": "sales.bill_subtotal * 1",
            "conditions": [
                {"conditionType": "between", "value1": "0", "value2": "100", "formulaValue": "5"},
                {"conditionType": "greater_than", "value1": "100", "formulaValue": "10"},
            ],
        },
        {"logicNameKey": "POS_NET", "formulaText": "pos.net_sale"},
    ],
    "mapping_keys": {"sales": ["order_id", "order_date"], "pos": ["aggregator_order_no", "date"]},
    "conditions": {"sales": [{"column": "action", "operator": "equal", "value": "sale"}]},
    "delta_columns": [{"delta_column_name": "SALES_DELTA", "value": "TOTAL_SALES - POS_NET"}],
    "reasons": [
        {"reason": "Sales mismatch", "delta_column": "SALES_DELTA", "threshold": 1, "must_check": True},
        {"reason": "Large gap", "delta_column": "SALES_DELTA", "threshold": 50, "must_check": False},
    ],
}
DAY = dt.datetime(2024, 1, 15)


@pytest.fixture(scope="module")
def definition():
    return ReportDefinition.from_dict(DEFINITION)


@pytest.fixture(scope="module")
def sources(spark):
    sales = spark.createDataFrame(
        [
            ("A", DAY, 100.0, 10.0, 10.0, "sale"),
            ("B", DAY, 200.0, 0.0, 0.0, "sale"),
            ("C", DAY, 40.0, None, 0.0, "sale"),
            ("Z", DAY, 1.0, 1.0, 1.0, "refund"),
            (None, DAY, 1.0, 1.0, 1.0, "sale"),
        ],
        "order_id string, order_date timestamp_ntz, bill_subtotal double, mvd double, "
        "merchant_pack_charge double, action string",
    )
    pos = spark.createDataFrame(
        [
            ("A", DAY, 105.0),
            ("B", dt.datetime(2024, 1, 16), 210.0),
            ("D", DAY, 80.0),
        ],
        "aggregator_order_no string, date timestamp_ntz, net_sale double",
    )
    return {"sales": sales, "pos": pos}


def test_worked_example(sources, definition):
    report = build_report(
        sources, definition, fallback=True, order_ids={"pos": "aggregator_order_no"}, stamp=False
    )
    found = {(r["sales_mapping_key"] or r["pos_mapping_key"])[0]: r for r in rows(report)}
    assert sorted(found) == ["A", "B", "C", "D"]
    expected = {
        "A": (100.0, 105.0, 5.0, 105.0, 0.0, "", "RECONCILED"),
        "B": (200.0, 210.0, 10.0, 210.0, 0.0, "", "RECONCILED"),
        "C": (40.0, 42.0, 5.0, None, 42.0, "Sales mismatch", "UNRECONCILED"),
        "D": (None, None, None, 80.0, -80.0, "Sales mismatch", "UNRECONCILED"),
    }
    for name, want in expected.items():
        r = found[name]
        got = (
            r["net_amount"], r["total_sales"], r["slab"], r["pos_net"], r["sales_delta"],
            r["reason"], r["reconciliation_status"],
        )
        assert got == want, name
    assert found["B"]["sales_mapping_key"] == "B_2024-01-15 00:00:00"
    assert found["B"]["pos_mapping_key"] == "B_2024-01-16 00:00:00"
    assert found["A"]["order_date"] == DAY


def test_without_fallback_the_second_day_stays_alone(sources, definition):
    report = build_report(sources, definition, stamp=False)
    assert report.count() == 5
    alone = report.where("sales_mapping_key is null").count()
    assert alone == 2


def test_fallback_on_key_head_and_hot_id(spark, definition):
    sales = spark.createDataFrame(
        [("A", DAY, 1.0), ("A", dt.datetime(2024, 1, 10), 2.0)],
        "order_id string, order_date timestamp_ntz, bill_subtotal double",
    )
    late = [("A", dt.datetime(2024, 2, d), float(d)) for d in range(1, 20)]
    pos = spark.createDataFrame(
        late + [("Q", dt.datetime(2024, 2, d), 1.0) for d in range(1, 20)],
        "aggregator_order_no string, date timestamp_ntz, net_sale double",
    )
    plain = ReportDefinition.from_dict({**DEFINITION, "conditions": {}})
    report = build_report(
        {"sales": sales, "pos": pos}, plain, fallback=True, order={"pos": ["date"]},
        stamp=False, hot_rows=5,
    )
    found = rows(report)
    # 2 primary rows and 19 unclaimed Q rows; the smallest A key got the last A row.
    assert len(found) == 21
    claimed = [r for r in found if r["sales_mapping_key"] and r["pos_mapping_key"]]
    assert [(r["sales_mapping_key"][:12], r["pos_net"]) for r in claimed] == [("A_2024-01-10", 19.0)]


def test_number_and_text_keys_agree(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 7.0)], "id int, x double")
    b = spark.createDataFrame([(2, 1.0), (3, 2.0)], "id long, y double")
    doc = {
        "report_name": "r",
        "formulas": [
            {"logicNameKey": "XX", "formulaText": "a.x"},
            {"logicNameKey": "YY", "formulaText": "b.y"},
        ],
        "mapping_keys": {"a": ["id"], "b": ["id"]},
    }
    definition = ReportDefinition.from_dict(doc)
    numbers = build_report({"a": a, "b": b}, definition, order={"a": ["x"]}, stamp=False)
    texts = build_report(
        {"a": a.selectExpr("string(id) id", "x"), "b": b.selectExpr("string(id) id", "y")},
        definition, order={"a": ["x"]}, stamp=False,
    )
    assert rows(numbers) == rows(texts)
    assert {r["xx"] for r in rows(numbers)} == {5.0, 7.0, None}
    assert "reason" not in numbers.columns


def test_third_source_only_meets_primary_rows(spark):
    a = spark.createDataFrame([("k1", 1.0)], "id string, x double")
    b = spark.createDataFrame([("k1", 2.0), ("k2", 3.0)], "id string, y double")
    c = spark.createDataFrame([("k1", 4.0), ("k2", 5.0)], "id string, z double")
    definition = ReportDefinition.from_dict({
        "report_name": "r",
        "formulas": [
            {"logicNameKey": "XXX", "formulaText": "a.x * 1"},
            {"logicNameKey": "YYY", "formulaText": "b.y + XXX"},
            {"logicNameKey": "ZZZ", "formulaText": "c.z + YYY"},
        ],
        "mapping_keys": {s: ["id"] for s in "abc"},
        "delta_columns": [{"delta_column_name": "DDD", "value": "ZZZ - YYY"}],
    })
    report = build_report({"a": a, "b": b, "c": c}, definition, stamp=False)
    found = {(r["a_mapping_key"], r["b_mapping_key"], r["c_mapping_key"]): r for r in rows(report)}
    assert set(found) == {("k1", "k1", "k1"), (None, "k2", None), (None, None, "k2")}
    full = found[("k1", "k1", "k1")]
    assert (full["xxx"], full["yyy"], full["zzz"], full["ddd"]) == (1.0, 3.0, 7.0, 4.0)
    # the formula needs a column of a source without row: 0
    assert found[(None, "k2", None)]["yyy"] == 0.0
    assert found[(None, "k2", None)]["zzz"] is None
    assert {r["reconciliation_status"] for r in found.values()} == {"RECONCILED"}


def test_assignment_follows_dependencies(definition):
    plan = assign_formulas(definition)
    assert plan.primary == "sales"
    assert plan.owner["total_sales"] == "sales"
    assert plan.owner["pos_net"] == "pos"
    assert plan.late("pos") == set()


def test_refresh_keeps_other_columns_and_is_idempotent(spark, sources, definition):
    from pyspark.sql import functions as F

    first = build_report(sources, definition, stamp=False).withColumn("note", F.lit("kept"))
    changed = dict(sources)
    changed["pos"] = sources["pos"].withColumn("net_sale", F.col("net_sale") + 1)
    fresh = refresh_report(first, changed, definition, stamp=False)
    found = rows(fresh)
    assert len(found) == first.count()
    assert {r["note"] for r in found} == {"kept"}
    assert {r["pos_net"] for r in found} == {None, 106.0, 211.0, 81.0}
    again = refresh_report(fresh, changed, definition, stamp=False)
    assert rows(again) == found


def test_dashboard(spark, sources, definition):
    from pyspark.sql import functions as F

    report = build_report(sources, definition, stamp=False)
    t1, t2 = F.lit("2024-02-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")
    board = build_dashboard(report, definition, now=t1)
    assert sorted(r["total_sales"] for r in rows(board)) == [42.0, 105.0, 210.0]
    assert board.columns[:3] == ["sales_mapping_key", "total_sales", "order_date"]
    later = build_dashboard(report, definition, existing=board, now=t2)
    assert {r["created_at"].month for r in rows(later)} == {2}
    assert {r["updated_at"].month for r in rows(later)} == {3}
    bare = ReportDefinition.from_dict(
        {"report_name": "r", "formulas": [{"logicNameKey": "AAA", "formulaText": "sales.x"}]}
    )
    with pytest.raises(ValueError, match="TOTAL_SALES"):
        build_dashboard(report, bare)


def test_report_columns_match_the_report_of_one_source(sources, definition):
    alone = rows(report_columns(sources["sales"], definition))
    assert [r["total_sales"] for r in alone] == [105.0, 210.0, 42.0]
    assert alone[0]["sales_delta"] == 105.0


def test_definition_checks():
    with pytest.raises(ValueError, match="no usable formula"):
        ReportDefinition.from_dict({"report_name": "r", "formulas": [{"logicNameKey": "A"}]})
    circle = ReportDefinition.from_dict({
        "report_name": "r",
        "formulas": [
            {"logicNameKey": "AAA", "formulaText": "s.x + BBB"},
            {"logicNameKey": "BBB", "formulaText": "AAA * 2"},
        ],
    })
    with pytest.raises(ValueError, match="circle"):
        assign_formulas(circle)


def test_refresh_leaves_no_stale_rows(spark):
    """Half of the stored rows are one-sided and have found their partner since."""
    definition = ReportDefinition.from_dict({
        "report_name": "r",
        "formulas": [{"logicNameKey": "A", "formulaText": "one.a"}, {"logicNameKey": "B", "formulaText": "two.b"}],
        "mapping_keys": {"one": ["k"], "two": ["k"]},
        "delta_columns": [{"delta_column_name": "D", "value": "A - B"}],
    })
    one = spark.range(1, 9).selectExpr("id AS k", "id * 10.0D AS a")
    two = spark.range(3, 12).selectExpr("id AS k", "id * 1.0D AS b")
    early = build_report({"one": one.where("k > 5"), "two": two}, definition, stamp=False)
    stored = early.withColumn("note", F.lit("kept")).unionByName(
        spark.sql("SELECT '99' AS one_mapping_key, 'left' AS note"), allowMissingColumns=True
    )
    got = rows(refresh_report(stored, {"one": one, "two": two}, definition, stamp=False))
    fresh = rows(build_report({"one": one, "two": two}, definition, stamp=False))
    assert len(got) == len(fresh) + 1
    assert sum(r["d"] or 0 for r in got) == sum(r["d"] for r in fresh)
    for name in ("one_mapping_key", "two_mapping_key"):
        keys = [r[name] for r in got if r[name] is not None]
        assert len(keys) == len(set(keys))
    notes = {r["one_mapping_key"]: r["note"] for r in got}
    assert notes["7"] == "kept" and notes["99"] == "left" and notes["3"] is None


def test_refresh_by_changed_keys_equals_a_whole_refresh(spark):
    definition = ReportDefinition.from_dict({
        "report_name": "r",
        "formulas": [{"logicNameKey": "A", "formulaText": "one.v"}, {"logicNameKey": "B", "formulaText": "two.w"}],
        "mapping_keys": {"one": ["k"], "two": ["k"]},
        "delta_columns": [{"delta_column_name": "GAP", "value": "A - B"}],
    })
    one, two = spark.range(400).selectExpr("id AS k", "id * 1.0D AS v"), spark.range(100, 500).selectExpr("id AS k", "id * 2.0D AS w")
    stored = build_report({"one": one, "two": two}, definition, stamp=False).withColumn("note", F.lit("kept"))
    altered = spark.range(4).selectExpr("id * 130 AS k", "-1.0D AS v")  # 390 is one of them, 520 none before
    added = spark.createDataFrame([(450, 7.0), (900, 8.0)], "k long, w double")
    now = {"one": one.join(altered, "k", "left_anti").union(altered), "two": two.join(added, "k", "left_anti").union(added)}
    whole = refresh_report(stored, now, definition, stamp=False)
    few = refresh_report(stored, now, definition, changed={"one": altered, "two": added}, stamp=False)
    assert rows(few) == rows(whole) and few.count() == 501
    assert {r["note"] for r in few.where("one_mapping_key = '390' OR two_mapping_key = '450'").collect()} == {"kept"}
    reduced = changed_sources(now, {"one": altered, "two": added}, definition)
    assert {s: df.count() for s, df in reduced.items()} == {"one": 4, "two": 5}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti, BuildRight") >= 1 and "BroadcastHashJoin" in plan
    with pytest.raises(ValueError):
        refresh_report(stored, now, definition, changed={"one": altered}, fallback=True)


def family():
    def one(name, formulas, conditions=None, keys=("sales", "pos", "bank"), deltas=()):
        fields = {"sales": ["id"], "pos": ["ref"], "bank": ["utr"]}
        return ReportDefinition.from_dict({
            "report_name": name, "formulas": [{"logicNameKey": n, "formulaText": t} for n, t in formulas],
            "mapping_keys": {k: fields[k] for k in keys}, "conditions": conditions or {},
            "delta_columns": [{"delta_column_name": n, "value": v} for n, v in deltas],
        })

    both = [("TOTAL", "sales.amount"), ("POS_NET", "pos.net")]
    kind = lambda *values: {"sales": [{"column": "kind", "operator": "in", "value": list(values)}]}
    return [
        one("plain", both, keys=("sales", "pos"), deltas=[("GAP", "TOTAL - POS_NET")]),
        one("sold", both, kind("sale"), ("sales", "pos"), [("GAP", "TOTAL - POS_NET")]),
        one("other_columns", [("TOTAL", "sales.amount + sales.tax"), ("POS_NET", "pos.net - TOTAL")], kind("sale", "refund"), ("sales", "pos")),
        one("three", [*both, ("PAID", "bank.paid - POS_NET")], kind("refund")),
        one("pos_first", [("POS_NET", "pos.net"), ("TOTAL", "sales.amount")], keys=("sales", "pos")),
    ]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_reports_in_one_run_equal_single_ones(spark, kind):
    sales = spark.createDataFrame(
        [(1, 5.0, 1.0, "sale", 1, {"a": 1}), (1, 7.0, 1.0, "refund", 2, None), (1, 7.0, 2.0, "sale", 2, {"b": 2}), (2, 3.0, None, None, 1, None),
         (None, 9.0, 9.0, "sale", 1, None), (3, None, 1.0, "refund", 1, None), (3, None, 1.0, "refund", 1, None), (6, 1.0, 1.0, "sale", 1, None)],
        "id long, amount double, tax double, kind string, at int, more map<string,int>",
    ).withColumn("id", F.col("id").cast(kind))
    pos = spark.createDataFrame([(1, 2.0), (1, 4.0), (3, 1.0), (4, 8.0), (5, None)], "ref long, net double").withColumn("ref", F.col("ref").cast(kind))
    bank = spark.createDataFrame([(1, 2.0), (4, 6.0), (7, 1.0), (None, 1.0)], "utr long, paid double").withColumn("utr", F.col("utr").cast(kind))
    sources, order = {"sales": sales, "pos": pos, "bank": bank}, {"sales": ["at"], "pos": ["net"]}
    found = build_reports(sources, family(), order=order, stamp=False)
    assert list(found) == ["plain", "sold", "other_columns", "three", "pos_first"]
    for definition in family():
        alone = build_report(sources, definition, order=order, stamp=False)
        assert found[definition.name].columns == alone.columns
        assert found[definition.name].dtypes == alone.dtypes
        assert rows(found[definition.name]) == rows(alone)
    plan = found["sold"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    assert list(build_reports(sources, family(), names=["sold"], stamp=False)) == ["sold"]


def test_reports_in_one_run_of_no_rows_and_repeated_names(spark):
    empty = {"sales": spark.createDataFrame([], "id long, amount double, tax double, kind string"), "pos": spark.createDataFrame([], "ref long, net double")}
    for df in build_reports(empty, [d for d in family() if d.name != "three"]).values():
        assert df.count() == 0
    with pytest.raises(ValueError, match="differ"):
        build_reports(empty, [family()[0], family()[0]])
    with pytest.raises(ValueError, match="bank"):
        build_reports(empty, family())
