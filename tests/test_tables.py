import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallybook.config import CollectionConfig
from tallybook.operators.joins import (
    chain_match,
    keys_present,
    merge_with_fallback,
    settlement_match,
    unmatched,
)
from tallybook.operators.skew import HotKeys, hot_keys, lookup_join, numbered_copies
from tallybook.operators.tables import (
    archive_processed,
    change_counts,
    change_labels,
    combine_sources,
    duplicate_rows,
    latest_and_keyless,
    latest_per_key,
    observed_fields,
    set_status,
    set_upload_status,
    status_changes,
    upsert,
    write_archive,
)
from tallybook.plans.collection import process_collection
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, many rows without key, and 200 ordinary keys."""
    hot = spark.range(1000).selectExpr("7L AS k", "id AS n", "id % 10 AS t")
    none = spark.range(500).selectExpr("CAST(NULL AS LONG) AS k", "id + 5000 AS n", "id % 3 AS t")
    rest = spark.range(1500).selectExpr("id % 200 + 100 AS k", "id + 10000 AS n", "id % 7 AS t")
    return hot.union(none).union(rest)


def test_hot_keys(skewed):
    hot = hot_keys(skewed, ["k"], hot_rows=400)
    assert len(hot.hashes) == 1 and hot.nulls
    assert not hot_keys(skewed, ["k"], hot_rows=2000)
    assert hot_keys(skewed, ["k"], hot_rows=700) == HotKeys(hot.hashes, False)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [400, 700, 10**9])
def test_lookup_join_equals_plain_join(spark, skewed, how, hot_rows):
    right = spark.range(150).selectExpr("id AS k", "id * 2 AS v")
    got = lookup_join(skewed, right, ["k"], how, hot_rows)
    want = skewed.join(right, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("order", [["n"], ["t", "n"]])
def test_numbered_copies_equal_a_plain_window(skewed, order):
    from pyspark.sql import Window

    by_key = Window.partitionBy("k").orderBy(*order)
    want = skewed.withColumns({
        "copies": F.count(F.lit(1)).over(Window.partitionBy("k")),
        "copy_number": F.row_number().over(by_key),
    })
    for hot_rows in (400, 10**9):
        got = numbered_copies(skewed, ["k"], order, hot_rows)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert [(r["n"], r["copies"], r["copy_number"]) for r in rows(duplicate_rows(df, ["k"], ["n"]))] == [
        (1, 2, 1), (2, 2, 2),
    ]


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [("a", 1, None, {"x": 1}), ("a", 2, "p", {"x": 2}), ("a", 2, "q", None), ("b", None, "r", None)],
        "k string, o int, v string, m map<string,int>",
    )
    got = rows(latest_per_key(df, ["k"], ["o"]))
    assert [(r["k"], r["o"], r["v"]) for r in got] == [("a", 2, "q"), ("b", None, "r")]
    plain = latest_per_key(df.drop("m"), ["k"], ["o"])
    assert plain.columns == ["k", "o", "v"]
    assert [(r["k"], r["v"]) for r in rows(plain)] == [("a", "q"), ("b", "r")]
    assert latest_per_key(df.select("k"), ["k"]).count() == 2


def tables(spark):
    existing = spark.createDataFrame([("k1", 1, 9)], "k string, a int, extra int")
    incoming = spark.createDataFrame(
        [("k1", 2, 0), ("k2", 3, 0), ("k2", 4, 1), (None, 5, 0)], "k string, a int, o int"
    )
    return existing, incoming


def test_upsert_and_labels(spark):
    existing, incoming = tables(spark)
    merged = upsert(existing, incoming, "k", order=["o"]).drop("o")
    want = [(None, 5, None), ("k1", 2, 9), ("k2", 4, None)]
    assert [(r["k"], r["a"], r["extra"]) for r in rows(merged, "k")] == want
    labels = change_labels(existing, incoming, "k", ["o"], ignore=["o"])
    assert sorted((str(r["k"]), r["change"], r["changed_fields"]) for r in labels.collect()) == [
        ("None", "insert", []), ("k1", "update", ["a"]), ("k2", "insert", []),
    ]
    assert change_counts(labels).first().asDict() == {
        "inserted": 2, "updated": 1, "skipped": 0, "processed": 3,
    }
    again = upsert(merged, incoming, "k", order=["o"]).drop("o")
    assert rows(again.where("k is not null")) == rows(merged.where("k is not null"))
    assert again.where("k is null").count() == 2
    repeat = change_labels(merged, incoming, "k", ["o"], ignore=["o"])
    assert sorted((str(r["k"]), r["change"]) for r in repeat.collect()) == [
        ("None", "insert"), ("k1", "unchanged"), ("k2", "unchanged"),
    ]


def test_stamps_are_no_change(spark):
    a = spark.createDataFrame([("k", 1, 1)], "k string, v int, processed_at int")
    b = spark.createDataFrame([("k", 1, 2)], "k string, v int, processed_at int")
    assert change_labels(a, b, "k").first()["change"] == "unchanged"
    assert upsert(a, b, "k").first()["processed_at"] == 2
    assert upsert(a, b, "k", insert_only=["processed_at"]).first()["processed_at"] == 1


@pytest.mark.parametrize("hot_rows", [400, 10**9])
def test_archive_splits_every_row(spark, skewed, hot_rows):
    done = spark.createDataFrame([(7,), (7,), (101,), (None,)], "k long")
    backup, rest = archive_processed(skewed, done, "k", hot_rows)
    assert backup.unionByName(rest).exceptAll(skewed).count() == 0
    assert backup.count() + rest.count() == skewed.count()
    assert {r["k"] for r in backup.select("k").distinct().collect()} == {7, 101}


def test_keys_present_and_unmatched(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    b = spark.createDataFrame([(2, 1.0), (2, 2.0), (3, 3.0)], "k int, y double")
    assert [r["x"] for r in keys_present(a, b, ["k"]).collect()] == ["b"]
    found = sorted((str(r["k"]), r["side"]) for r in unmatched(a, b, ["k"]).collect())
    assert found == [("1", "left_only"), ("3", "right_only"), ("None", "left_only")]


@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_fallback_against_plain_python(spark, hot_rows):
    primary = [f"{i}_{d}" for i in range(6) for d in "ab"]
    secondary = [(f"{i}_{d}", n) for n, (i, d) in enumerate((i, d) for i in (0, 1, 2, 9) for d in "bcdefg")]
    secondary += [("nohead", 99)]
    p = spark.createDataFrame([(k, 1) for k in primary], "key string, x int")
    s = spark.createDataFrame(secondary, "key string, n int")
    taken = {k for k, _ in secondary}
    want = {}
    for k, n in sorted(secondary, key=lambda r: r[1]):
        head = k.split("_")[0] if "_" in k else None
        free = [q for q in sorted(primary) if q.split("_")[0] == head and q not in taken]
        target = k if k in primary or not free else free[0]
        want[target] = (k, n)
    got = merge_with_fallback(p, s, "key", order=["n"], hot_rows=hot_rows)
    found = {r["key"]: (r["secondary_key"], r["n"]) for r in got.collect() if r["n"] is not None}
    assert found == want
    assert {r["key"] for r in got.collect()} == set(primary) | set(want)


def test_fallback_with_id_column(spark):
    p = spark.createDataFrame([("A_1",), ("B_1",)], "key string")
    s = spark.createDataFrame([("x", "A", 1), ("B_9", None, 2)], "key string, oid string, n int")
    got = merge_with_fallback(p, s, "key", order_id=F.col("oid"))
    assert {(r["key"], r["secondary_key"]) for r in got.collect()} == {("A_1", "x"), ("B_1", "B_9")}


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_chain_and_settlement(spark, hot_rows):
    trm = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, 10.0), (3, 10.0), (4, 10.0)], "id int, amt double")
    mpr = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 10.0), (3, 99.0), (None, 1.0)], "ref int, amt double")
    bank = spark.createDataFrame([(1, 10.0), (3, 10.0), (4, 10.0)], "bref int, amt double")
    got = chain_match(
        trm, mpr, bank, {"trm": "id", "mpr": "ref", "bank": "bref"}, dict.fromkeys(("trm", "mpr", "bank"), "amt"),
        tolerance=0.5, hot_rows=hot_rows,
    )
    assert sorted((r["id"], r["level"]) for r in got.collect()) == [
        (1, "FULL_CHAIN"), (1, "FULL_CHAIN"), (2, "MISSING_BANK"), (3, "AMOUNT_MISMATCH"), (4, "MISSING_MPR"),
    ]
    paid = spark.createDataFrame([(1, 10.4), (2, 20.0)], "id int, credited double")
    settled = settlement_match(trm, paid, "id", "amt", "credited", 0.5, hot_rows)
    assert sorted((r["id"], r["settlement_status"]) for r in settled.collect()) == [
        (1, "SETTLED"), (1, "SETTLED"), (2, "VARIANCE"), (3, "UNSETTLED"), (4, "UNSETTLED"),
    ]


def test_registry_updates(spark):
    reg = spark.createDataFrame(
        [("u1", "A", "stored", dt.datetime(2024, 1, 1)), ("u2", "A", "done", dt.datetime(2024, 1, 1)),
         ("u3", "B", None, dt.datetime(2024, 1, 1))],
        "upload_id string, datasource string, status string, updated_at timestamp",
    )
    assert status_changes(reg, "A", "done").first()["changed"] == 1
    assert status_changes(reg, "B", "done").first()["changed"] == 1
    changed = rows(set_status(reg, "A", "done"), "upload_id")
    assert [r["status"] for r in changed] == ["done", "done", None]
    assert changed[0]["updated_at"].year > 2024 and changed[1]["updated_at"].year == 2024
    assert [r["status"] for r in rows(set_upload_status(reg, "u3", "failed"), "upload_id")][2] == "failed"


def test_combine_and_observed(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 3.0)], "k int, b double")
    both = combine_sources([a, b, a])
    assert both.columns == ["k", "a", "b"] and both.count() == 3
    with pytest.raises(ValueError):
        combine_sources([])
    js = spark.createDataFrame([('{"p": 1, "_id": 2}',), ('{"q": {"r": 1}}',), ("broken",), (None,)], "j string")
    reg = spark.createDataFrame([("p",), ("z",), ("created_at",), ("",)], "field string")
    assert [r["field"] for r in rows(observed_fields(js, "j", reg))] == ["p", "q", "z"]


def test_process_collection(spark):
    raw = spark.createDataFrame(
        [(" 7", "x", "01/02/2024", 1), ("7", "x", "15/01/2024", 2), ("8", "", "n/a", 3), (None, "y", None, 4)],
        "id string, kind string, order_date string, n int",
    )
    config = CollectionConfig(("id", "kind", "order_date"), ("id", "kind"), ("n",))
    first = process_collection(raw, None, config, stamp=False)
    got = rows(first.processed, "unique_id", "id")
    assert [(r["unique_id"], r["id"], r["order_date"], r["order_date_raw"]) for r in got] == [
        ("7_x", "7", dt.datetime(2024, 1, 15), None),
        (None, "8", None, "n/a"),
        (None, None, None, None),
    ]
    assert rows(first.backup) == rows(raw)
    assert first.counts.first().asDict() == {"inserted": 3, "updated": 0, "skipped": 0, "processed": 3}
    second = process_collection(raw, first.processed, config)
    assert second.counts.first().asDict() == {"inserted": 2, "updated": 0, "skipped": 1, "processed": 3}
    assert second.processed.where("unique_id = '7_x'").count() == 1
    assert second.processed.where("processed_at is not null").count() == 3
    no_ids = process_collection(raw, None, CollectionConfig(("id",)), stamp=False)
    assert no_ids.processed.count() == 4


TYPE_PAIRS = [
    ("int", "long"), ("long", "int"), ("short", "decimal(12,2)"), ("decimal(10,1)", "decimal(14,3)"), ("float", "double"),
    ("string", "int"), ("int", "string"), ("date", "timestamp_ntz"), ("timestamp", "date"),
]


@pytest.mark.parametrize("left_type, right_type", TYPE_PAIRS)
def test_hot_keys_of_other_types_match_as_in_a_plain_join(spark, left_type, right_type):
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    dated = "date" in (left_type, right_type)
    key = lambda c, kind: (day(c) if dated else c).cast(kind)
    n = F.col("id")
    left = spark.range(900).select(key(F.when(n < 500, 3).otherwise(n % 40), left_type).alias("k"), n.alias("n"))
    right = spark.range(20).select(key(n, right_type).alias("k"), (n * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got, want = lookup_join(left, right, ["k"], how, hot_rows=100), left.join(right, ["k"], how)
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert hot_keys(left, ["k"], 100)


def test_mixed_types_in_archive_and_settlement(spark):
    raw = spark.range(1000).selectExpr("5 AS k", "id AS n")
    backup, rest = archive_processed(raw, spark.sql("SELECT 5L AS k"), "k", hot_rows=10)
    assert (backup.count(), rest.count()) == (1000, 0)
    payments = spark.range(200).selectExpr("7 AS k", "10.0D AS paid")
    statements = spark.sql("SELECT 7L AS k, 10.0D AS credited")
    found = settlement_match(payments, statements, "k", "paid", "credited", 0.5, hot_rows=10)
    assert {r["settlement_status"] for r in found.collect()} == {"SETTLED"}


def test_no_job_runs_while_a_lookup_is_planned_and_spark_splits_its_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 20000, 1, 8).selectExpr("IF(id < 15000, 1, id) AS k", "uuid() AS n")
        known = spark.range(40000).selectExpr("id % 20000 AS k")
        tracker = spark.sparkContext.statusTracker()
        jobs = len(tracker.getJobIdsForGroup(None))
        found = keys_present(left, known, ["k"])
        assert len(tracker.getJobIdsForGroup(None)) == jobs
        assert found.count() == 20000
        found.write.format("noop").mode("overwrite").save()
        ran = found._jdf.queryExecution()
        ran.executedPlan().execute().count()
        assert "skew=true" in ran.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_copy_numbers_where_clocks_change(spark, kind):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = F.lit("2024-03-10 00:00:00").cast(kind)
        df = spark.range(480).select(F.lit(1).alias("k"), (start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 3).cast("int"), F.lit(0))).alias("at"), "id")
        from pyspark.sql import Window

        want = df.withColumn("copy_number", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
        got = numbered_copies(df, ["k"], ["at", "id"], hot_rows=10).drop("copies")
        assert got.exceptAll(want).count() == 0 and got.count() == 480
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_copy_numbers_in_text_order(spark):
    from pyspark.sql import Window

    df = spark.range(3000).selectExpr("id % 2 AS k", "concat('same beginning of all ', IF(id % 3 = 0, 'é', ''), md5(cast(id AS string))) AS t", "id")
    df = df.union(spark.range(600).selectExpr("id % 2", "IF(id % 2 = 0, '', NULL)", "id + 10000"))
    want = df.withColumn("copy_number", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    got = numbered_copies(df, ["k"], ["t", "id"], hot_rows=10).drop("copies")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_rows_without_key_stay_apart(spark):
    old = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (5, 2, "b")], "k int, n int, note string")
    new = spark.createDataFrame([(None, 1), (None, 1), (5, 3), (6, 4)], "k int, n int")
    for unique in (True, False):
        got = rows(upsert(old, new, "k", unique=unique))
        assert sorted(((r["k"], r["n"], r["note"]) for r in got), key=str) == sorted(
            [(None, 1, "a"), (None, 1, "a"), (None, 1, None), (None, 1, None), (5, 3, "b"), (6, 4, None)], key=str
        )
        assert sorted(r["change"] for r in rows(change_labels(old, new, "k", unique=unique))) == ["insert", "insert", "insert", "update"]


def test_one_key_with_all_rows_spreads_over_all_partitions(spark, tmp_path):
    """Ordered by texts that share 40 characters: every range partition holds its share, and the numbers go on across them."""
    df = spark.range(4000).selectExpr("'k' AS k", "concat(repeat('same ', 8), md5(cast(id AS string))) AS t", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered_copies(df, ["k"], ["t"], path=f"{tmp_path}/stored").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/stored").groupBy(F.expr("__place >> 33")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert [r["copy_number"] for r in sorted(got, key=lambda r: r["t"])] == list(range(1, 4001)) and {r["copies"] for r in got} == {4000}
    assert dict(numbered_copies(df, ["k"], ["t"]).dtypes)["copy_number"] == "bigint"


def test_archive_is_written_in_one_pass(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    seen = Observation()
    backup, rest, figures = write_archive(raw.observe(seen, F.count(F.lit(1)).alias("n")), raw.where("v = 'a'"), "k", f"{tmp_path}/a")
    assert sorted(r["v"] for r in backup.collect()) == ["a", "b"] and sorted(r["v"] for r in rest.collect()) == ["c", "d"]
    assert figures == {"backup": 2, "raw": 2} and seen.get == {"n": 4} and backup.columns == raw.columns


def test_rows_without_key_that_differ_in_a_map(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS k, map('a', 1) AS m UNION ALL SELECT NULL, map('a', 2) UNION ALL SELECT NULL, map('a', 2) UNION ALL SELECT 1, map('b', 1) UNION ALL SELECT 1, map('b', 2)")
    got = latest_and_keyless(df, "k").collect()
    assert sorted(((r["k"], r["m"]) for r in got), key=str) == [(1, {"b": 2}), (None, {"a": 1}), (None, {"a": 2}), (None, {"a": 2})]
