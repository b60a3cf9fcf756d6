"""Tables in buckets: upserts equal those of plain tables and do not shuffle the stored rows."""

import pytest
from pyspark.sql import functions as F

from tallybook.operators.stored import open_stored, store
from tallybook.operators.tables import upsert
from tests.conftest import rows

KINDS = "id long, value double, at int"


@pytest.fixture
def first(spark):
    return spark.createDataFrame([(i, float(i), 0) for i in range(40)] + [(None, 1.0, 0), (None, 1.0, 0)], KINDS)


@pytest.mark.parametrize("buckets", [None, 3, 9])
def test_upserts_equal_plain_ones(spark, tmp_path, first, buckets):
    more = spark.createDataFrame(
        [(1, 10.0, 2, "b"), (1, 9.0, 1, "a"), (50, None, 1, None), (None, 7.0, 1, "c"), (None, 7.0, 1, "c")], f"{KINDS}, note string"
    )
    last = spark.createDataFrame([(1, 3), (2, 5)], "id long, value int")
    root = f"{tmp_path}/t"
    stored = store(first, root, "id", buckets)
    assert rows(stored.table()) == rows(first)
    second = stored.upsert(more, ["at"], insert_only=["at"])
    plain = upsert(first, more, "id", ["at"], insert_only=["at"])
    assert rows(second.table()) == rows(plain.select(second.table().columns))
    third = second.upsert(last)
    assert rows(third.table()) == rows(upsert(plain, last, "id").select(third.table().columns))
    assert third.schema["value"].dataType.simpleString() == "double"
    assert open_stored(spark, root) == third and open_stored(spark, root, 1) == second
    assert rows(open_stored(spark, root, 0).table()) == rows(first)
    assert third.table().where("note = 'b'").count() == 1


def test_a_new_session_finds_the_table(spark, tmp_path, first):
    store(first, f"{tmp_path}/t", "id")
    other = spark.newSession()
    for name in [t.name for t in other.catalog.listTables() if t.name.startswith("stored_")]:
        other.sql(f"DROP TABLE {name}")  # as if no session had known it
    found = open_stored(other, f"{tmp_path}/t")
    assert rows(found.table()) == rows(first)
    assert open_stored(other, f"{tmp_path}/nothing") is None


@pytest.mark.parametrize("buckets, exchanges", [(4, 1), (6, 2)])
def test_stored_rows_are_not_shuffled(spark, tmp_path, first, buckets, exchanges):
    stored = store(first, f"{tmp_path}/t", "id", buckets)
    incoming = spark.range(100).select((F.col("id") * 7 % 90).alias("id"), F.rand(1).alias("value"))
    plan = stored.merged(incoming.groupBy("id").agg(F.max("value").alias("value")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == exchanges and "Bucketed: true" in plan


def test_no_rows_and_odd_names(spark, tmp_path):
    empty = spark.createDataFrame([], "`the key` string, `a.b` timestamp_ntz")
    stored = store(empty, f"{tmp_path}/t", "the key")
    assert stored.table().count() == 0
    later = stored.upsert(spark.createDataFrame([("x", None), (None, None)], empty.schema))
    assert later.table().count() == 2 and later.keyless().count() == 1
    assert later.upsert(empty).table().count() == 2
