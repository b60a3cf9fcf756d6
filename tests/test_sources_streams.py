import datetime as dt
import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from catalog import landing
from tallybook.config import CollectionConfig, ReportDefinition
from tallybook.operators.quality import valid_range
from tallybook.plans.collection import UNIQUE_ID, process_collection
from tallybook.plans.load import load_file
from tallybook.plans.match import match_sources
from tallybook.plans.report import report_columns
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
    detect_date_columns,
    header_gate,
    normalize_headers,
)
from tallybook.streaming.streams import (
    ONCE,
    ChangeTable,
    file_source,
    kafka_options,
    run_stream,
    split_part,
    stream_quarantine,
    stream_report,
    stream_split,
    stream_upsert,
    upserted,
)
from tallybook.plans.source import SourceConfig, load_source
from tallybook.sources.splits import counted, write_split
from tests.conftest import rows

CSV = 'Order ID,Amount $,Note\n1,"1,000.5","two\nlines ""quoted"""\n2,,\n'


@pytest.fixture()
def landed(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text(CSV, encoding="utf-8")
    (path / "b.tsv").write_text("x\ty\n1\t2\n")
    (path / "c.json").write_text('{"x": 1}\n{"x": 2, "y": "z"}\n')
    (path / "d.xml").write_text("<rows><row><x>1</x></row><row><x>2</x></row></rows>")
    (path / "e.exe").write_text("no data")
    (path / "head.csv").write_text("a,b\n")
    return path


def test_readers(spark, landed, tmp_path):
    df = normalize_headers(read_delimited(spark, f"{landed}/a.csv", multiline=True))
    assert df.columns == ["order_id", "amount_dollar", "note"]
    assert rows(df, "order_id")[0] == {"order_id": "1", "amount_dollar": "1,000.5", "note": 'two\nlines "quoted"'}
    assert read_any(spark, f"{landed}/b.tsv").first().asDict() == {"x": "1", "y": "2"}
    assert read_any(spark, f"{landed}/c.json").count() == 2
    assert read_any(spark, f"{landed}/d.xml").count() == 2
    with pytest.raises(ValueError):
        read_any(spark, f"{landed}/e.exe")
    typed = read_inferred(spark, f"{landed}/b.tsv", delimiter="\t")
    assert dict(typed.dtypes) == {"x": "int", "y": "int", "_corrupt": "string"}
    plain = read_inferred(spark, f"{landed}/b.tsv", delimiter="\t", infer=False, malformed=None)
    assert dict(plain.dtypes) == {"x": "string", "y": "string"}
    write_summary(typed, f"{tmp_path}/out.json")
    assert read_any(spark, f"{tmp_path}/out.json").count() == 1
    with pytest.raises(ValueError):
        write_summary(typed, f"{tmp_path}/out", "xlsx")


def test_no_cell_is_lost(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3,4,5\n6\n7,x\n")
    got = {r["a"]: r["_corrupt"] for r in read_delimited(spark, f"{tmp_path}/ragged.csv", malformed="_corrupt").collect()}
    assert got == {"1": None, "3": "3,4,5", "6": "6", "7": None}
    (tmp_path / "mixed.csv").write_text("n\n" + "".join(f"{k}\n" for k in range(2000)) + "word\n")
    whole = read_inferred(spark, f"{tmp_path}/mixed.csv")
    assert dict(whole.dtypes)["n"] == "string" and whole.where("n = 'word'").count() == 1
    typed = read_delimited(spark, f"{tmp_path}/mixed.csv", schema="n int", malformed="_corrupt")
    assert [r["_corrupt"] for r in typed.where("n is null").collect()] == ["word"]


def test_manifest(spark, landed):
    found = {r["file_name"]: r for r in landing_manifest(spark, str(landed), ["*.csv", "*.exe", "a*"]).collect()}
    assert set(found) == {"a.csv", "head.csv"}
    assert found["a.csv"]["file_size"] == os.path.getsize(landed / "a.csv") and found["a.csv"]["accepted"]
    small = landing_manifest(spark, str(landed), ["*.csv"], max_mb=20 / 2**20).collect()
    assert {r["file_name"]: r["accepted"] for r in small} == {"a.csv": False, "head.csv": True}


def test_landing_checks(spark, landed, tmp_path):
    assert classify_landing(read_delimited(spark, f"{landed}/a.csv")) == "has_rows"
    assert classify_landing(read_delimited(spark, f"{landed}/head.csv")) == "header_only"
    assert classify_landing(spark.createDataFrame([], "")) == "empty"
    df = spark.createDataFrame([(1,)], "a int")
    assert header_gate(df, ["a"]) is df
    for other in ([], None, ["b"]):
        with pytest.raises(HeadersNotRegistered):
            header_gate(df, other)
    for _ in range(2):
        append_raw(df, f"{tmp_path}/raw")
    stored = spark.read.parquet(f"{tmp_path}/raw")
    assert stored.columns == ["a", "created_at", "updated_at"] and stored.count() == 2
    merged = append_evolving(spark.createDataFrame([(2, "x")], "a int, b string"), f"{tmp_path}/raw")
    assert set(merged.columns) == {"a", "b", "created_at", "updated_at"} and merged.count() == 3


def test_date_detection(spark):
    days = [("2024-01-%02d" % d, "x", "1/2/2024 3:04" if d < 9 else "later", "nan") for d in range(1, 11)]
    df = spark.createDataFrame(days, "a string, created string, b string, c string")
    assert detect_date_columns(df) == ["a", "created", "b"]
    mostly = df.withColumn("b", F.when(F.col("b") != "later", F.lit("no")).otherwise(F.col("b")))
    assert detect_date_columns(mostly) == ["a", "created"]


def test_scratch_folder(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_appending_under_a_known_schema(spark, tmp_path):
    first = append_evolving(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/t")
    second = append_evolving(spark.createDataFrame([("x", 2)], "b string, a int"), f"{tmp_path}/t", first.schema)
    assert second.columns == ["a", "b"] and rows(second, "a") == rows(append_evolving(second.limit(0), f"{tmp_path}/t").select("a", "b"), "a")
    with pytest.raises(ValueError, match="another type"):
        append_evolving(spark.createDataFrame([("x",)], "a string"), f"{tmp_path}/t", second.schema)
    assert spark.read.schema(second.schema).parquet(f"{tmp_path}/t").count() == 2


def test_load_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Ref,Amt,Day,Note\n1,10.5,2024-01-02, a \n,,,\nx,7,bad,\n")
    names, types = {"Ref": "ref", "Amt": "amount", "Day": "day"}, {"ref": "int", "amount": "decimal", "day": "date"}
    loaded = load_file(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", names, types)
    got = rows(loaded.table.drop("_processing_timestamp"), "amount")
    assert [(r["ref"], str(r["amount"]), r["day"], r["Note"], r["_data_quality_score"]) for r in got] == [
        (1, "10.50", dt.date(2024, 1, 2), "a", 1.0), (None, "7.00", None, None, 0.25),
    ]
    assert {r["column_name"]: r["non_null_count"] for r in loaded.profile.collect()} == {
        "ref": 1, "amount": 2, "day": 1, "Note": 1,
    }
    assert loaded.quality.first()[0] == 0.625


def test_load_file_with_rules(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Ref,Amt,Day,Note\n1,10.5,2024-01-02, a \n,,,\nx,7,bad,\n2,-1,,b\n3,twelve,,\n4,1,2,3,4\n5,2\n")
    names, types = {"Ref": "ref", "Amt": "amount", "Day": "day"}, {"ref": "int", "amount": "decimal", "day": "date"}
    loaded = load_file(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", names, types, rules=[valid_range("amount", 0)])
    assert loaded.counts == {"read": 7, "malformed": 2, "empty": 1, "quarantined": 2, "good": 2, "rescued_cells": 3}
    got = rows(loaded.table.drop("_processing_timestamp"), "amount")
    assert [(r["ref"], r["Note"], r["_data_quality_score"], r["_rescued"]) for r in got] == [
        (1, "a", 1.0, None), (None, None, 0.25, [{"field": "ref", "value": "x"}, {"field": "day", "value": "bad"}]),
    ]
    bad = rows(loaded.quarantined, "ref")
    assert [(r["ref"], r["failed_rules"]) for r in bad] == [(2, ["range_amount"]), (3, ["range_amount"])]
    assert sorted(r[0] for r in loaded.malformed.collect()) == ["4,1,2,3,4", "5,2"]
    again = load_file(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", names, types, rules=[])
    assert again.counts["quarantined"] == 0 and again.table.count() == 6
    assert "_rescued" not in {r["column_name"] for r in again.profile.collect()}


def test_match_sources(spark, tmp_path):
    day = dt.datetime
    trm = spark.createDataFrame([(1, 10.0, day(2024, 1, 1)), (2, 5.0, day(2024, 1, 2)), (3, 1.0, day(2024, 2, 1))], "id int, amt double, day timestamp_ntz")
    other = spark.createDataFrame([(1, 10.0)], "id int, amt double")
    same = dict.fromkeys(("trm", "mpr", "bank"), "id"), dict.fromkeys(("trm", "mpr", "bank"), "amt")
    m = match_sources(trm, other, other, *same, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 31), summary_path=f"{tmp_path}/s")
    assert m.matches.count() == 2 and [r["id"] for r in m.exceptions.collect()] == [2]
    total = spark.read.json(f"{tmp_path}/s").where("exception_type = 'TOTAL'").first()
    assert (total["match_rate"], total["amount_at_risk"]) == (50.0, 5.0)


CONFIG = CollectionConfig(("id", "name", "order_date"), ("id",), ("n",))
RAW = "id string, name string, order_date string, n int"


def raw_batches(spark):
    one = [("1", " a ", "01/02/2024", 1), ("2", "b", "x", 2), (None, "loose", None, 3), ("1", "a2", "15/01/2024", 4)]
    two = [("2", "b2", None, 5), ("3", "c", "2024-01-01", 6), (None, "loose", None, 7)]
    return [spark.createDataFrame(b, RAW) for b in (one, two)]


def test_stream_upsert_equals_batch(spark, tmp_path):
    folder = str(tmp_path)
    existing = None
    for i, batch in enumerate(raw_batches(spark)):
        batch.coalesce(1).write.parquet(f"{folder}/in/b{i}")
        existing = process_collection(batch, existing, CONFIG, stamp=False).processed
        source = file_source(spark, f"{folder}/in/*", RAW, "*.parquet", files_per_batch=1)
        stream_upsert(source, f"{folder}/table", CONFIG, f"{folder}/cp").awaitTermination()
        assert rows(upserted(spark, f"{folder}/table", CONFIG)) == rows(existing.select(*upserted(spark, f"{folder}/table", CONFIG).columns))
    assert existing.count() == 5
    table = ChangeTable(spark, f"{folder}/table", UNIQUE_ID, ["__rank0"])
    before = rows(table.current())
    assert table.compact() == 1 and table.compact() == 1
    assert rows(table.current()) == before


def test_change_table_replay_and_interrupted_compaction(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "k", ["o"])
    with pytest.raises(ValueError):
        table.current()
    first = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), (None, 9, 0)], "k string, v int, o int")
    table.write_batch(first, 0)
    table.write_batch(first, 0)  # replayed
    assert table.current().count() == 3
    table.compact()
    second = spark.createDataFrame([("a", 2, 0), ("a", 3, 1)], "k string, v int, o int")
    table.write_batch(second, 1)
    # a base without log entry does not count
    second.limit(0).write.parquet(str(tmp_path / "t" / "base" / "version=1"))
    got = {r["k"]: r["v"] for r in table.current().collect()}
    assert got == {"a": 3, "b": 1, None: 9}
    assert table.compact() == 1
    assert {r["k"]: r["v"] for r in table.current().collect()} == got


def test_stream_report_and_quarantine_equal_batch(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, v double")
    df.write.parquet(f"{folder}/in")
    definition = ReportDefinition.from_dict({
        "report_name": "r",
        "formulas": [{"logicNameKey": "NET", "formulaText": "s.v * 2"}],
        "mapping_keys": {"s": ["id"]},
        "delta_columns": [{"delta_column_name": "GAP", "value": "NET - 10"}],
        "reasons": [{"reason": "far", "delta_column": "GAP", "threshold": 9, "must_check": True}],
    })
    source = file_source(spark, f"{folder}/in", df.schema, "*.parquet")
    run_stream(
        source, lambda d: stream_report(d, definition), f"{folder}/cp1", f"{folder}/rep", "parquet", ONCE
    ).awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/rep")) == rows(report_columns(df, definition))
    stream_quarantine(
        source, [valid_range("v", 3, 10)], f"{folder}/good", f"{folder}/bad", f"{folder}/cp2"
    ).awaitTermination()
    assert spark.read.parquet(f"{folder}/good").count() == 8
    assert spark.read.parquet(f"{folder}/bad").count() == 12
    stream_split(source, [valid_range("v", 3, 10)], f"{folder}/split", f"{folder}/cp3").awaitTermination()
    good, bad = (split_part(spark, f"{folder}/split", df.schema, v) for v in ("good", "bad"))
    assert rows(good) == rows(spark.read.parquet(f"{folder}/good").select("id", "v"))
    assert bad.count() == 12 and {tuple(r["failed_rules"]) for r in bad.collect()} == {("range_v",)}


def test_kafka_options():
    assert kafka_options("h:9092", "t") == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "latest",
    }


def test_change_table_outlives_its_checkpoint(spark, tmp_path):
    """Batch ids start at 0 again with a new checkpoint; columns may come later; what is folded can be removed."""
    folder = str(tmp_path)
    table = ChangeTable(spark, f"{folder}/table", "k", ["n"])

    def stream(rows_, kinds, turn):
        spark.createDataFrame(rows_, kinds).coalesce(1).write.parquet(f"{folder}/in{turn}")
        source = file_source(spark, f"{folder}/in{turn}", kinds, "*.parquet")
        writer = source.writeStream.foreachBatch(table.write_batch).option("checkpointLocation", f"{folder}/checkpoint{turn}")
        writer.trigger(availableNow=True).start().awaitTermination()

    stream([("a", 1), ("b", 1)], "k string, n int", 0)
    stream([("b", 2), (None, 7)], "k string, n int", 1)
    assert table.compact() == 1 and table.clean() == 2
    stream([("c", 3, "new"), ("a", 3, "x")], "k string, n int, later string", 2)
    got = [(r["k"], r["n"], r["later"]) for r in rows(table.current(), "k")]
    assert got == [(None, 7, None), ("a", 3, "x"), ("b", 2, None), ("c", 3, "new")]
    assert table.compact() == 2 and table.clean() == 2
    assert [(r["k"], r["n"]) for r in rows(table.current(), "k")] == [(None, 7), ("a", 3), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError):
        ChangeTable(spark, f"{folder}/none", "k").current()


def test_source_load(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Ref,Amt ,Day\n1,\"1,200.50\",05-02-2024\n1,7,2024-02-06\n2,bad,2024-02-07\n,3,2024-02-08\n3,4\n4,99999,2024-02-09\n,,\n5,6,soon\n")
    config = SourceConfig.from_dict({
        "mapping": {"Ref": "ref", "Amt": "amount", "Day": "day"}, "types": {"ref": "int", "amount": "decimal", "day": "date"},
        "registered": ["ref", "amt", "day"], "date_format_hints": ["dd-MM-yyyy", "yyyy-MM-dd"],
        "dq_rules": {"valid_range": {"amount": {"max": 50000}}}, "load": {"upsert_key": ["ref"], "order": ["day"]},
    })
    old = spark.sql("SELECT 1 AS ref, CAST(1 AS DECIMAL(18,2)) AS amount, DATE'2020-01-01' AS day")
    found = load_source(spark, f"{tmp_path}/in.csv", config, old, f"{tmp_path}/work")
    counts = rows(found.counts)[0]
    assert counts == {
        "read": 8, "malformed": 1, "empty": 1, "keyless": 1, "quarantined": 2, "duplicates": 0, "superseded": 1, "inserted": 1, "updated": 1, "skipped": 0,
        "rescued_cells": 2,
    }
    assert counts["read"] == sum(n for c, n in counts.items() if c not in ("read", "rescued_cells"))
    assert [(r["ref"], str(r["amount"]), r["day"], r["_rescued"]) for r in rows(found.table, "ref")] == [
        (1, "7.00", dt.date(2024, 2, 6), None), (5, "6.00", None, [{"field": "day", "value": "soon"}]),
    ]
    bad = rows(found.quarantined, "ref")
    assert [r["failed_rules"] for r in bad] == [["range_amount"]] * 2 and [r["_rescued"] for r in bad] == [[{"field": "amount", "value": "bad"}], None]
    assert [r["_malformed"] for r in found.malformed.collect()] == ["3,4"]
    refused = SourceConfig(mapping={}, types={}, upsert_key="ref", registered=("other",))
    with pytest.raises(HeadersNotRegistered):
        load_source(spark, f"{tmp_path}/in.csv", refused, folder=f"{tmp_path}/none")


def test_nothing_of_a_load_is_lost(spark, tmp_path):
    """Payments not paid out yet have no utr: they are no repeats of each other. Two key fields, unreadable cells as a violation."""
    (tmp_path / "in.csv").write_text("ref,part,utr,amount\n1,a,,5\n2,a,,6\n3,a,,7\n4,a,u,8\n4,a,u,8\n4,b,u2,9\n5,a,,twelve\n6,,u3,1\n1,a,,5\n")
    config = SourceConfig.from_dict({
        "types": {"ref": "int", "amount": "decimal"}, "dq_rules": {"readable": ["amount"]},
        "load": {"upsert_key": ["ref", "part"], "dedupe_keys": ["utr"]},
    })
    old = spark.sql("SELECT 4 AS ref, 'a' AS part, 'u' AS utr, CAST(8 AS DECIMAL(18,2)) AS amount UNION ALL SELECT 4, 'c', 'w', 1")
    found = load_source(spark, f"{tmp_path}/in.csv", config, old, f"{tmp_path}/work")
    assert [(r["ref"], r["part"], int(r["amount"])) for r in rows(found.table, "ref", "part")] == [
        (1, "a", 5), (2, "a", 6), (3, "a", 7), (4, "a", 8), (4, "b", 9), (4, "c", 1),
    ]
    assert [(r["ref"], r["failed_rules"], r["_rescued"][0]["value"]) for r in rows(found.quarantined)] == [(5, ["readable_amount"], "twelve")]
    counts = rows(found.counts)[0]
    assert counts["read"] == 9 == sum(n for c, n in counts.items() if c not in ("read", "rescued_cells"))
    assert (counts["duplicates"] + counts["superseded"], counts["keyless"], counts["inserted"], counts["skipped"]) == (2, 1, 4, 1)
    empty = load_source(spark, f"{tmp_path}/in.csv", SourceConfig.from_dict({"types": {"ref": "date"}, "load": {"upsert_key": "ref"}}), folder=f"{tmp_path}/none")
    assert empty.table.count() == 0 and rows(empty.counts)[0]["keyless"] == 9


def test_split_is_written_in_one_pass(spark, tmp_path):
    numbers = spark.range(100).withColumn("part", F.when(F.col("id") % 3 == 0, "low").otherwise("high"))
    split = write_split(numbers, f"{tmp_path}/split", "part", **counted("part", "low", "high", "none"), total=F.sum("id"))
    assert split.figures == {"low": 34, "high": 66, "none": 0, "total": 4950}
    assert split.part("low").count() == 34 and split.part("none").count() == 0 and split.part("low").columns == ["id"]
    plan = split.part("high")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    nothing = write_split(numbers.where("id < 0"), f"{tmp_path}/nothing", "part", **counted("part", "low"))
    assert nothing.figures == {"low": 0} and nothing.part("low").count() == 0


def test_records_with_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    """Cells with quotes, separators and line breaks over the ends of splits: the rows of the plain multi-line reader."""
    rng = random.Random(1)

    def cell():
        text = "".join(rng.choice(["a", "b", " ", ",", '"', "\n", "\n\n", "é"]) for _ in range(rng.randint(0, 12)))
        return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n') or rng.random() < 0.3 else text

    (tmp_path / "in").mkdir()
    for f in range(2):
        body = "".join(f"{k},{cell()},{cell()}\n" for k in range(500))
        (tmp_path / "in" / f"f{f}.csv").write_text(f'k,"odd name",t\n{body}7,short\n\n"8","{"long, " * 900}\n","last"\n')
    (tmp_path / "in" / "empty.csv").write_text('k,"odd name",t\n')
    path, size = f"{tmp_path}/in", "spark.sql.files.maxPartitionBytes"
    want = rows(read_delimited(spark, path, multiline=True, malformed="_bad"))
    spark.conf.set(size, "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert rows(read_split_records(spark, path, malformed="_bad")) == want
        assert len(want) == 1004 and sum(r["_bad"] is not None for r in want) == 2
        typed = read_split_records(spark, path, schema="k int, n string, t string")
        assert typed.where("k = 8").count() == 4 and typed.columns == ["k", "n", "t"]
    finally:
        spark.conf.unset(size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    config = SourceConfig.from_dict({"types": {"k": "int"}, "load": {"upsert_key": "k"}, "multiline": "split"})
    counts = rows(load_source(spark, path, config, folder=f"{tmp_path}/work").counts)[0]
    assert (counts["read"], counts["malformed"]) == (1004, 2) and counts["inserted"] == 500


def _documents(spark, folder, n):
    """A table of documents with breaks, quotes, commas and gaps, and the rows expected of it."""
    texts = [None if k % 50 == 7 else ('x "y", \n' * (k % 40)) + f"end {k}" for k in range(n)]
    data = [(k, "en" if k % 2 else "de", f"s{k % 3}", t) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_split_records_land_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A larger table gives more files, not larger ones, so no writing task reads half of it."""
    _documents(spark, tmp_path, 600)
    monkeypatch.setattr(landing, "scratch_folder", lambda s, label: f"{tmp_path}/work/{label}")
    monkeypatch.setattr(landing, "FILE_BYTES", 10_000, raising=False)
    found = landing.csv_split_records(spark, str(tmp_path))
    assert found.count() == 600 and found.where("md5 is null").count() == 12
    parts = list((tmp_path / "work" / "records" / "in").glob("part-*.csv"))
    assert len(parts) > 8 and max(p.stat().st_size for p in parts) < 30_000


def test_texts_with_breaks_land_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """The multi-line reader keeps a file in one task: a larger table gives more files, not larger ones."""
    _documents(spark, tmp_path, 600)
    monkeypatch.setattr(landing, "scratch_folder", lambda s, label: f"{tmp_path}/work/{label}")
    monkeypatch.setattr(landing, "FILE_BYTES", 10_000, raising=False)
    found = landing.csv_roundtrip(spark, str(tmp_path))
    assert found.count() == 600 and found.where("text_hash is null").count() == 12
    parts = list((tmp_path / "work" / "csv" / "landed.csv").glob("part-*.csv"))
    assert len(parts) > 8 and max(p.stat().st_size for p in parts) < 30_000


def test_rows_are_not_sorted_by_verdict_before_they_are_written(spark, tmp_path, monkeypatch):
    """Each task holds a file per verdict open while it writes; the session's own settings stay as they were, also after an error."""
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    write = DataFrameWriter.parquet

    def watched(self, *args, **kwargs):
        seen.append(spark.conf.get(name, None))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    numbers = spark.range(1000).withColumn("part", F.concat(F.lit("p"), F.col("id") % 20))
    parts = write_split(numbers, f"{tmp_path}/split", "part", **counted("part", "p3"))
    assert rows(parts.part("p3")) == [{"id": k} for k in sorted(range(3, 1000, 20), key=str)] and parts.figures == {"p3": 50}
    assert int(seen[0]) > 1 and spark.conf.get(name, None) is None
    with pytest.raises(Exception, match="already exists"):
        write_split(numbers, f"{tmp_path}/split", "part")
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "3")
    try:
        write_split(numbers, f"{tmp_path}/own", "part")
        assert seen[-1] == "3" and spark.conf.get(name) == "3"
    finally:
        spark.conf.unset(name)
