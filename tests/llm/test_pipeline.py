import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm.common import keep
from tests.llm.conftest import SCHEMA, messy_rows

SECRET = "q7Zr9LmK2xWv4TbN"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(7)
    words = [f"{a}{b}" for a in ("ba", "de", "lo", "mi", "ra", "tu") for b in ("n", "st", "ve", "lla", "rk", "s")]
    good = lambda n=90: " ".join(random.choice(words) + random.choice(["", "", "", ",", "."]) for _ in range(n))
    item = good(40)
    texts = {k: good() if k % 6 else good().replace(" ", "%%% ") for k in range(600)}
    texts |= {601: texts[7], 602: texts[7] + " ending", 603: good() + " " + item + " " + good(), 604: f"{good()} token={SECRET} {good()}"}
    rows = [(k, t, "en", f"src{k % 4}", len(t), "d", "b", None) for k, t in texts.items()] + [(None, good(), None, None, 1, None, None, None), (604, texts[604], "en", "src0", 1, "d", "b", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(0, 600)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_take_effect(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, folder), name)
        assert out.dtypes == docs.dtypes
        docs = out
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {k for k in texts if k % 6 or k > 600}
    assert len(ids["quality"] & clean) >= 0.98 * len(clean) and len(ids["quality"] - clean) <= 5
    assert ids["near_dedup"] == ids["quality"] - {601, 602}
    assert ids["decontaminate"] == ids["near_dedup"] - {603}
    assert ids["secrets"] == ids["decontaminate"]
    row = docs.where("doc_id = 604").collect()
    assert len(row) == 1 and row[0].text == texts[604].replace(SECRET, "<secret>") and row[0].n_chars == len(row[0].text)
    assert docs.where(F.col("doc_id").isNull()).count() == 1
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == ids["secrets"]
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_odd_rows_and_no_rows(spark, corpus, messy, nothing):
    folder = corpus[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
        assert stage(spark, messy, folder).count() > 0
    kept = corpus_pipeline.near_dedup(spark, messy, folder).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 1 for r in kept) == 1 and {r.doc_id for r in kept} >= {5, 6, 7, 8, 12}
    assert corpus_pipeline.secrets(spark, messy, folder).count() == len(messy_rows())
