"""The corpus pipeline: stages that each work on all that the stage before kept, written as Parquet in between.

1. ``quality``: documents that the classifier scores below 0.7 go.
2. ``near_dedup``: of each group of near copies the document with the smallest id stays.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secrets``: values of secrets that few owners (sources) or few repositories (languages) hold are masked; documents stay.
5. ``pack``: documents become sequences of at most 2048 tokens.

All but the last return the columns they get. Rows are judged by themselves, so repeated ids, null ids and null texts are
handled as each operator says; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import keep, table
from tallybook.llm.decontam import leaks
from tallybook.llm.neardup import near_duplicates
from tallybook.llm.packing import pack
from tallybook.llm.quality import THRESHOLD, scored, train
from tallybook.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), "doc_id", "text")
    judged = scored(docs, model, "text", "__score")
    return (judged if model is None else judged.where(F.col("__score") >= THRESHOLD)).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without id stay; so do rows that share an id with a kept one and have another text."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    one = docs.join(keep(kept, "kept"), docs["doc_id"] == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.md5(docs["text"].cast("binary")) == F.col("__md5"))
    return docs.join(keep(found, "leaks"), same, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs, docs["lang"], docs["source"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", packing),
]

ORACLE_SQL: str | None = None
"""None: a learned classifier cannot be said in SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
