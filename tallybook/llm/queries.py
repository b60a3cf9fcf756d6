"""The queries of this subpackage, one per operator; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import table
from tallybook.llm.decontam import leaks
from tallybook.llm.language import identify_languages
from tallybook.llm.neardup import near_duplicates
from tallybook.llm.oracles import ORACLES
from tallybook.llm.packing import pack
from tallybook.llm.pagetext import main_texts
from tallybook.llm.quality import quality_scores
from tallybook.llm.repeats import remove_repeats
from tallybook.llm.secrets import secrets
from tallybook.llm.spelling import corpus_words, spelling_variants
from tallybook.llm.tokenfile import read_tokens, write_tokens
from tallybook.llm.topk import top_k
from tallybook.llm.trie import prefix_trie, sequences, with_shared_heads
from tallybook.llm.urlfilter import url_verdicts
from tallybook.sources.files import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLES", "QUERIES"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of every document."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stay when repeated 20-word windows go."""
    return remove_repeats(table(spark, folder, "documents"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold, one row per document and item."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written as Re-Pair shards and decoded again."""
    path = scratch_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path)
    return read_tokens(spark, path)


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack(table(spark, folder, "documents"))


@query
def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document; a source is an owner, a language, which many sources share, is a repository."""
    return secrets(table(spark, folder, "documents"), F.col("lang"), F.col("source"))


@query
def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, folder, "pages"))


@query
def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_verdicts(table(spark, folder, "pages"))


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Near words and common form of every word of the documents."""
    return spelling_variants(corpus_words(table(spark, folder, "documents")))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie over the conversations, rebuilt so that families share their first turns."""
    return prefix_trie(with_shared_heads(sequences(table(spark, folder, "conversations"))))


@query
def op13_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return identify_languages(table(spark, folder, "documents"))
