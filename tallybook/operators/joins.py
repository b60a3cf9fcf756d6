"""Joins between sources: by key, by key with an order-id fallback, and chain matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.keys import key_head
from tallybook.functions.text import field, quoted
from tallybook.operators.skew import HotKeys, distinct_keys, hot_keys, lookup_join, own_partitioning
from tallybook.operators.tables import latest_per_key
from tallybook.sources.files import scratch_folder
from tallybook.sources.splits import written

_ID = "__order_id"
_KEY = "__merge_key"


def merge_on_key(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two keyed frames with shared key names and otherwise distinct columns.

    Each side holds a key once, so the join is one to one and cannot be skewed.
    """
    return primary.join(secondary, list(keys), "full_outer")


def keys_present(
    df: DataFrame, known: DataFrame, keys: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Rows of ``df`` whose keys exist in ``known``."""
    return lookup_join(df, distinct_keys(known, keys), keys, "left_semi", hot_rows)


def unmatched(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot_rows: int | None = None,
    labels: tuple[str, str] = ("left_only", "right_only"),
) -> DataFrame:
    """Rows found on one side only, with their ``side``; columns may differ between the sides."""
    only_left = lookup_join(left, distinct_keys(right, keys), keys, "left_anti", hot_rows)
    only_right = lookup_join(right, distinct_keys(left, keys), keys, "left_anti", hot_rows)
    return only_left.withColumn("side", F.lit(labels[0])).unionByName(
        only_right.withColumn("side", F.lit(labels[1])), allowMissingColumns=True
    )


def resolve_fallback(
    primary_keys: DataFrame,
    secondary: DataFrame,
    key: str,
    order_id: Column | None = None,
    order: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``__merge_key`` to secondary rows: the primary key they belong to.

    A row whose own key exists keeps it.  Any other row is retried by order id (``order_id``, else
    the head of its key) against primary rows that no secondary row matched; of several primary
    rows with one order id the smallest key is taken, and of several secondary rows claiming the same
    primary row the last by ``order`` is kept.  Rows that find nothing keep their own key.

    ``primary_keys`` and ``secondary`` hold each key once.  Keys are resolved apart from the rows: one join of the bare keys of both
    sides, of which only what found no partner is written, and a table (secondary key, primary key) of the rows that the
    order id rescues.  Both are narrow and lie in scratch folders, so each wide row is read once and meets the small table once.
    """
    spark = secondary.sparkSession
    head = key_head(field(key))
    by_id = F.coalesce(order_id, head) if order_id is not None else head
    ours = primary_keys.select(field(key), F.lit(True).alias("__ours"))
    theirs = secondary.select(field(key), by_id.alias(_ID), F.lit(True).alias("__theirs"))
    alone = ours.join(theirs, key, "full_outer").where(F.col("__ours").isNull() | F.col("__theirs").isNull())
    alone = written(alone, scratch_folder(spark, "unmatched") + "/keys")[0]
    free = alone.where("__ours").select(head.alias(_ID), field(key).alias(_KEY)).where(F.col(_ID).isNotNull())
    free = free.groupBy(*own_partitioning(free, [_ID])).agg(F.min(_KEY).alias(_KEY)).drop("__dealt")
    retried = alone.where(F.col("__theirs") & F.col(_ID).isNotNull()).select(field(key), _ID)
    hot = HotKeys() if hot_rows is None else hot_keys(retried, [_ID], hot_rows)
    found = lookup_join(retried, free, [_ID], "inner", hot=HotKeys(hot.hashes)).select(field(key), _KEY)
    found = written(found, scratch_folder(spark, "resolved") + "/keys")[0]
    resolved = secondary.join(found, key, "left").withColumn(_KEY, F.coalesce(_KEY, field(key)))
    # All rows claiming one primary row shrink to one per task here, before the shuffle that the
    # merge needs anyway.
    return latest_per_key(resolved, [_KEY], order)


def merge_with_fallback(
    primary: DataFrame,
    secondary: DataFrame,
    key: str,
    order_id: Column | None = None,
    order: Sequence[str] = (),
    hot_rows: int | None = None,
    secondary_key: str = "secondary_key",
) -> DataFrame:
    """``merge_on_key`` after the order-id fallback; the row's own key stays as ``secondary_key``."""
    resolved = resolve_fallback(primary, secondary, key, order_id, order, hot_rows)
    renamed = resolved.withColumnsRenamed({key: secondary_key, _KEY: key})
    return merge_on_key(primary, renamed, [key])


# Levels of a three-way match.
FULL_CHAIN = "FULL_CHAIN"
AMOUNT_MISMATCH = "AMOUNT_MISMATCH"
MISSING_BANK = "MISSING_BANK"
MISSING_MPR = "MISSING_MPR"
MISSING_TRM = "MISSING_TRM"


def _totals(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Amount and row count per key, combined in each task before the shuffle."""
    keyed = df.where(field(key).isNotNull())
    sums = keyed.groupBy(*own_partitioning(keyed, [key])).agg(
        F.sum(field(amount)).alias(f"{name}_amount"), F.count(F.lit(1)).alias(f"{name}_rows")
    )
    return sums.drop("__dealt")


def chain_match(
    trm: DataFrame,
    mpr: DataFrame,
    bank: DataFrame,
    keys: Mapping[str, str],
    amounts: Mapping[str, str],
    tolerance: float = 0.0,
    hot_rows: int | None = None,
    orphans: bool = False,
    claims: DataFrame | None = None,
) -> DataFrame:
    """Match transactions to processor and bank rows; adds their amounts and the ``level``.

    ``keys`` and ``amounts`` name the columns of ``trm``, ``mpr`` and ``bank``.  Processor and bank
    rows are summed per key first, so each transaction stays one row.  A transaction without
    processor row is ``MISSING_MPR`` whatever the bank says.  ``orphans`` adds one ``MISSING_TRM`` row for
    each key of processor or bank that no transaction has; ``claims`` may hold more transactions to look in.
    """
    key = keys["trm"]
    processor = _totals(mpr, keys["mpr"], amounts["mpr"], "mpr").withColumnRenamed(keys["mpr"], key)
    statement = _totals(bank, keys["bank"], amounts["bank"], "bank").withColumnRenamed(keys["bank"], key)
    # Both totals are one row per key, so they are put together first and the transactions, the
    # largest table, are joined once.
    chain = processor.join(statement, key, "full_outer")
    matched = lookup_join(trm, chain, [key], "left", hot_rows)
    claimed = field(amounts["trm"])
    close = (F.abs(claimed - F.col("mpr_amount")) <= tolerance) & (
        F.abs(claimed - F.col("bank_amount")) <= tolerance
    )
    level = (
        F.when(F.col("mpr_rows").isNull(), MISSING_MPR)
        .when(F.col("bank_rows").isNull(), MISSING_BANK)
        .when(close, FULL_CHAIN)
        .otherwise(AMOUNT_MISMATCH)
    )
    levels = matched.withColumn("level", level).drop("mpr_rows", "bank_rows")
    if not orphans:
        return levels
    claimed_keys = distinct_keys(trm if claims is None else claims, [key])
    alone = chain.join(claimed_keys, key, "left_anti").withColumn("level", F.lit(MISSING_TRM)).drop("mpr_rows", "bank_rows")
    return levels.unionByName(alone, allowMissingColumns=True)


def settlement_match(
    payments: DataFrame,
    statements: DataFrame,
    key: str,
    amount: str,
    statement_amount: str,
    tolerance: float,
    hot_rows: int | None = None,
) -> DataFrame:
    """Payments against bank statements: variance and whether it is within the tolerance."""
    totals = _totals(statements, key, statement_amount, "statement")
    matched = lookup_join(payments, totals, [key], "left", hot_rows)
    variance = field(amount) - F.col("statement_amount")
    status = (
        F.when(F.col("statement_rows").isNull(), "UNSETTLED")
        .when(F.abs(variance) <= tolerance, "SETTLED")
        .otherwise("VARIANCE")
    )
    labelled = matched.withColumns({"variance": variance, "settlement_status": status})
    return labelled.drop("statement_rows")
