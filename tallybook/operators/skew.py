"""Joins and row numbering that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.text import field, quoted
from tallybook.sources.files import scratch_folder

# At most this many keys are treated as hot, so what is broadcast for them is bounded by it.
HOT_KEYS = 4096
# Counters of the frequent-items sketch: every key with over about N/50000 rows is found.
TRACKED_KEYS = 65536
# A key below this many rows fits one task and is not worth special treatment.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys with very many rows, and whether rows without key are that many."""

    hashes: tuple[int, ...] = ()
    nulls: bool = False

    def __bool__(self) -> bool:
        return bool(self.hashes) or self.nulls


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[field(k) for k in keys])


def _no_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [field(k).isNull() for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> HotKeys:
    """Keys with ``hot_rows`` rows or more, by one job over the key columns alone.

    A frequent-items sketch is merged from one small buffer per task, so nothing is shuffled by key
    and at most ``HOT_KEYS`` numbers reach the driver.  The sketch only decides which path a row
    takes; results are exact whatever it says.
    """
    hashes = df.select(F.when(~_no_key(keys), key_hash(keys)).alias("h"))
    top = f"approx_top_k(h, {HOT_KEYS}, {TRACKED_KEYS}) FILTER (WHERE h IS NOT NULL)"
    found = hashes.agg(F.expr(top).alias("top"), F.count_if(F.col("h").isNull()).alias("nulls")).first()
    hot = tuple(t["item"] for t in found["top"] or () if t["count"] >= hot_rows)
    return HotKeys(hot, found["nulls"] >= hot_rows)


def own_partitioning(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Columns to group by when the result meets a larger table on ``keys``: the keys and a hash of them.

    A result dealt out by the keys alone would be joined where it lies, and Spark splits a hot key of the other
    side only where both sides are shuffled for the join.
    """
    return [*[field(k) for k in keys], key_hash(keys).alias("__dealt")]


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, for a lookup."""
    return df.select(*own_partitioning(df, keys)).distinct().drop("__dealt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, which holds each key at most once (key columns share names).

    This is an ordinary join, in which Spark splits hot keys of ``left`` as it runs, unless the caller asks for more:
    with ``hot_rows`` one job looks for keys of that many rows (``hot`` gives them when known), and their rows are
    not shuffled: the right rows they need, one per hot key, are broadcast.  Very many rows without key take that path
    too.  Keys are always compared as the ordinary join compares them, whatever their types.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported lookup kind {how!r}")
    keys = list(keys)
    if hot is None and hot_rows is not None:
        hot = hot_keys(left, keys, hot_rows)
    if not hot:
        return left.join(right, keys, how)
    is_hot = key_hash(keys).isin(list(hot.hashes)) if hot.hashes else F.lit(False)
    aside = is_hot | _no_key(keys) if hot.nulls else is_hot
    wanted = left.where(is_hot).select(*[field(k) for k in keys]).distinct()  # at most HOT_KEYS rows
    few = F.broadcast(right.join(F.broadcast(wanted), keys, "left_semi"))
    return left.where(~aside).join(right, keys, how).unionByName(left.where(aside).join(few, keys, how))


_PLACE, _PART = "__place", "__part"
_PART_BITS = 33
"""``monotonically_increasing_id`` counts the rows of a partition in its lower 33 bits; above them stands the partition."""


def numbered_copies(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None, path: str | None = None
) -> DataFrame:
    """Add ``copies`` (rows sharing the keys) and ``copy_number`` (1, 2, ... in ``order``), both long.

    One global sort: rows are range partitioned by (keys, order), so a key with very many rows lies in order over as many
    partitions as it fills, whatever its values look like.  The sorted rows are written once, to ``path`` or a scratch folder, each
    with its place in its partition.  A row's number is its distance from its key's first row in the partition plus the
    key's rows in the partitions before: prefix sums over one row per partition and key.  Nothing depends on estimates or on
    lists of frequent keys (``hot_rows`` is accepted for older callers and not needed), and no key is gathered in one task.
    ``order`` must identify a row within its key.
    """
    keys, order = list(keys), list(order)
    by = [field(c) for c in [*keys, *order]]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PLACE, F.monotonically_increasing_id())
    stored = path or scratch_folder(df.sparkSession, "numbered")
    ordered.write.parquet(stored)
    placed = df.sparkSession.read.schema(ordered.schema).parquet(stored).withColumn(_PART, F.shiftright(_PLACE, _PART_BITS))
    sizes = placed.groupBy(*[field(k) for k in keys], _PART).agg(F.count(F.lit(1)).alias("__n"), F.min(_PLACE).alias("__first"))
    per_key = Window.partitionBy(*[field(k) for k in keys])
    before = per_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[field(k) for k in keys],
        _PART,
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
        F.sum("__n").over(per_key).alias("copies"),
    )
    joined = placed.alias("l").join(shifts.alias("r"), _same_keys("l", "r", keys) & (F.col(f"l.{_PART}") == F.col(f"r.{_PART}")))
    return joined.select(
        *[F.col(f"l.{quoted(c)}") for c in df.columns],
        F.col("r.copies").alias("copies"),
        (F.col(f"l.{_PLACE}") + F.col("r.__shift")).alias("copy_number"),
    )


def _same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    tests = [F.col(f"{a}.{quoted(k)}").eqNullSafe(F.col(f"{b}.{quoted(k)}")) for k in keys]
    return reduce(lambda x, y: x & y, tests)
