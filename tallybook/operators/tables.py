"""Keyed tables: last write per key, upsert, change labels, archive, status, combining sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import field, quoted
from tallybook.operators.skew import distinct_keys, hot_keys, lookup_join, numbered_copies
from tallybook.sources.files import scratch_folder
from tallybook.sources.splits import counted, write_split

# Stamps that do not count as a change.
STAMPS = ("processed_at", "updated_at", "created_at")

_PRESENT, _DEALT = "__present", "__dealt"


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def last_row(kinds: Mapping[str, T.DataType], columns: Sequence[str], order: Sequence[str] = (), among: Column | None = None) -> Column:
    """Aggregate: the columns of the last row by ``order`` as a struct, ties broken by the other columns; only rows ``among`` count."""
    only = (lambda c: c) if among is None else (lambda c: F.when(among, c))
    first = [o for o in order if o in columns]
    complete = first + [c for c in columns if c not in first and _orderable(kinds[c])]
    if len(complete) == len(columns):
        return F.max(only(F.struct(*[field(c) for c in complete])))
    # what cannot be ordered decides ties by its printed form, so that no run differs
    printed = [F.to_json(F.struct(field(c))) for c in columns if not _orderable(kinds[c])]
    return F.max_by(F.struct(*[field(c) for c in columns]), only(F.struct(*[field(c) for c in complete], *printed)))


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), copies: str | None = None, weight: str | None = None
) -> DataFrame:
    """One row per key: the last by ``order``, ties broken by the other columns.

    ``copies`` adds the number of rows the key had; where rows stand for several already, ``weight`` is the column that says so.

    Written as a ``max`` of a struct rather than a window: each task keeps one row per key before
    the shuffle, so a key that holds a third of the table sends one row per task.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in df.columns if c != weight]
    rest = [c for c in wanted if c not in keys]
    counts = [(F.sum(field(weight)) if weight else F.count(F.lit(1))).alias(copies)] if copies else []
    shown = [field(copies)] if copies else []
    if not rest:
        return df.groupBy(*[field(c) for c in wanted]).agg(*counts) if counts else df.distinct()
    if len(rest) == 1 and isinstance(kinds[rest[0]], (T.NumericType, T.DatetimeType)):
        # a single fixed-width value needs no struct, so this aggregates by hash
        return df.groupBy(*[field(k) for k in keys]).agg(F.max(field(rest[0])).alias(rest[0]), *counts).select(
            *[field(c) for c in wanted], *shown
        )
    best = last_row(kinds, rest, order)
    grouped = df.groupBy(*[field(k) for k in keys]).agg(best.alias("__row"), *counts)
    return grouped.select(
        *[field(c) if c in keys else F.col(f"__row.{quoted(c)}").alias(c) for c in wanted], *shown
    )


def without_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), times: str = "times") -> DataFrame:
    """The last row of each key; a row with a null in a key is no repeat of anything and passes.

    Such rows are dealt out by two hashes of all they hold, so that they spread over all tasks; of equal ones there is one row
    in the result, which says in ``times`` how often it came (1 for rows with a key).
    """
    printable = [field(c) if _orderable(df.schema[c].dataType) else F.to_json(F.struct(field(c))) for c in df.columns]
    whole = reduce(lambda a, b: a & b, [field(k).isNotNull() for k in keys])
    own = {f"__own{i}": F.when(whole, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), *printable)) for i in (1, 2)}
    last = latest_per_key(df.withColumns(own), [*keys, *own], order, copies=times)
    return last.withColumn(times, F.when(whole, F.lit(1).cast("long")).otherwise(field(times))).drop(*own)


def latest_and_keyless(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key and every row without key, from one grouping: equal rows without key are counted and then
    multiplied again."""
    last = without_repeats(df, [key], order, times="__times")
    return last.withColumn("__times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__times")


def duplicate_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Rows that share their keys with another row, with ``copies`` and ``copy_number``."""
    return numbered_copies(df, keys, order, hot_rows).where(F.col("copies") > 1)


def _spread(df: DataFrame, key: str, side: int) -> Column:
    """Second join column: 0 with a key; without one a hash of the row, so that such rows spread over all tasks.

    A null key matches nothing, so rows without key keep to themselves in an outer join.
    """
    printable = [field(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return F.when(field(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(side), *printable))


def _marked(df: DataFrame, key: str, side: int) -> DataFrame:
    return df.withColumns({_PRESENT: F.lit(True), _DEALT: _spread(df, key, side)})


def _same_key(key: str) -> Column:
    return (F.col(f"e.{quoted(key)}") == F.col(f"i.{quoted(key)}")) & (F.col(f"e.{_DEALT}") == F.col(f"i.{_DEALT}"))


def merged_rows(
    existing: DataFrame, incoming: DataFrame, key: str, insert_only: Sequence[str] = (), all_keyed: bool = False
) -> DataFrame:
    """Full outer join of two tables, one row per key; incoming values win where an incoming row exists.

    ``all_keyed`` says that no row lacks its key: the join is then by the key alone, so a table that lies in buckets of it stays there.
    """
    if all_keyed:
        there = {_PRESENT: F.lit(True)}
        sides = existing.withColumns(there).alias("e"), incoming.withColumns(there).alias("i")
        on = F.col(f"e.{quoted(key)}") == F.col(f"i.{quoted(key)}")
    else:
        sides, on = (_marked(existing, key, 1).alias("e"), _marked(incoming, key, 2).alias("i")), _same_key(key)
    both = sides[0].join(sides[1], on, "full_outer")
    arrived = F.col(f"i.{_PRESENT}").isNotNull()
    known = F.col(f"e.{_PRESENT}").isNotNull()
    out: list[Column] = []
    for name in dict.fromkeys([*existing.columns, *incoming.columns]):
        old = F.col(f"e.{quoted(name)}") if name in existing.columns else None
        new = F.col(f"i.{quoted(name)}") if name in incoming.columns else None
        if name == key:
            out.append(F.coalesce(old, new).alias(name))
        elif old is None:
            out.append(new.alias(name))
        elif new is None:
            out.append(old.alias(name))
        elif name in insert_only:
            out.append(F.when(known, old).otherwise(new).alias(name))
        else:
            out.append(F.when(arrived, new).otherwise(old).alias(name))
    return both.select(*out)


def _last_rows(incoming: DataFrame, key: str, order: Sequence[str], unique: bool) -> DataFrame:
    """One row per key, and every row without key."""
    if unique:
        return incoming
    return latest_and_keyless(incoming, key, order)


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: str,
    order: Sequence[str] = (),
    insert_only: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Update rows of ``existing`` by key and insert the new ones.

    Of several incoming rows with one key the last by ``order`` wins.  Columns the update does not
    carry survive.  A row without key is always appended.  ``insert_only`` columns are set only when
    the row is new; ``unique`` says that ``incoming`` holds each key once already.  Both sides hold
    each key once when they meet, so no key is ever hot in the join; rows without key pass it spread by a hash.
    """
    return merged_rows(existing, _last_rows(incoming, key, order, unique), key, insert_only)


def change_labels(
    existing: DataFrame,
    incoming: DataFrame,
    key: str,
    order: Sequence[str] = (),
    ignore: Sequence[str] = STAMPS,
    unique: bool = False,
) -> DataFrame:
    """Per incoming row: ``change`` (insert, update, unchanged) and the ``changed_fields``.

    Stamp columns do not count as changes.  A row without key is an insert.
    """
    last = _last_rows(incoming, key, order, unique)
    compared = [c for c in incoming.columns if c != key and c not in ignore]
    shared = [c for c in compared if c in existing.columns]
    old = _marked(existing.where(field(key).isNotNull()).select(field(key), *[field(c) for c in shared]), key, 1)
    both = _marked(last, key, 2).alias("i").join(old.alias("e"), _same_key(key), "left")
    known = F.col(f"e.{_PRESENT}").isNotNull()
    tests = []
    for c in compared:
        new = F.col(f"i.{quoted(c)}")
        differs = ~new.eqNullSafe(F.col(f"e.{quoted(c)}")) if c in shared else new.isNotNull()
        tests.append(F.when(known & differs, F.lit(c)))
    changed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    labelled = both.select(F.col(f"i.{quoted(key)}").alias(key), known.alias("__known"), changed.alias("changed_fields"))
    label = (
        F.when(~F.col("__known"), "insert")
        .when(F.size("changed_fields") > 0, "update")
        .otherwise("unchanged")
    )
    return labelled.select(field(key), label.alias("change"), "changed_fields")


def change_counts(labels: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped and processed rows of an upsert."""
    return labels.agg(
        F.count_if(F.col("change") == "insert").alias("inserted"),
        F.count_if(F.col("change") == "update").alias("updated"),
        F.count_if(F.col("change") == "unchanged").alias("skipped"),
        F.count(F.lit(1)).alias("processed"),
    )


def archive_processed(
    raw: DataFrame, done: DataFrame, key: str, hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split raw rows into those whose key is done (for the backup) and the remainder.

    Both are lazy, so each reads and joins ``raw``; ``write_archive`` does it once.
    """
    finished = distinct_keys(done.where(field(key).isNotNull()), [key])
    hot = None if hot_rows is None else hot_keys(raw, [key], hot_rows)
    return (
        lookup_join(raw, finished, [key], "left_semi", hot=hot),
        lookup_join(raw, finished, [key], "left_anti", hot=hot),
    )


def write_archive(
    raw: DataFrame, done: DataFrame, key: str, path: str | None = None
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``archive_processed`` by one pass: raw is read once and joined once, and written split by what becomes of each row.

    Returns the rows for the backup, the remainder, and how many rows each has.  Keys with very many rows are left to Spark's skew
    join: the finished keys are one row each and shuffled for the join.
    """
    finished = distinct_keys(done.where(field(key).isNotNull()), [key]).withColumn("__done", F.lit(True))
    met = raw.join(finished, key, "left").withColumn("verdict", F.when(F.col("__done"), "backup").otherwise("raw"))
    split = write_split(
        met.select(*[field(c) for c in raw.columns], "verdict"), path or scratch_folder(raw.sparkSession, "archive"), "verdict",
        **counted("verdict", "backup", "raw"),
    )
    return split.part("backup"), split.part("raw"), dict(split.figures)


def set_status(
    registry: DataFrame, datasource: str, status: str, stamp: Column | None = None
) -> DataFrame:
    """Set the status of every upload of one datasource; ``updated_at`` moves where it changed."""
    hit = (F.col("datasource") == datasource) & ~F.col("status").eqNullSafe(F.lit(status))
    changes = {"status": F.when(hit, F.lit(status)).otherwise(F.col("status"))}
    if "updated_at" in registry.columns:
        now = stamp if stamp is not None else F.current_timestamp()
        kind = registry.schema["updated_at"].dataType
        changes["updated_at"] = F.when(hit, now.cast(kind)).otherwise(F.col("updated_at"))
    return registry.withColumns(changes)


def status_changes(registry: DataFrame, datasource: str, status: str) -> DataFrame:
    """One row with the number of uploads that ``set_status`` would change."""
    hit = (F.col("datasource") == datasource) & ~F.col("status").eqNullSafe(F.lit(status))
    return registry.agg(F.count_if(hit).alias("changed"))


def set_upload_status(registry: DataFrame, upload_id: str, status: str) -> DataFrame:
    """Set the status of one upload."""
    hit = F.col("upload_id") == upload_id
    return registry.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def combine_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Append the rows of several channels; columns may differ."""
    if not frames:
        raise ValueError("nothing to combine")
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined


def observed_fields(
    rows: DataFrame, json_column: str, registered: DataFrame | None = None,
    system_fields: Sequence[str] = ("_id", "created_at", "updated_at"),
) -> DataFrame:
    """Distinct field names seen in JSON rows together with the registered ones (column ``field``)."""
    seen = rows.select(F.explode(F.json_object_keys(field(json_column))).alias("field"))
    names = seen.distinct()
    if registered is not None:
        names = names.union(registered.select(F.col("field"))).distinct()
    return names.where(~F.col("field").isin(*system_fields) & (F.col("field") != ""))
