"""A raw collection to its processed table, with the raw rows kept as backup."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.config import CollectionConfig
from tallybook.functions.dates import is_date_name, sanitize
from tallybook.functions.keys import unique_id
from tallybook.functions.text import field
from tallybook.operators.tables import change_counts, change_labels, latest_and_keyless, upsert

UNIQUE_ID = "unique_id"
_RANK = "__rank"
_UID = "__uid"


class Processed(NamedTuple):
    processed: DataFrame
    backup: DataFrame
    counts: DataFrame


def prepare_rows(raw: DataFrame, config: CollectionConfig) -> DataFrame:
    """Selected fields cleaned, with the unique id of the row as it arrived (before cleaning).

    The order columns come along as ``__rank<i>``; they decide which of several rows is the last.
    """
    ranks = {f"{_RANK}{i}": field(o) for i, o in enumerate(config.order)}
    marked = raw.withColumns({_UID: unique_id(raw, config.unique_ids), **ranks})
    dates = config.date_fields
    if dates is None:
        dates = tuple(f for f in config.fields if is_date_name(f))
    clean = sanitize(marked, [*config.fields, _UID, *ranks], dates)
    return clean.withColumnRenamed(_UID, UNIQUE_ID)


def process_collection(
    raw: DataFrame, existing: DataFrame | None, config: CollectionConfig, stamp: bool = True
) -> Processed:
    """Clean and upsert raw rows; every raw row goes to the backup.

    ``counts`` compares the arriving rows with the existing table.  The results are lazy and each
    reads the raw rows on its own.
    """
    incoming = prepare_rows(raw, config)
    ranks = [c for c in incoming.columns if c.startswith(_RANK)]
    last = latest_and_keyless(incoming, UNIQUE_ID, ranks).drop(*ranks)
    if existing is None:
        existing = raw.sparkSession.createDataFrame([], last.schema)
    labels = change_labels(existing, last, UNIQUE_ID, unique=True)
    if stamp:
        last = last.withColumn("processed_at", F.current_timestamp())
    return Processed(upsert(existing, last, UNIQUE_ID, unique=True), raw, change_counts(labels))
